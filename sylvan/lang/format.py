"""Query text from a syntax tree: one style, the same after a second pass."""

from __future__ import annotations

import re

from sylvan.lang.ast import Alt, Anchor, Capture, Field, Node, Pattern, Quant, QueryError, Ref, Seq
from sylvan.lang.parser import parse

WIDTH = 80


def quoted(v: str) -> str:
    special = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\", '"': '\\"'}
    return '"' + "".join(special.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in v) + '"'


def _head(p: Node) -> str:
    kind = p.kind or "_"
    if p.missing:
        inner = "" if p.kind is None else f" {kind if p.named else quoted(p.kind)}"
        return f"MISSING{inner}"
    if p.predicate:
        op, v = p.predicate
        kind += f" {op} " + (f"/{v}/" if op in ("=~", "!~") else quoted(v))
    return kind


def _parts(p: Pattern) -> tuple[str, list[str], str]:
    """Opening text, items and closing text of a pattern whose items may stand on lines of their own."""
    if isinstance(p, Node):
        return f"({_head(p)}", [*(write(i) for i in p.items), *(f"-{f}" for f in p.absent)], ")"
    if isinstance(p, Seq):
        return "{", [write(i) for i in p.items], "}"
    return "[", [(f"{label}: " if label else "") + write(o) for label, o in p.options], "]"


def write(p: Pattern, first: int = 0) -> str:
    """A pattern as text; lines after the first are indented by two blanks for each level."""
    if isinstance(p, Anchor):
        return ".!" if p.exact else "."
    if isinstance(p, Ref):
        return f"({p.name})"
    if isinstance(p, Field):
        return f"{p.name}: {write(p.inner)}"
    if isinstance(p, Quant):
        return write(p.inner) + (("+" if p.least else "*") if p.many else "?") + ("?" if p.lazy else "")
    if isinstance(p, Capture):
        return f"{write(p.inner)} @{p.name or '_'}" + (f" :: {p.type}" if p.type else "")
    if isinstance(p, Node) and not p.missing and not p.body and p.named is not True:
        return "_" if p.kind is None else quoted(p.kind)
    opening, items, closing = _parts(p)
    line = (" " if isinstance(p, Node) else "").join([opening, ""]) if items else opening
    line += " ".join(items) + closing
    many = isinstance(p, Alt) and (len(items) > 1 or p.labelled)
    if not items or not many and "\n" not in line and len(line) <= WIDTH:
        return line
    return "\n".join([opening, *(re.sub(r"(?m)^", "  ", i) for i in items), closing])


def format_query(text: str) -> str:
    """The query in standard layout, its comments before definitions kept; ``QueryError`` if it has errors."""
    definitions, found = parse(text)
    if errors := [f for f in found if f.severity == "error"]:
        raise QueryError(errors)
    out, last = [], 0
    for d in definitions:
        notes = [n.strip() for n in re.findall(r"(?m)^\s*((?:;|//)[^\n]*)", text[last : d.start])]
        out.append("\n".join([*notes, f"{d.name} = {write(d.body)}"]))
        last = d.end
    return "\n\n".join(out) + "\n"


def shebang(text: str) -> dict[str, str]:
    """The language and entry that the first line declares: ``#! ... -l LANG --entry NAME``."""
    line = text.split("\n", 1)[0]
    if not line.startswith("#!"):
        return {}
    found = {k: m[1] for k, flag in (("lang", r"(?:-l|--lang)[ =]"), ("entry", r"--entry[ =]")) if (m := re.search(flag + r"(\S+)", line))}
    return found
