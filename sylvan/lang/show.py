"""Patterns as indented text, one part a line, with spans."""

from __future__ import annotations

from sylvan.lang.ast import Alt, Anchor, Capture, Field, Node, Pattern, Quant, Ref, Seq


def show(p: Pattern, depth: int = 0) -> str:
    """A pattern and what is inside it."""
    inner: list[Pattern] = []
    if isinstance(p, Node):
        what = "any node" if p.named is None else "token" if p.named is False else "missing" if p.missing else "node"
        head = f"{what} {p.kind if p.kind is not None else '_'}" + "".join(f" -{a}" for a in p.absent) + (f" {p.predicate[0]} {p.predicate[1]!r}" if p.predicate else "")
        inner = p.items
    elif isinstance(p, Ref):
        head = f"reference {p.name}"
    elif isinstance(p, Anchor):
        head = "anchor" + (" exact" if p.exact else "")
    elif isinstance(p, Field):
        head, inner = f"field {p.name}", [p.inner]
    elif isinstance(p, Capture):
        head, inner = f"capture @{p.name or '_'}" + (f" :: {p.type}" if p.type else ""), [p.inner]
    elif isinstance(p, Quant):
        head, inner = "repeat " + {(0, False): "?", (0, True): "*", (1, True): "+"}.get((p.least, p.many), "") + ("?" if p.lazy else ""), [p.inner]
    elif isinstance(p, Alt):
        return "\n".join([f"{'  ' * depth}alternation {p.start}..{p.end}", *(f"{'  ' * (depth + 1)}option{f' {label}' if label else ''}\n{show(o, depth + 2)}" for label, o in p.options)])
    else:
        head, inner = "sequence", p.items if isinstance(p, Seq) else []
    return "\n".join([f"{'  ' * depth}{head} {p.start}..{p.end}", *(show(i, depth + 1) for i in inner)])
