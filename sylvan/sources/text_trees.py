"""Trees parsed from texts: JSON and HTML. Each text is parsed whole, one at a time, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.sources.nodes import COLUMNS, DDL

_JSON = re.compile(r'\s+|(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>true|false|null)|(?P<punct>[{}\[\]:,])|(?P<bad>.)', re.S)
_HTML = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<!(?P<doctype>[^>]*)>|</(?P<end>[A-Za-z][^\s>/]*)[^>]*>|<(?P<start>[A-Za-z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
#: Elements without an end tag, and those whose content is text up to their end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style")


class Builder:
    """Collects a document's nodes in preorder."""

    def __init__(self, text: str):
        self.text, self.rows, self.open = text, [], []
        self.ascii = text.isascii()

    def byte(self, at: int) -> int:
        return at if self.ascii else len(self.text[:at].encode("utf-8", "surrogatepass"))

    def add(self, kind: str, start: int, end: int, named: bool = True, field: str | None = None, extra: bool = False, missing: bool = False) -> list:
        parent = self.open[-1] if self.open else None
        row = [len(self.rows), parent[0] if parent else None, parent[-1] if parent else 0, kind, named, extra, missing, field, start, end, 0]
        if parent:
            parent[-1] += 1
        self.rows.append(row)
        return row

    def enter(self, kind: str, start: int, field: str | None = None) -> list:
        row = self.add(kind, start, start, field=field)
        self.open.append(row)
        return row

    def leave(self, end: int) -> None:
        self.open.pop()[9] = end

    def nodes(self) -> Iterator[tuple]:
        """Rows in the order of the node table's columns, without doc_id. Spans become bytes."""
        places = sorted({r[8] for r in self.rows} | {r[9] for r in self.rows})
        at, last, done = {}, 0, 0
        for p in places:
            done += p - last if self.ascii else len(self.text[last:p].encode("utf-8", "surrogatepass"))
            at[p], last = done, p
        for r in self.rows:
            yield (*r[:8], at[r[8]], at[r[9]], self.text[r[8] : r[9]])


def json_tree(text: str) -> Builder:
    """``document`` over one value: object (pair with fields key and value), array, string, number, true, false, null.

    Punctuation is anonymous. What cannot be read becomes an ``ERROR`` node, and closing brackets that are not there are
    missing nodes.
    """
    b = Builder(text)
    b.enter("document", 0)
    field: str | None = None
    for m in _JSON.finditer(text):
        kind = m.lastgroup
        if kind is None:
            continue
        t, top = m[0], b.open[-1]
        if kind == "bad":
            b.add("ERROR", m.start(), m.end())
        elif t in ("{", "["):
            if top[3] == "pair":
                field = "value"
            b.enter("object" if t == "{" else "array", m.start(), field)
            b.add(t, m.start(), m.end(), False)
            field = None
        elif t in ("}", "]"):
            if b.open[-1][3] == "pair":
                b.leave(m.start())
            if b.open[-1][3] == ("object" if t == "}" else "array"):
                b.add(t, m.start(), m.end(), False)
                b.leave(m.end())
            else:
                b.add("ERROR", m.start(), m.end())
        elif t == ",":
            if top[3] == "pair":
                b.leave(m.start())
            b.add(",", m.start(), m.end(), False)
        elif t == ":":
            b.add(":", m.start(), m.end(), False)
        else:
            if top[3] == "object":
                b.enter("pair", m.start())
                b.add("string" if kind == "string" else "ERROR", m.start(), m.end(), field="key")
            else:
                b.add({"string": "string", "number": "number"}.get(kind, t), m.start(), m.end(), field="value" if top[3] == "pair" else None)
    while b.open:
        if b.open[-1][3] in ("object", "array"):
            b.add("}" if b.open[-1][3] == "object" else "]", len(text), len(text), False, missing=True)
        b.leave(len(text))
    return b


def html_tree(text: str) -> Builder:
    """``html_document`` over elements: ``element`` with start_tag (tag_name, attribute), text, elements, end_tag.

    Comments are extras. An element that is never closed gets a missing end_tag; an end tag that closes nothing is an ``ERROR``.
    """
    b = Builder(text)
    b.enter("html_document", 0)
    names: list[str] = []
    at = 0

    def words(lo: int, hi: int) -> None:
        if text[lo:hi].strip():
            b.add("text", lo, hi)

    while at < len(text):
        m = _HTML.search(text, at)
        if not m:
            words(at, len(text))
            break
        words(at, m.start())
        at = m.end()
        if m["comment"] is not None:
            b.add("comment", m.start(), m.end(), extra=True)
        elif m["doctype"] is not None:
            b.add("doctype", m.start(), m.end())
        elif m["end"]:
            name = m["end"].lower()
            if name not in names:
                b.add("ERROR", m.start(), m.end())
                continue
            while names[-1] != name:
                b.add("end_tag", m.start(), m.start(), missing=True)
                b.leave(m.start())
                names.pop()
            b.add("end_tag", m.start(), m.end())
            b.leave(m.end())
            names.pop()
        else:
            name = m["start"].lower()
            b.enter("element", m.start())
            b.enter("start_tag", m.start(), "tag")
            b.add("tag_name", m.start("start"), m.end("start"), field="name")
            for a in _ATTR.finditer(m["attrs"]):
                lo = m.start("attrs")
                b.enter("attribute", lo + a.start())
                b.add("attribute_name", lo + a.start(1), lo + a.end(1), field="name")
                if a[2]:
                    b.add("attribute_value", lo + a.start(2), lo + a.end(2), field="value")
                b.leave(lo + a.end())
            b.leave(m.end())
            if name in VOID or m["attrs"].endswith("/"):
                b.leave(m.end())
            elif name in RAW:
                stop = re.compile(rf"</{name}[^>]*>", re.I).search(text, at)
                words(at, stop.start() if stop else len(text))
                b.add("end_tag", *(stop.span() if stop else (len(text), len(text))), missing=not stop)
                at = stop.end() if stop else len(text)
                b.leave(at)
            else:
                names.append(name)
    while b.open:
        if b.open[-1][3] == "element":
            b.add("end_tag", len(text), len(text), missing=True)
        b.leave(len(text))
    return b


BUILDERS: dict[str, Callable[[str], Builder]] = {"json": json_tree, "html": html_tree}
#: Other names of the languages, and the file name endings that stand for them.
ALIASES = {"htm": "html", "xhtml": "html", "jsonl": "json", ".json": "json", ".html": "html", ".htm": "html"}


def resolve(lang: str) -> str:
    """The registered name of a language, alias or ending; KeyError lists what there is."""
    name = ALIASES.get(lang.lower(), lang.lower())
    if name not in BUILDERS:
        raise KeyError(f"no tree builder for {lang}; there are {', '.join(sorted(BUILDERS))}")
    return name


def parse_trees(docs: DataFrame, lang: str, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The node table of texts. A null text is empty; rows with a null id are left out.

    The frame keeps its texts (see ``trees_of``), so that the matcher can parse a text where it matches its tree.
    """
    build = BUILDERS[resolve(lang)]

    def run(rows):
        for batch in rows:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200).to_pydict()
                out = [(d, *n) for d, t in zip(part["d"], part["t"], strict=True) for n in build(t or "").nodes()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _TYPES, strict=True)], list(COLUMNS))

    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(source).cast("string").alias("t"))
    nodes = texts.mapInArrow(run, DDL)
    nodes._trees = texts, build
    return nodes


def trees_of(nodes: DataFrame) -> tuple[DataFrame, Callable] | None:
    """The texts of a node table that is as ``parse_trees`` made it, and a function from their Arrow batches to (doc_id, columns of
    its nodes as lists) of each; None for other node tables."""
    if (found := nodes.__dict__.get("_trees")) is None:
        return None
    texts, build = found

    def documents(rows):
        for batch in rows:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200).to_pydict()
                for d, t in zip(part["d"], part["t"], strict=True):
                    yield d, [list(c) for c in zip(*build(t or "").nodes(), strict=True)]

    # texts are small beside their trees: they are dealt out, so that tasks are even however few parts the input has
    return texts.repartition(F.xxhash64("d")), documents


_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string())
