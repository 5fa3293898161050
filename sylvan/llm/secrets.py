"""Secret scans: three fixed patterns, and an assignment-aware lexer for literals bound to sensitive names.

The lexer reads source and configuration syntax (``name = "literal"``, ``"name": "literal"``, ``name: value``,
``NAME=value``) into pairs of a name and a literal, follows names that are assigned other names, and scores each literal by
how sensitive the names are that it reaches and by what it looks like.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import batches, lean

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "literal", "propagated")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IS_HEX = bytes(49 if chr(i) in "0123456789abcdef" else 48 for i in range(256))

#: Name parts and how sensitive a target is that contains them.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.8, "secret": 1.0, "token": 0.8, "apikey": 1.0, "api_key": 1.0, "access_key": 1.0, "private_key": 1.0, "credential": 0.9, "auth": 0.5, "signature": 0.4}
#: Values that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "undefined", "null", "none", "true", "false", "redacted", "required", "optional"}

_PAIR = re.compile(
    r"""(?P<q>["'`]?)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)(?P=q)[ \t]*"""
    r"""(?::=|=>|=(?!=)|:(?!:)(?:[ \t]*(?P<type>[A-Za-z_][A-Za-z0-9_.]*(?:\[[^\]=\n]*\]|<[^>=\n]*>)?[?!]?(?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z0-9_.]*)*)(?:[ \t]+=(?![=>])|=(?=[ \t]*["'`])))?)[ \t]*"""
    r"""(?:"(?P<d>(?:[^"\\\n]|\\.)*)"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>[^`\n]*)`|(?P<bare>[A-Za-z0-9+/_.=\-]+)|(?P<ref>\$(?:\{[A-Za-z_][A-Za-z0-9_]*\}|[A-Za-z_][A-Za-z0-9_]*)(?![A-Za-z0-9+/_.=\-${])))""",
    re.A,
)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
#: References of shells and configuration.
_REF = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)\}|([A-Za-z_][A-Za-z0-9_]*))", re.A)


def name_score(name: str) -> float:
    low = name.lower().replace("-", "_")
    return max((w for part, w in SENSITIVE.items() if part in low), default=0.0)


def literal_score(value: str) -> float:
    """0 to 1: length, entropy and kinds of characters of a literal; 0 for placeholders and text with blanks."""
    n = len(value)
    if n < 6 or value.lower().strip("_.-<>{}$") in PLACEHOLDERS or any(c.isspace() for c in value) or len(set(value)) < 4:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value) + any(not c.isalnum() for c in value)
    return min(1.0, 0.3 * min(1.0, n / 16) + 0.4 * min(1.0, entropy / 4) + 0.15 * (kinds - 1) + 0.1)


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    out = []
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"1" * 24 in text.encode("utf-8", "surrogatepass").translate(_IS_HEX):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def lexed_spans(text: str, low: str, threshold: float) -> list[tuple[int, int, str]]:
    """Spans of literals bound to sensitive names, directly or through names assigned to each other in order."""
    if not any(p in low for p in SENSITIVE):
        if "-" not in low or not any(p in low.replace("-", "_") for p in SENSITIVE):
            return []
    bound: dict[str, tuple[int, int, bool]] = {}  # name -> span of its literal; whether a bare word
    out = {}
    for m in _PAIR.finditer(text):
        group = next(g for g in ("d", "s", "b", "bare", "ref") if m[g] is not None)
        value, start, end = m[group], m.start(group), m.end(group)
        score, kind = name_score(m["name"]), "literal"
        if m["type"] and group in ("bare", "ref") and score * literal_score(m["type"]) >= threshold:
            out.setdefault(m.span("type"), kind)  # without quotes, it can be the value itself
        to = value if group == "bare" and _NAME.fullmatch(value) else None
        if group != "s" and (ref := _REF.fullmatch(value)):
            to = ref[1] or ref[2]
        if to in bound:
            start, end = bound[to][:2]
            kind = "propagated"
        elif group == "ref":
            continue
        bound[m["name"]] = (start, end, group == "bare")
        if score and score * literal_score(text[start:end]) >= threshold:
            out.setdefault((start, end), kind)
    return [(a, b, k) for (a, b), k in out.items()]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_secrets(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans array of (kind, start, end), base array of the same) for each row of ``docs`` (doc_id, text).

    Positions are code points, ends exclusive. ``base`` holds the spans of the three fixed patterns, ``spans`` those and the
    lexer's. A null text is taken as empty; a null doc_id stays null; equal rows give equal rows; other columns are ignored.
    """

    def scan(rows):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        listed = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))]
        for ids, texts in batches(rows, "doc_id", "text"):
            base, every = [], []
            for text in texts:
                text = text or ""
                low = text.lower()
                found = base_spans(text, low)
                base.append(listed(found))
                every.append(listed(found + lexed_spans(text, low, threshold)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(every, kind), pa.array(base, kind)], ["doc_id", "spans", "base"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(scan), f"doc_id long, spans {spans}, base {spans}")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and the joined spans of what ``find_secrets`` returns."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def brute_base(text: str | None) -> tuple[int, int, int, str]:
    """The fixed patterns read off their definition, for tests."""
    text, spans = text or "", []
    for kind, pattern, least, flags in (("assign", _ASSIGN.pattern, 6, re.I | re.A), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)):
        spans += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m[2] if kind == "assign" else m[0]) >= least]
    n = Counter(k for _, _, k in spans)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined(spans).encode()).hexdigest()
