"""What users call: check, compile, run, matches, and the node tables to run over."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.lang.analysis import Query, check, compile_query, load_query
from sylvan.lang.show import show
from sylvan.limits import Limit
from sylvan.plans import relational
from sylvan.plans.emit import ddl, typescript
from sylvan.plans.schema import result_type
from sylvan.sources.nodes import COLUMNS, dump, dump_json
from sylvan.sources.text_trees import BUILDERS, parse_trees, trees_of


def infer_schema(query: Query | str, entry: str | None = None) -> T.DataType | None:
    """The Spark type of an entry's result; None if it is match only."""
    return result_type(_query(query), entry)


def run(nodes: DataFrame, query: Query | str, entry: str | None = None, fuel: Limit = None, tier: str = "auto", memory: Limit = None, stats: bool = False, provenance: bool = False) -> DataFrame:
    """(doc_id, status, result) for each document of a node table.

    status is ``match``, ``no match``, ``out of fuel`` or ``out of memory``; result has the entry's type (a variant if that
    contains itself, absent if it is match only). ``tier`` is ``auto``, ``relational`` (an error where no plan is known) or ``kernel``.
    Relational plans know no limits, so bounds, ``stats`` (adds run_stats) and ``provenance`` (adds result_provenance) run the matcher.
    """
    q = _query(query)
    if tier != "kernel" and fuel is None and memory is None and not stats and not provenance and (found := relational.plan(nodes, q, entry)) is not None:
        out = nodes.where("parent_id is null").select("doc_id").join(found.withColumn("_hit", F.lit(True)), "doc_id", "left")
        status = F.when(F.col("_hit"), "match").otherwise("no match").alias("status")
        shape = result_type(q, entry)
        return out.select("doc_id", status, *([F.col("result").cast(shape).alias("result")] if shape is not None else []))
    if tier == "relational":
        raise ValueError("there is no relational plan for this entry")
    raw = run_kernel(nodes, q, entry, fuel, memory, provenance)
    shape = result_type(q, entry)
    more = [F.struct("fuel_used", "peak_bytes").alias("run_stats")] if stats else []
    if provenance:
        more.append(F.from_json("provenance", "array<struct<path:string,query_span:array<int>,source_span:array<int>>>").alias("result_provenance"))
    if shape is None:
        return raw.select("doc_id", "status", *more)
    parsed = F.parse_json("result") if isinstance(shape, T.VariantType) else F.from_json("result", shape)
    return raw.select("doc_id", "status", parsed.alias("result"), *more)


def _dealt(nodes: DataFrame) -> DataFrame:
    """A document's nodes come together and in order, so that only one document is held at a time. The key is an expression that no
    input is dealt by already: a union of inputs that are, each coalesced for itself, would be taken as dealt and split documents."""
    return nodes.select(*COLUMNS).repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "node_id")


def _documents(rows):
    """(doc_id, columns of its nodes as lists) of each document; a row is not made a dict, since rows are many and trees small."""
    doc, held = None, None
    for batch in rows:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        columns = [_plain(batch.column(i)) for i in range(1, len(COLUMNS))]
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = [c[lo:hi] for c in columns]
            if held is not None and ids[lo] == doc:
                for c, more in zip(held, part, strict=True):
                    c += more
                continue
            if held is not None:
                yield doc, held
            doc, held = int(ids[lo]), part
    if held is not None:
        yield doc, held


def _plain(column: pa.Array) -> list:
    """The values of a column in plain types, nulls as None."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    out = column.fill_null(0 if pa.types.is_integer(column.type) else False).to_numpy(zero_copy_only=False).tolist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
        out[i] = None
    return out


def run_kernel(nodes: DataFrame, query: Query | str, entry: str | None = None, fuel: Limit = None, memory: Limit = None, provenance: bool = False) -> DataFrame:
    """(doc_id, status, result as JSON text, fuel_used, peak_bytes, provenance as JSON text): the matcher over one document at a time.

    provenance is null unless asked for; it lists, for each value of a result, its path, its span in the query and in the source.
    """
    q = _query(query)
    name = q.entry(entry).name
    schema = pa.schema([("doc_id", pa.int64()), ("status", pa.string()), ("result", pa.string()), ("fuel_used", pa.int64()), ("peak_bytes", pa.int64()), ("provenance", pa.string())])

    # of texts, the trees need not be made tables, dealt and put together again
    dealt, documents = trees_of(nodes) or (_dealt(nodes), _documents)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def match(rows):
        from sylvan.operators.kernel import STEP_BYTES, Matcher, Tree

        matcher = Matcher(q, name, fuel, memory)
        out: list[tuple] = []
        as_text = json.JSONEncoder(ensure_ascii=False).encode
        for doc, held in documents(rows):
            status, value = matcher.match_tree(Tree.of_columns(doc, *held))
            hit = status == "match"
            out.append((doc, status, as_text(matcher.plain(value)) if hit else None, matcher.used, matcher.peak * STEP_BYTES, as_text(matcher.provenance(value)) if hit and provenance else None))
            if len(out) == 1000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return dealt.mapInArrow(match, "doc_id long, status string, result string, fuel_used long, peak_bytes long, provenance string")


def trace(nodes: DataFrame, query: Query | str, entry: str | None = None, fuel: Limit = None) -> DataFrame:
    """(doc_id, step, query_start, query_end, node_id, kind, fits): each node that the matcher tries, in order."""
    q = _query(query)
    name = q.entry(entry).name
    names = ["doc_id", "step", "query_start", "query_end", "node_id", "kind", "fits"]

    def steps(rows):
        from sylvan.operators.kernel import Matcher, Tree

        for doc, held in _documents(rows):
            events: list[tuple] = []
            tree = Tree.of_columns(doc, *held)
            Matcher(q, name, fuel, trace=events).match_tree(tree)
            for lo in range(0, len(events), 10_000):
                part = events[lo : lo + 10_000]
                used, start, end, node, fits = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(part), pa.int64()), pa.array(used, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(node, pa.int32()), pa.array([tree.kind[n] for n in node]), pa.array(fits)], names)

    return _dealt(nodes).mapInArrow(steps, "doc_id long, step long, query_start int, query_end int, node_id int, kind string, fits boolean")


def matches(nodes: DataFrame, query: Query | str, entry: str | None = None) -> DataFrame:
    """(doc_id, matched) without results."""
    return run(nodes, query, entry).select("doc_id", (F.col("status") == "match").alias("matched"))


def envelope(result: DataFrame, pretty: bool = False) -> DataFrame:
    """(doc_id, json): each row of ``run`` as one JSON object with ``result`` and, without a match, ``error``.

    With the columns of ``run(..., stats=True)`` also ``run_stats``, and with those of ``provenance=True`` ``result_provenance``.
    """
    shown = [c for c in ("run_stats", "result_provenance") if c in result.columns]
    value = F.col("result") if "result" in result.columns else F.lit(None).cast("string").alias("result")
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    body = F.to_json(F.struct(value.alias("result"), *shown), options)
    none = F.to_json(F.struct(F.lit(None).cast("string").alias("result"), F.col("status").alias("error"), *(c for c in shown if c == "run_stats")), options)
    return result.select("doc_id", F.when(F.col("status") == "match", body).otherwise(none).alias("json"))


def languages() -> list[str]:
    """Languages that ``parse_trees`` reads."""
    return sorted(BUILDERS)


def check_json(text: str | dict[str, str], strict: bool = False) -> list[dict]:
    """Findings of ``check`` as plain data: kind, severity, message, source, span, line and column."""
    sources = {"query": text} if isinstance(text, str) else text
    out = []
    for d in check(text, strict)[1]:
        line, column = d.located(sources.get(d.source, ""))
        out.append({"kind": d.kind, "severity": d.severity, "message": d.message, "source": d.source, "span": [d.start, d.end], "line": line, "column": column})
    return out


def inspect(text: str | dict[str, str], entry: str | None = None) -> dict:
    """What is known of a query before it runs: findings, definitions, the entry, its type as DDL and TypeScript, its pattern."""
    q, _ = check(text)
    findings = check_json(text)
    out = {"diagnostics": findings, "definitions": list(q.definitions)}
    if any(f["severity"] == "error" for f in findings):
        return out
    return out | {"entry": q.entry(entry).name, "schema": ddl(q, entry), "typescript": typescript(q), "pattern": {n: show(d.body) for n, d in q.definitions.items()}}


def _query(q: Query | str) -> Query:
    return compile_query(q) if isinstance(q, str) else q


__all__ = ["check", "check_json", "compile_query", "dump", "dump_json", "envelope", "infer_schema", "inspect", "languages", "load_query", "matches", "parse_trees", "run", "run_kernel", "trace"]
