"""The node table.

A document's root has node_id 0 and no parent; other nodes are numbered in preorder. ``c_nt`` and ``c_ne`` count, among the
siblings up to a node, those that a soft anchor must not skip: named ones that are no extras, and all that are no extras. With
them the test that nothing but skippable nodes lies between two siblings is an equality of integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "node_id", "parent_id", "child_ix", "kind", "named", "extra", "missing", "field", "start_byte", "end_byte", "text")
DDL = "doc_id long, node_id int, parent_id int, child_ix int, kind string, named boolean, extra boolean, missing boolean, field string, start_byte int, end_byte int, text string"


def with_counts(nodes: DataFrame) -> DataFrame:
    """Adds own_nt, own_ne, c_nt, c_ne, tot_nt, tot_ne and n_siblings, all over the siblings of a node."""
    own_nt, own_ne = (F.col("named") & ~F.col("extra")).cast("int"), (~F.col("extra")).cast("int")
    among = Window.partitionBy("doc_id", "parent_id")
    so_far = among.orderBy("child_ix").rowsBetween(Window.unboundedPreceding, 0)
    out = nodes.withColumn("own_nt", own_nt).withColumn("own_ne", own_ne)
    for c in ("nt", "ne"):
        out = out.withColumn(f"c_{c}", F.sum(f"own_{c}").over(so_far)).withColumn(f"tot_{c}", F.sum(f"own_{c}").over(among.orderBy("child_ix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.withColumn("n_siblings", F.count("*").over(among.orderBy("child_ix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def flat_trees(rows: DataFrame, root: str, order: list, doc: str = "doc_id", all_docs: DataFrame | None = None) -> DataFrame:
    """Trees of one level from rows with kind, text, and optionally extra, field and named; ``order`` orders a document's rows.

    Spans are bytes in the texts of the children joined by line feeds. ``all_docs`` (doc_id) adds documents without rows.
    """
    extra = F.coalesce("extra", F.lit(False)) if "extra" in rows.columns else F.lit(False)
    field = F.col("field").cast("string") if "field" in rows.columns else F.lit(None).cast("string")
    named = F.col("named") if "named" in rows.columns else F.lit(True)
    w = Window.partitionBy(doc).orderBy(*order)
    ends = F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1
    kids = rows.select(F.col(doc).cast("long").alias("doc_id"), F.row_number().over(w).alias("node_id"), F.lit(0).alias("parent_id"), (F.row_number().over(w) - 1).alias("child_ix"), "kind", named.alias("named"), extra.alias("extra"), F.lit(False).alias("missing"), field.alias("field"), (ends - F.octet_length(F.coalesce("text", F.lit("")))).alias("start_byte"), ends.alias("end_byte"), F.col("text").cast("string").alias("text"))
    # the last end is the sum of all, for which rows need no order
    docs = rows.groupBy(F.col(doc).cast("long").alias("doc_id")).agg((F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("int") - 1).alias("end_byte"))
    if all_docs is not None:
        docs = all_docs.select(F.col(all_docs.columns[0]).cast("long").alias("doc_id")).distinct().join(docs, "doc_id", "left").withColumn("end_byte", F.coalesce("end_byte", F.lit(0)))
    roots = docs.select("doc_id", F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("child_ix"), F.lit(root).alias("kind"), F.lit(True).alias("named"), F.lit(False).alias("extra"), F.lit(False).alias("missing"), F.lit(None).cast("string").alias("field"), F.lit(0).alias("start_byte"), "end_byte", F.lit(None).cast("string").alias("text"))
    return roots.unionByName(kids)


def dump(nodes: DataFrame, anonymous: bool = True) -> DataFrame:
    """(doc_id, tree): each tree as indented text, one node a line with its field and kind."""
    depth = depths(nodes)
    shown = depth if anonymous else depth.where("named")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("field").isNotNull(), F.concat("field", F.lit(": "))).otherwise(""), F.when(F.col("named"), F.concat(F.lit("("), "kind", F.lit(")"))).otherwise(F.concat(F.lit('"'), "kind", F.lit('"'))))
    lines = shown.select("doc_id", F.struct("node_id", line.alias("line")).alias("x"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("tree"))


def _by_document(nodes: DataFrame, build, schema: str) -> DataFrame:
    """Rows (as tuples) that ``build`` makes of each document's nodes, which come to it in order as dicts, one document at a time."""

    def run(batches):
        import pyarrow as pa

        held: list[dict] = []
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if held and r["doc_id"] != held[0]["doc_id"]:
                    rows += build(held)
                    held = []
                held.append(r)
            yield _batch(pa, rows, schema)
        if held:
            yield _batch(pa, build(held), schema)

    return nodes.repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "node_id").mapInArrow(run, schema)


def _batch(pa, rows: list[tuple], schema: str):
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def depths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their depth, however deep; only links, not texts, go through Python."""

    def build(rows):
        at: dict[int, int] = {}
        for r in rows:  # a parent comes before its children
            at[r["node_id"]] = at[r["parent_id"]] + 1 if r["parent_id"] is not None else 0
        return [(r["doc_id"], r["node_id"], at[r["node_id"]]) for r in rows]

    found = _by_document(nodes.select("doc_id", "node_id", "parent_id"), build, "doc_id long, node_id int, depth int")
    return nodes.join(found, ["doc_id", "node_id"])


def dump_json(nodes: DataFrame, anonymous: bool = False) -> DataFrame:
    """(doc_id, tree): each tree as JSON objects of kind, named, range, field where there is one, and children.

    Anonymous nodes are left out unless asked for; what stands below one goes with it.
    """

    def build(rows):
        import json

        text, kids = {}, {}
        for r in reversed(rows):  # children before their parents, last one first
            if not (r["named"] or anonymous or r["parent_id"] is None):
                kids.pop(r["node_id"], None)
                continue
            own = {"kind": r["kind"], "named": r["named"], "range": [r["start_byte"], r["end_byte"]]} | ({"field": r["field"]} if r["field"] is not None else {})
            whole = f'{json.dumps(own, ensure_ascii=False, separators=(",", ":"))[:-1]},"children":[{",".join(reversed(kids.pop(r["node_id"], [])))}]}}'
            if r["parent_id"] is None:
                text[r["doc_id"]] = whole
            else:
                kids.setdefault(r["parent_id"], []).append(whole)
        return list(text.items())

    return _by_document(nodes.select("doc_id", "node_id", "parent_id", "kind", "named", "start_byte", "end_byte", "field"), build, "doc_id long, tree string")
