"""Near-duplicate vectors by Euclidean p-stable hashing, followed by exact cosines.

Each table hashes a normalised vector by ``m`` quantised random projections floor((a.v + b) / w). The number of projections
grows with the logarithm of the number of different vectors, so that a bucket holds a constant number of unrelated ones, and
the number of tables follows from the wanted recall at the threshold. Within a bucket all cosines are computed in double
precision, in blocks; a pair is counted in the first table that brings it together, so no list of pairs is ever made.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import U64, components, lean, lean_group, mix, stored

#: Bucket members that are compared in one block.
BLOCK = 1024


def collision(distance: float, width: float) -> float:
    """Chance that one quantised projection agrees for two vectors at this distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, recall: float, width: float = 2.0) -> tuple[int, int]:
    """Projections a table and tables: about 16 unrelated vectors a bucket, and ``recall`` for pairs at the threshold."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    m = max(4, math.ceil(math.log(max(n, 2) / 16) / -math.log(far)))
    return m, max(4, math.ceil(math.log(1 - recall) / math.log1p(-(near**m))))


def _labels(linked: np.ndarray) -> np.ndarray:
    """Least index reached from each index of a symmetric Boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.97, width: float = 2.0, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id long, embedding array of numbers).

    n_links counts the other rows linked directly, component_id is the least vec_id reached and kept says that it is the row's
    own. Rows with equal components are one class and linked. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing; so do vectors of different lengths with each other. A null vec_id stays null and links with
    nothing. Other columns are ignored.
    """
    spark = vectors.sparkSession

    def describe(rows):
        for b in rows:
            ids, values = b.column(0).to_pylist(), b.column(1)
            size = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            digest, blob = [], []
            for i, n in enumerate(size.tolist()):
                v = values[i].values.to_numpy(zero_copy_only=False).astype("<f8") if n else np.zeros(0)
                ok = n and ids[i] is not None and np.isfinite(v).all() and v.any()
                if ok:  # by the largest component first, whose square may be out of range
                    w = v / np.abs(v).max()
                    blob.append((w / math.sqrt(float(w @ w))).tobytes())
                else:
                    blob.append(None)
                digest.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "digest": pa.array(digest, pa.binary()), "unit": pa.array(blob, pa.binary())})

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    info = stored(rows.mapInArrow(lean(describe), "vec_id long, digest binary, unit binary"), "vectors")
    reps = info.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("unit").alias("unit"))
    reps = stored(reps, "vector-classes")
    n = reps.count()
    m, n_tables = plan(n, cosine, recall, width)

    def hashed(rows):
        planes: dict[int, tuple] = {}
        for b in rows:
            t = pa.Table.from_batches([b])
            units = t.column("unit").to_pylist()
            out = np.zeros((len(units), n_tables), np.uint32)
            length = np.array([len(u) // 8 for u in units])
            for d in np.unique(length).tolist():
                if d not in planes:
                    rng = np.random.default_rng([seed, d])
                    planes[d] = rng.standard_normal((d, m * n_tables)), rng.uniform(0, width, m * n_tables)
                at = np.flatnonzero(length == d)
                cell = np.floor((np.frombuffer(b"".join(units[i] for i in at), "<f8").reshape(-1, d) @ planes[d][0] + planes[d][1]) / width).astype(np.int64)
                h = np.full((len(at), n_tables), d, U64)
                for i in range(m):
                    h = mix(h + cell[:, i::m].astype(U64))
                out[at] = (h >> U64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([*t.combine_chunks().to_batches()[0].select(["rep", "size", "unit"]).columns, pa.array([x.tobytes() for x in out], pa.binary())], ["rep", "size", "unit", "keys"])

    def spread(rows):
        for b in rows:
            ids = np.repeat(b.column(0).to_numpy(), n_tables)
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32)
            yield pa.RecordBatch.from_pydict({"rep": ids, "at": pa.array(np.tile(np.arange(n_tables, dtype=np.int32), b.num_rows)), "key": keys.astype(np.int64)})

    keyed = stored(reps.select("rep", "size", "unit").mapInArrow(lean(hashed), "rep long, size long, unit binary, keys binary"), "vector-keys")
    bucket = keyed.select("rep", "keys").mapInArrow(lean(spread), "rep long, at int, key long")
    sizes = bucket.groupBy("at", "key").agg(F.count("*").alias("held")).where("held > 1")
    # A bucket of many members is cut in blocks, and each pair of blocks is a unit of work of its own.
    n_blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), n_blocks).cast("int")
    places = bucket.join(sizes, ["at", "key"]).select("rep", "at", "key", n_blocks.alias("blocks"), own.alias("own"))
    places = places.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    places = places.select("rep", "at", "own", F.xxhash64("at", "key", F.least("own", "other"), F.greatest("own", "other")).alias("unit_of_work"))
    n_groups = max(spark.sparkContext.defaultParallelism, n * n_tables // 20_000 + 1)
    work = places.join(keyed, "rep").withColumn("part", F.pmod("unit_of_work", F.lit(n_groups)).cast("int"))

    def compare(t: pa.Table) -> pa.Table:
        key, table = t.column("unit_of_work").to_numpy(), t.column("at").to_numpy()
        rep, size, own = (t.column(c).to_numpy() for c in ("rep", "size", "own"))
        order = np.argsort(key, kind="stable")
        units, keys = t.column("unit").to_pylist(), t.column("keys").to_pylist()
        cut = np.r_[np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]), len(order)]
        out = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            at = order[lo:hi]
            if len(at) < 2 or len({len(units[i]) for i in at.tolist()}) > 1:
                continue
            v = np.frombuffer(b"".join(units[i] for i in at.tolist()), "<f8").reshape(len(at), -1)
            near = v @ v.T >= cosine
            np.fill_diagonal(near, False)
            side = own[at]
            if side.min() != side.max():  # two blocks: only pairs across
                near &= side[:, None] != side[None, :]
            if not near.any():
                continue
            j = int(table[at[0]])
            if j:
                k = np.frombuffer(b"".join(keys[i] for i in at.tolist()), np.uint32).reshape(len(at), -1)
                x, y = np.nonzero(near)
                for s in range(0, len(x), 1 << 16):
                    p, q = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                    before = (k[p, :j] == k[q, :j]).any(axis=1)
                    near[p[before], q[before]] = False
            hit = np.flatnonzero(near.any(axis=1))
            if len(hit):
                label = _labels(near)
                out.append((rep[at[hit]], rep[at[label[hit]]], near[hit] @ size[at]))
        x = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table({"rep": x[0], "other": x[1], "links": x[2].astype(np.int64)})

    found = stored(work.groupBy("part").applyInArrow(lean_group(compare), "rep long, other long, links long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    classes = reps.select("digest", "rep", "size").join(links, "rep", "left").join(reached, F.col("rep") == F.col("id"), "left")
    classes = classes.select("digest", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = info.select("vec_id", "digest").join(classes, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
