"""Helpers shared by the operators of this subpackage.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``; every executor sees that folder,
so a lost executor costs a recomputation from there and not the whole job.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Multiplier of the polynomial over word hashes (odd, so that it is invertible modulo 2**64).
_POLY = U64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; a temporary one is made only in a local session that names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sylvan-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sylvan-{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for made in _LISTS:
        made.append(out)
    release(spark)
    return out


_LISTS: list[list[DataFrame]] = []


@contextlib.contextmanager
def made_tables() -> Iterator[list[DataFrame]]:
    """A list that gets every table that ``stored`` writes while this lasts."""
    made: list[DataFrame] = []
    _LISTS.append(made)
    try:
        yield made
    finally:
        _LISTS.remove(made)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While this lasts, Arrow batches have ``rows`` rows at most: whole texts and sets make rows of many kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(df: DataFrame) -> None:
    """Deletes the table of a frame that ``stored`` returned and that no later plan reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt(key: np.ndarray, bucket: np.ndarray, e: np.ndarray, n_buckets: int, local: int, turn: int) -> pa.RecordBatch:
    """Entries with the fields ``sig`` and ``role`` as binary blocks (bucket, rows, of) for the tasks that meet them.

    Of a signature (``key``) with ``local`` entries or more only a mark (role 4) goes to its bucket. Its entries go in blocks with
    negative numbers, which spread over all tasks; ``of`` then has their buckets. So no bucket grows with a hot signature.
    """
    order = np.argsort(key)
    key, bucket, e = key[order], bucket[order], e[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    hot = np.repeat(size >= local, size)
    past, of = e[hot], bucket[hot].astype("<u4")
    blocks = []
    for i in range(0, len(past), 50_000):
        number = mix(np.array([int(key[hot][i]) ^ int(zlib.crc32(past[i : i + 50_000].tobytes())) + (turn << 40)], U64))[0] >> U64(33)
        blocks.append((-1 - int(number), past[i : i + 50_000].tobytes(), of[i : i + 50_000].tobytes()))
    mark = start[size >= local]
    marks = e[mark].copy()
    marks["role"] = 4
    bucket, e = np.concatenate([bucket[~hot], bucket[mark]]), np.concatenate([e[~hot], marks])
    order = np.argsort(bucket.astype(np.uint16), kind="stable")  # a radix sort
    bucket, e = bucket[order], e[order]
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=bucket.dtype))
    blocks += [(b, e[cut[b] : cut[b + 1]].tobytes(), b"") for b in range(n_buckets) if cut[b] < cut[b + 1]]
    b, r, o = zip(*blocks, strict=True)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(b, pa.int32()), "rows": pa.array(r, pa.binary()), "of": pa.array(o, pa.binary())})


def task_count(df: DataFrame) -> int:
    """Number of input splits, the measure by which bucket counts follow the size of the input."""
    return max(1, df.rdd.getNumPartitions())


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of a word up to which it is hashed together with all others.
_SHORT = 64


class Words:
    """Hashes of the words of some texts, all at once.

    ``hash`` has one 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; those of text i are
    ``hash[cut[i]:cut[i + 1]]``. ``line`` counts the line feeds of all texts so far, one between two texts included, and
    ``first_line`` has that count where each text begins. A null text is empty.
    """

    def __init__(self, texts: list):
        parts = [t.encode("utf-8", "surrogatepass").translate(_LOWER) if t else b"" for t in texts]
        data = b"\n" + b"\n".join(parts) + b"\n"
        self.bytes = b = np.frombuffer(data, np.uint8)
        space = _SPACE[b]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, end = edge[0::2], edge[1::2]
        begin = np.cumsum([1, *(len(p) + 1 for p in parts)])
        self.cut = np.searchsorted(self.start, begin)
        self.begin = begin[:-1]
        size = end - self.start
        order = np.argsort((65535 - np.minimum(size, 65535)).astype(np.uint16), kind="stable")  # longest first, a radix sort
        s, n = self.start[order], size[order]
        h = np.zeros(len(s), U64)
        more = len(n) - np.cumsum(np.bincount(np.minimum(n, _SHORT), minlength=_SHORT + 1)) if len(n) else np.zeros(_SHORT + 1, np.int64)
        for j in range(_SHORT):
            k = int(more[j])
            if not k:
                break
            h[:k] = h[:k] * _POLY + b[s[:k] + j]
        for i in range(int((n > _SHORT).sum())):
            h[i] = xxhash.xxh3_64_intdigest(data[s[i] : s[i] + n[i]])
        self.hash = np.empty(len(s), U64)
        self.hash[order] = mix(h + n.astype(U64) * U64(0xD1B54A32D192ED03))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """``line`` of each word, and ``first_line`` of each text."""
        feeds = np.flatnonzero(self.bytes == 10)
        return np.searchsorted(feeds, self.start), np.searchsorted(feeds, self.begin)


def shingles(texts: list, k: int = 5) -> list[np.ndarray]:
    """Hashes of the runs of ``k`` words of each text in order; of the whole text if it is shorter, none if it is empty."""
    w = Words(texts)
    n = len(w.hash) - k + 1
    h = np.full(max(0, n), k, U64)
    for i in range(k if n > 0 else 0):
        h = h * _POLY + w.hash[i : n + i]
    h = mix(h)
    return [h[a : b - k + 1] if b - a >= k else shingle_hashes(w.hash[a:b], k) for a, b in zip(w.cut[:-1].tolist(), w.cut[1:].tolist(), strict=True)]


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the runs of ``k`` words in order; of the whole sequence if it is shorter, none if it is empty."""
    n = len(words)
    if n == 0:
        return words
    m = min(k, n)
    h = np.full(n - m + 1, m, U64)
    for i in range(m):
        h = h * _POLY + words[i : n - m + 1 + i]
    return mix(h)


def batches(rows: Iterator[pa.RecordBatch], *names: str, most: int = 1000) -> Iterator[tuple[list, ...]]:
    """The named columns of each Arrow batch as Python lists, ``most`` rows at a time."""
    for b in rows:
        for lo in range(0, b.num_rows, most):
            part = b.slice(lo, most)
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)


def _trim() -> None:
    """Gives freed memory back, so that workers that wait for the next task stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for ``mapInArrow``, returning its memory when a partition is done."""

    def run(rows):
        try:
            yield from f(rows)
        finally:
            _trim()

    return run


def lean_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``f`` for ``applyInArrow``, returning its memory when a group is done."""

    def run(table):
        try:
            return f(table)
        finally:
            _trim()

    return run


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex reached) of the vertices of some edges that are not the least of their own component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = lo != hi
        if not apart.any():
            break
        np.minimum.at(root, hi[apart], lo[apart])
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


def _forest(edges: DataFrame, most: int) -> DataFrame:
    """Edges (u, v), v < u, that connect what ``edges`` (u, v) do: of each run of ``most`` rows of a task, one for each vertex."""

    def run(rows):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            u, v = _roots(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for b in rows:
            held.append(tuple(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)))
            if sum(len(x) for x, _ in held) >= most:
                yield flush()
        if held:
            yield flush()

    return edges.mapInArrow(lean(run), "u long, v long")


def components(edges: DataFrame, label: str = "cc", rounds: int = 60, most: int = 400_000) -> DataFrame:
    """Connected components: (id, component) for every vertex of ``edges`` (a, b), component being the least id reached.

    Each task first reduces its edges to one for each vertex. While more than ``most`` are left, large-star and small-star steps
    alternate, which shorten paths geometrically; nothing is gathered by vertex. The last ``most`` are one task's work. Null ends
    and loops are dropped.
    """
    e = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v and a is not null and b is not null")
    e, seen, old = stored(_forest(e, most), label), None, []
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] <= most:
            old.append(e)
            e = stored(_forest(e.repartition(1), most + 1), label)
        if now[0] <= most or now == seen:
            for x in old:
                forget(x)
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        seen = now
        old.append(e)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u is tied to the least vertex around u
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, is tied to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        j = e.join(least, "u")
        e = j.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        e = stored(e, label)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: Columns of ``local_maps`` beside id.
MAP_COLUMNS = ["own", *(f"b{i}" for i in range(8))]


def local_maps(members: DataFrame, n_sets: int) -> DataFrame:
    """(id, own, b0 to b7) of ``n_sets`` sets from their ``members`` (id, code): how many members no other of these sets has, and 512
    bits of which each member that at most half of these sets have sets one. What all share would only fill the maps."""
    df = members.groupBy("code").agg(F.count("*").alias("df")).where(F.col("df") <= n_sets // 2 + 1)
    bit, part = F.expr("shiftleft(1L, cast(pmod(code, 64) as int))"), F.expr("pmod(shiftright(code, 8), 8)")
    bits = [F.coalesce(F.bit_or(F.when(part == k, bit)), F.lit(0).cast("long")).alias(f"b{k}") for k in range(8)]
    return members.join(df, "code").groupBy("id").agg(F.sum(F.when(F.col("df") == 1, 1).otherwise(0)).alias("own"), *bits)


def maps_allow(p: str, q: str, size: str):
    """Whether two sets with the columns of ``local_maps`` can have a Jaccard of 0.8; a bit of only one of them is a member of only that."""
    only = lambda r, t: sum(F.bit_count(F.col(f"{r}.b{k}").bitwiseAND(F.bitwise_not(F.col(f"{t}.b{k}")))) for k in range(8))
    most = lambda r, t: F.col(f"{r}.{size}") - F.greatest(only(r, t), F.col(f"{r}.own"))
    return 9 * F.least(most(p, q), most(q, p)) >= 4 * (F.col(f"{p}.{size}") + F.col(f"{q}.{size}"))


def rare_prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` (id, size, ...) once for each member of its prefix, with the columns code, pos and small, for a join on code.

    ``members`` (id, code) are the members of the sets that other sets may have. They are ordered by how many of these sets have
    them, so that what all of them share comes last; members of one set only use up places. A prefix has as many as may be
    missing in a smaller set of Jaccard 0.8 and one more; ``small`` marks those that a larger one needs.
    """
    df = members.groupBy("code").agg(F.count("*").alias("df"))
    # a list is as long as its set
    order = members.join(df, "code").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "code"))).alias("_order")).join(sets, "id")
    own = (F.col("size") - F.size("_order")).cast("int")
    order = order.withColumn("_own", own).withColumn("_prefix", F.floor(F.col("size") / 5).cast("int") - own + 1).where("_prefix > 0")
    found = order.select(*sets.columns, "_own", F.posexplode(F.slice("_order", F.lit(1), F.col("_prefix"))).alias("_i", "_w")).where("_w.df > 1")
    pos = F.col("_own") + F.col("_i")
    return found.select(*sets.columns, F.col("_w.code").alias("code"), pos.alias("pos"), (pos < F.floor(F.col("size") / 9) + 1).alias("small"))


def prefixes_meet(p: str, q: str):
    """The join condition of two rows of ``rare_prefixes``: one code, and the filters on lengths, roles and positions."""
    c = lambda r, n: F.col(f"{r}.{n}")
    least, most = F.least(c(p, "size"), c(q, "size")), F.greatest(c(p, "size"), c(q, "size"))
    roles = (c(p, "size") <= c(q, "size")) & c(p, "small") | (c(p, "size") >= c(q, "size")) & c(q, "small")
    shared = F.least(c(p, "pos"), c(q, "pos")) + F.least(c(p, "size") - c(p, "pos"), c(q, "size") - c(q, "pos"))
    return (c(p, "code") == c(q, "code")) & roles & (5 * least >= 4 * most) & (9 * shared >= 4 * (c(p, "size") + c(q, "size")))


def bloom_of(ids: DataFrame, bits_per_id: int = 12, most_bytes: int = 1 << 24) -> np.ndarray:
    """A Bloom filter of the first column (long) as bytes of bits; at most ``most_bytes`` whatever the number of ids.

    Partial filters are united by chunk on the executors; the driver receives the one finished filter.
    """
    name = ids.columns[0]
    n = ids.count()
    size = 1 << 16
    while size < most_bytes and size * 8 < n * bits_per_id:
        size *= 2
    chunk = min(size, 1 << 18)

    def fill(rows):
        bits = np.zeros(size, np.uint8)
        for b in rows:
            for at in bloom_places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), size):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = [(i, bits[i : i + chunk]) for i in range(0, size, chunk) if bits[i : i + chunk].any()]
        yield pa.RecordBatch.from_pydict({"at": pa.array([i for i, _ in parts], pa.int64()), "bits": pa.array([p.tobytes() for _, p in parts], pa.binary())})

    def unite(t: pa.Table) -> pa.Table:
        out = np.zeros(chunk, np.uint8)
        for x in t.column("bits").to_pylist():
            out |= np.frombuffer(x, np.uint8)
        return pa.table({"at": t.column("at").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    parts = ids.select(F.col(name).cast("long")).where(F.col(name).isNotNull()).mapInArrow(lean(fill), "at long, bits binary")
    out = np.zeros(size, np.uint8)
    for r in parts.groupBy("at").applyInArrow(lean_group(unite), "at long, bits binary").toArrow().to_pylist():
        out[r["at"] : r["at"] + chunk] = np.frombuffer(r["bits"], np.uint8)
    return out


def bloom_places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(ids.astype(U64) + _POLY)
    step = mix(h) | U64(1)
    return [((h + U64(i) * step) % U64(size * 8)).astype(np.int64) for i in range(4)]


def bloom_has(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for at in bloom_places(ids, len(bits)):
        ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok
