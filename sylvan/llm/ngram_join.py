"""Set-similarity self-join on word shingles by token-combination prefixes.

Every document is the set of its distinct k-word shingles (64-bit hashes). Shingles are put in one global order: those of one
document only first, then the other rare ones, then those of the frequent class by rising document frequency. A document indexes a prefix of its shingles:
rare ones singly, frequent ones in pairs taken inside hash groups whose number follows the size of the set.

Why no link is lost. Let x be the larger and y the smaller set of a pair with Jaccard t or more. At most |x|/5 shingles of x
(|y|/9 of y) are missing in the other at t = 0.8. A rare shingle in a prefix counts 1, a group with c frequent shingles counts
c - 1: fewer removals than that leave some rare shingle, or two of one group, in place. Each prefix is extended until its
count exceeds the possible removals, so of the two prefixes, the one that ends first in the global order holds a signature
that the other has as well. Which shingles are called frequent affects the cost alone, so that list can be bounded.

Groups of thousands of near copies: a signature's holders are first verified against one of them, and only holders that are
still in different components after that are compared among themselves.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import MAP_COLUMNS, U64, batches, bloom_has, bloom_of, components, forget, lean, lean_group, local_maps, maps_allow, mix, release, shingles, stored, task_count

#: Document frequency from which a shingle may be called frequent, and the most entries of the list of frequent ones.
FREQUENT_FROM, FREQUENT_MOST = 8, 1_000_000
#: Hashes that a task gathers before it passes them on.
_HELD = 1_500_000
#: Most rounds of comparing each signature's holders with one of them before the rest are compared in pairs.
_TURNS = 6


def _set(h: np.ndarray) -> np.ndarray:
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) > 1 else h


def _sets(texts: list, k: int) -> list[np.ndarray]:
    return [_set(h) for lo in range(0, len(texts), 250) for h in shingles(texts[lo : lo + 250], k)]


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _pack6(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpack6(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() >> U64(16)


def _by_bucket(bucket: np.ndarray, n: int):
    """Order that sorts by bucket, and the bounds of each bucket in it."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")  # a radix sort
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (bucket null: doc_id, n shingles, digest of the set) and of shingle counts, in blocks by bucket.

    A count block holds the upper 48 bits of the hashes of shingles that a task saw once, and of those that it saw more often
    with their numbers.
    """
    n_buckets = min(1 << 15, 4 * task_count(docs))
    names = ["bucket", "doc_id", "n_shingles", "digest", "once", "more", "times"]

    def run(rows):
        held, n = [], 0

        def flush():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            # buckets are ranges of the sorted keys
            cut = np.searchsorted(keys, (np.arange(n_buckets + 1, dtype=np.float64) * (2.0**64 / n_buckets)).clip(0, 2.0**64 - 2048).astype(U64))
            cut[-1] = len(keys)
            times = times.astype("<u4")
            out: list[list] = [[], [], [], []]
            for b in range(n_buckets):
                x, t = keys[cut[b] : cut[b + 1]], times[cut[b] : cut[b + 1]]
                if len(x):
                    for c, v in zip(out, (b, _pack6(x[t == 1]), _pack6(x[t > 1]), t[t > 1].tobytes()), strict=True):
                        c.append(v)
            held.clear()
            none, no_bytes = pa.nulls(len(out[0]), pa.int64()), pa.nulls(len(out[0]), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), none, none, no_bytes, *(pa.array(c, pa.binary()) for c in out[1:])], names)

        for ids, texts in batches(rows, "doc_id", "text"):
            for lo in range(0, len(ids), 500):
                sets = _sets(texts[lo : lo + 500], k)
                no_bytes = pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(sets), pa.int32()), pa.array(ids[lo : lo + 500], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([_digest(x) for x in sets], pa.binary()), no_bytes, no_bytes, no_bytes], names)
                held += sets
                n += sum(map(len, sets))
                if n >= _HELD:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return docs.mapInArrow(lean(run), "bucket int, doc_id long, n_shingles long, digest binary, once binary, more binary, times binary")


def frequent_shingles(described: DataFrame, at_least: int = FREQUENT_FROM, most: int = FREQUENT_MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (upper 48 bits of the hash, ascending) and document frequencies of the frequent shingles, and a Bloom filter of the
    keys of all that were counted twice or more.

    All shingles of all documents are counted. The list holds those of the least power-of-two frequency, ``at_least`` or more,
    for which it has ``most`` entries or fewer. A shingle that the filter lacks is in one document only and needs no signature;
    the filter is bounded, and where it is full it lacks nothing.
    """

    def total(t: pa.Table) -> pa.Table:
        once, more, times = (t.column(c).to_pylist() for c in ("once", "more", "times"))
        keys = np.concatenate([_unpack6(b"".join(once)), _unpack6(b"".join(more))])
        weight = np.concatenate([np.ones(len(keys) - sum(map(len, more)) // 6, np.int64), np.frombuffer(b"".join(times), "<u4").astype(np.int64)])
        order = np.argsort(keys)
        keys, weight = keys[order], weight[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(weight, start) if len(keys) else weight
        ok = sums >= 2
        return pa.table({"key": keys[start][ok].astype(np.int64), "df": sums[ok]})

    blocks = described.where("bucket is not null").select("bucket", "once", "more", "times")
    found = stored(blocks.groupBy("bucket").applyInArrow(lean_group(total), "key long, df long"), "shingle-df")
    repeated = bloom_of(found.select("key"))
    levels = {r["level"]: r["n"] for r in found.where(F.col("df") >= at_least).groupBy(F.floor(F.log2("df")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()}
    level = min(levels, default=0)
    while sum(n for x, n in levels.items() if x >= level) > most:
        level += 1
    t = found.where((F.col("df") >= at_least) & (F.floor(F.log2("df")) >= level)).toArrow()
    forget(found)
    keys, df = t.column("key").to_numpy().astype(U64), t.column("df").to_numpy()
    order = np.lexsort((-df, keys))
    keys, df = keys[order], df[order]
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    return keys[first], df[first], repeated


def _band(n: int) -> int:
    """Sizes of two sets with Jaccard 0.8 or more are in one band or in adjoining ones."""
    return math.floor(math.log(n) / math.log(1.25))


def pair_hash(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """The signature of two frequent shingles, in either order, for sets of a band."""
    return mix(np.minimum(x, y) * U64(0x9E3779B97F4A7C15) + np.maximum(x, y) + U64(2 * band + 1))


def _pairs(order: np.ndarray, band: int, need: int, n_groups: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of frequent shingles, given in global order: pairs within groups, until the count reaches ``need``.

    With each comes the place in ``order`` of its later shingle.
    """
    n_groups = n_groups or max(1, int(1.25**band) // 15)
    group = (mix(order + U64(band)) % U64(n_groups)).astype(np.int64)
    seen: dict[int, list[int]] = {}
    out, got = [], 0
    for i, g in enumerate(group.tolist()):
        if got >= need:
            break
        held = seen.setdefault(g, [])
        got += bool(held)
        out += [(j, i) for j in held]
        held.append(i)
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    a = np.array(out)
    return pair_hash(order[a[:, 0]], order[a[:, 1]], band), a[:, 1]


def signatures(s: np.ndarray, keys: np.ndarray, df: np.ndarray, repeated: np.ndarray) -> tuple[int, list[tuple[np.ndarray, np.ndarray, int]]]:
    """How many shingles of a set may be in other sets, and (signatures, positions among those, role).

    Role 1 probes as the larger set, 2 is indexed as the smaller one, 3 both. Shingles of this document alone come first in the
    global order: they use up places in a prefix and need no signature. Where they are more than a fifth, nothing can link.
    """
    n = len(s)
    if n < 4:  # only equal sets can link, and those are one class already
        return 0, []
    key = s >> U64(16)
    at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
    often = keys[at] == key if len(keys) else np.zeros(n, bool)
    rare, common = s[~often], s[often]
    rare = rare[bloom_has(repeated, rare >> U64(16))]
    shareable = len(rare) + len(common)
    probe, index = n // 5 + 1 - (n - shareable), max(0, n // 9 + 1 - (n - shareable))
    if probe <= 0:
        return shareable, []
    out = [(rare[:index], np.arange(min(index, len(rare))), 3), (rare[index:probe], np.arange(index, max(index, min(probe, len(rare)))), 1)]
    if len(rare) < probe and len(common):
        order = common[np.lexsort((common, df[at[often]]))]
        band = _band(n)
        wanted = [(band, probe, 1)] + [(b, index, 2) for b in (band, band + 1) if len(rare) < index]
        for b, prefix, role in wanted:
            sig, last = _pairs(order, b, prefix - len(rare))
            out.append((sig, last + len(rare), role))
    return shareable, [x for x in out if len(x[0])]


def candidate_groups(docs: DataFrame, k: int, frequent: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(sig, doc_id, n, m, pos, role) of the signatures that two different sets or more hold, one row for each set of a signature.

    Signatures travel in binary blocks by hash bucket. A task passes a signature on once for each different set that it
    holds, and the documents of one set count as one.
    """
    n_buckets = min(1 << 15, 4 * task_count(docs))
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = np.dtype([("sig", "<u8"), ("doc", "<i8"), ("set", "<u8"), ("n", "<u4"), ("m", "<u4"), ("pos", "<u4"), ("role", "u1")])

    def make(rows):
        held, n, known = [], 0, set()

        def flush():
            x = np.concatenate(held)
            order, cut = _by_bucket((x["sig"] % U64(n_buckets)).astype(np.int64), n_buckets)
            x = x[order]
            full = [b for b in range(n_buckets) if cut[b] < cut[b + 1]]
            held.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "rows": pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())})

        for ids, texts in batches(rows, "doc_id", "text"):
            for doc, s in zip(ids, _sets(texts, k), strict=True):
                d = _digest(s)
                if doc is None or d in known:
                    continue
                if len(known) > 500_000:
                    known.clear()
                known.add(d)
                m, found = signatures(s, *shared.value)
                for sig, pos, role in found:
                    x = np.zeros(len(sig), kind)
                    x["sig"], x["doc"], x["set"], x["n"], x["m"], x["pos"], x["role"] = sig, doc, int.from_bytes(d[:8], "little"), len(s), m, pos, role
                    held.append(x)
                    n += len(x)
                if n >= _HELD // 3:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def shared_only(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("rows").to_pylist()), kind)
        # most signatures have one holder: those go before the rows are put in order
        order = np.argsort(x["sig"])
        sig = x["sig"][order]
        alone = np.r_[True, sig[1:] != sig[:-1]] & np.r_[sig[1:] != sig[:-1], True] if len(x) else np.zeros(0, bool)
        x = x[order[~alone]]
        x = x[np.lexsort((x["doc"], x["n"], x["set"], x["sig"]))]
        same = np.ones(len(x), bool)
        same[:1] = False
        for c in ("sig", "set", "n"):
            same[1:] &= x[c][1:] == x[c][:-1]
        first = np.flatnonzero(~same)
        role = np.bitwise_or.reduceat(x["role"], first) if len(x) else x["role"]
        x = x[first].copy()
        x["role"] = role
        start = np.flatnonzero(np.r_[True, x["sig"][1:] != x["sig"][:-1]])
        size = np.diff(np.r_[start, len(x)])
        x = x[np.repeat(size > 1, size)]
        return pa.table({"sig": x["sig"].astype(np.int64), "doc_id": x["doc"], "n": x["n"].astype(np.int64), "m": x["m"].astype(np.int64), "pos": x["pos"].astype(np.int64), "role": x["role"].astype(np.int32)})

    blocks = docs.select("doc_id", "text").mapInArrow(lean(make), "bucket int, rows binary")
    return blocks.groupBy("bucket").applyInArrow(lean_group(shared_only), "sig long, doc_id long, n long, m long, pos long, role int")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, hashes) of the documents in ``ids`` (doc_id); some others may be there as well."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom_of(ids.distinct()))

    def sets(rows):
        for b in rows:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(bloom_has(bits.value, ids))
            texts = b.column(1).take(pa.array(hit)).to_pylist()
            for i in range(0, len(hit), 500):
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[hit[i : i + 500]], pa.int64()), "hashes": pa.array([s.tobytes() for s in _sets(texts[i : i + 500], k)], pa.binary())})

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(lean(sets), "id long, hashes binary")


def _linked(have: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have at least ``percent`` hundredths in common, verified over the whole sets."""

    def verify(rows):
        for a, b, x, y in batches(rows, "a", "b", "x", "y"):
            ok = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p, U64), np.frombuffer(q, U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_pydict({"a": pa.array([v for v, o in zip(a, ok, strict=True) if o], pa.int64()), "b": pa.array([v for v, o in zip(b, ok, strict=True) if o], pa.int64())})

    one = pairs.join(have.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    both = one.join(have.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(lean(verify), "a long, b long")


def _members(have: DataFrame) -> DataFrame:
    """(id, code) of the members of sets."""

    def run(rows):
        for b in rows:
            blobs = b.column(1).to_pylist()
            for lo in range(0, len(blobs), 200):
                part = blobs[lo : lo + 200]
                yield pa.RecordBatch.from_pydict({"id": pa.array(np.repeat(b.column(0).to_numpy()[lo : lo + 200], [len(x) // 8 for x in part]), pa.int64()), "code": pa.array(np.frombuffer(b"".join(part), np.int64))})

    return have.select("id", "hashes").mapInArrow(lean(run), "id long, code long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for each row of ``docs`` (doc_id long, text string).

    class_id is the least doc_id with an equal set, component_id the least one reachable by links. A null or blank text has
    an empty set and is linked with nothing. Rows with a null doc_id come back with null ids and link with nothing. Rows that
    repeat a doc_id are one document: they share links. Other columns of the input are ignored. ``percent`` must be 80 or
    more, for which the prefixes are computed.
    """
    if percent < 80:
        raise ValueError("prefixes are computed for a similarity of 0.8 or more")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    described = stored(describe(docs, k), "shingle-sets")
    frequent = frequent_shingles(described)
    info = stored(described.where("bucket is null").select("doc_id", "n_shingles", "digest"), "shingle-info")
    forget(described)
    groups = stored(candidate_groups(docs, k, frequent), "shingle-groups")

    def close(p, q):
        """Length and positional filters for Jaccard 0.8 or more: the shareable shingles before and after a signature suffice."""
        most = F.least(p("pos"), q("pos")) + F.least(p("m") - p("pos"), q("m") - q("pos"))
        return (F.least(p("n"), q("n")) * 100 >= F.greatest(p("n"), q("n")) * percent) & (9 * most >= 4 * (p("n") + q("n")))

    # Each signature's holders against one of them, first the one with the fewest shingles of its own, which is the likeliest to be
    # close to all, then others, while many holders of a signature are apart ...
    found, tried, left, before = [], [], groups.withColumn("c", F.col("doc_id")), None

    def untried(pairs: DataFrame) -> DataFrame:
        for t in tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        return stored(pairs, "shingle-star")

    for turn in range(_TURNS):
        rank = lambda n, m, doc: F.struct(n - m if turn == 0 else F.lit(0), F.xxhash64(doc, F.lit(turn)))  # noqa: B023, E731
        hub = left.groupBy("sig").agg(F.min_by(F.struct("n", "m", "pos", "doc_id", "c"), rank(F.col("n"), F.col("m"), "doc_id")).alias("hub"))
        near = close(lambda c: F.col(f"hub.{c}"), F.col) & (F.col("hub.c") != F.col("c"))
        # one partner for each document and turn, however many signatures it shares with others
        one = left.join(hub, "sig").where(near).groupBy("doc_id").agg(F.min_by("hub.doc_id", rank(F.col("hub.n"), F.col("hub.m"), "hub.doc_id")).alias("hub"))
        star = untried(one.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct())
        tried.append(star)
        ends = star.select("a").union(star.select("b"))
        found.append(stored(_linked(_sets_of(docs, ends, k), star, percent), "shingle-links"))
        reached = components(reduce(DataFrame.union, found))
        now = left.drop("c").join(reached, left.doc_id == reached.id, "left").select("sig", "doc_id", "n", "m", "pos", "role", F.coalesce("component", "doc_id").alias("c"))
        sizes = now.groupBy("sig", "c").agg(F.count("*").alias("m")).groupBy("sig").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own"), F.count("*").alias("k")).where("k > 1")
        now = stored(now.join(sizes.select("sig"), "sig", "left_semi"), "shingle-apart")
        rows, pairs = now.groupBy("sig", "c").agg(F.count("*").alias("m")).groupBy("sig").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own")).agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2), F.lit(0.0))).first()
        forget(left if turn else groups)
        left = now
        if pairs <= 2 * rows + 1000 or before is not None and pairs > 0.8 * before:
            break
        before = pairs

    # ... then the holders that are still apart among themselves. What brought them together is often one passage that they all have,
    # so the rest of their shingles must allow a link as well.
    ids = stored(left.select("doc_id").distinct(), "shingle-ids")
    if not ids.isEmpty():
        have = stored(_sets_of(docs, ids, k).join(ids, F.col("id") == F.col("doc_id"), "left_semi").dropDuplicates(["id"]), "shingle-held")
        members = stored(_members(have), "shingle-members")
        maps = stored(local_maps(members, have.count()), "shingle-maps")
        forget(members)
        left_maps = left.join(maps, F.col("doc_id") == F.col("id"), "left").drop("id").fillna(0, MAP_COLUMNS)
        x, y = left_maps.where("role in (2, 3)").alias("x"), left_maps.where("role in (1, 3)").alias("y")
        fits = close(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")) & maps_allow("x", "y", "n")
        rest = x.join(y, F.expr("x.sig = y.sig and x.c <> y.c and x.n <= y.n") & fits)
        rest = untried(rest.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct())
        found.append(stored(_linked(have, rest, percent), "shingle-links"))
        for t in (have, maps, rest):
            forget(t)
    forget(ids)
    for t in (*tried, left):
        forget(t)

    least = info.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    info = info.join(least, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    # links are between members of classes: components are those of the classes' least ids
    of = info.where("doc_id <> class_id").select(F.col("doc_id").alias("id"), "class_id").distinct()
    links = reduce(DataFrame.union, found)
    ends = links.join(of.withColumnRenamed("class_id", "p"), F.col("a") == F.col("id"), "left").drop("id").join(of.withColumnRenamed("class_id", "q"), F.col("b") == F.col("id"), "left")
    reached = components(ends.select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")))
    release(spark)
    return info.join(reached, info.class_id == reached.id, "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
