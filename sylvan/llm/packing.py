"""Packing token pieces into sequences of a fixed length by exact-complement hashing.

Lengths are at most the capacity, so a histogram of them is all that the packing looks at. From the longest length down, the
gap beside it is looked up among single lengths, sums of pairs and sums of triples that are still available, and whole
multiples of the combination found are used up at once. What has no exact complement is packed best-fit by falling length.
The patterns found are then dealt to the pieces by their rank among pieces of equal length.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.llm.common import batches, lean, stored, task_count


class _Sums:
    """Availability of single lengths and of the sums of two of them."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.copy()
        self.pairs = np.zeros(len(counts), np.int64)  # number of different pairs {a, b}, a <= b, with this sum
        for a in np.flatnonzero(counts).tolist():
            self._add(a, 1, only_up=True)

    def _add(self, a: int, sign: int, only_up: bool = False) -> None:
        have = np.flatnonzero(self.n[: len(self.n) - a] > 0)
        have = have[have > a] if only_up else have[have != a]
        self.pairs[have + a] += sign
        if 2 * a < len(self.n):
            self.pairs[2 * a] += sign

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for a in lengths:
            self.n[a] -= times
        for a in set(lengths):
            if self.n[a] == 0:
                self._add(a, -1)

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Lengths a >= b that add up to the gap, the largest a first; one available piece is not used twice."""
        if gap < 2:
            return None
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        b = gap - a
        hit = np.flatnonzero((self.n[a] > 0) & (self.n[b] > (a == b)))
        return (int(a[hit[0]]), int(b[hit[0]])) if len(hit) else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.n[gap] > 0:
            return (gap,)
        if self.pairs[gap] and (p := self.pair(gap)):
            return p
        a = np.flatnonzero(self.n[:gap] > 0)[::-1]
        for x in a[self.pairs[gap - a] > 0].tolist():
            self.n[x] -= 1
            p = self.pair(gap - x)
            self.n[x] += 1
            if p:
                return (x, *p)
        return None


def patterns(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) that use up ``counts`` (index: length; the last index is the capacity), falling lengths in each."""
    cap = len(counts) - 1
    s, out = _Sums(np.asarray(counts, np.int64)), []
    if s.n[cap]:
        out.append(((cap,), int(s.n[cap])))
        s.take((cap,), int(s.n[cap]))
    left = np.zeros(cap + 1, np.int64)
    for size in range(cap - 1, 0, -1):
        while s.n[size] > 0:
            s.n[size] -= 1
            found = s.fill(cap - size)
            s.n[size] += 1
            if not found:
                left[size] = s.n[size]
                s.take((size,), int(s.n[size]))
                break
            whole = (size, *found)
            times = min(int(s.n[x]) // whole.count(x) for x in set(whole))
            s.take(whole, times)
            out.append((tuple(sorted(whole, reverse=True)), times))
    # best fit for the rest: bins of equal content are one entry
    bins: dict[int, list[list]] = {}
    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        while n:
            gap = next((g for g in range(size, cap) if bins.get(g)), None)
            if gap is None:
                each = min(n, cap // size)
                times = n // each
                bins.setdefault(cap - size * each, []).append([(size,) * each, times])
                n -= times * each
                continue
            held = bins[gap][-1]
            times = min(n, held[1])
            held[1] -= times
            if not held[1]:
                bins[gap].pop()
            bins.setdefault(gap - size, []).append([(*held[0], size), times])
            n -= times
    return out + [(tuple(p), t) for entries in bins.values() for p, t in entries]


@functools.lru_cache(2)
def _encoder(ranks: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@functools.lru_cache(2)
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def token_ids(text: str | None, vocabulary: str, ranks: str, special: str = "<|endoftext|>") -> np.ndarray:
    """The ids of a text as the tokenizer file of ``vocabulary`` gives them without special tokens added, then 0.

    ``ranks`` holds the same vocabulary for a faster encoder, which is used unless the text spells out the special token.
    """
    if not text:
        ids = []
    elif special in text:
        ids = _tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    else:
        ids = _encoder(ranks).encode_ordinary(text)
    return np.array([*ids, 0], "<u4")


def token_pieces(docs: DataFrame, vocabulary: str, ranks: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, cut only where there are more than ``capacity``.

    The first piece takes the remainder and all later ones are full. A null or empty text is the one id 0.
    """

    def cut(rows):
        for ids, texts in batches(rows, "doc_id", "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(ids, texts, strict=True):
                tokens = token_ids(text, vocabulary, ranks)
                data, start, size = tokens.tobytes(), 0, (len(tokens) - 1) % capacity + 1
                for piece in range(-(-len(tokens) // capacity)):
                    for c, v in zip(out, (doc, piece, start, size, zlib.crc32(data[4 * start : 4 * (start + size)])), strict=True):
                        c.append(v)
                    start, size = start + size, capacity
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length 1 to capacity, ids_crc32) with sequence_id and offset (both long).

    Every piece gets a place; places in a sequence are gapless from 0. Equal rows get places of their own. The driver gets one
    count for each length, ``capacity`` at most; the patterns that go back to the executors are bounded by it as well.
    """
    spark = pieces.sparkSession
    n_buckets = max(8, 2 * task_count(pieces))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)).cast("int")
    pieces = stored(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", bucket.alias("bucket")), "pieces")
    per = stored(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]

    # slots: for each length, runs of ranks that belong to one pattern
    runs: dict[int, list[tuple]] = {}
    used, first = np.zeros(capacity + 1, np.int64), 0
    for lengths, times in patterns(counts):
        offset, places = 0, {}
        for x in lengths:
            places.setdefault(x, []).append(offset)
            offset += x
        for x, at in places.items():
            runs.setdefault(x, []).append((int(used[x]), first, at))
            used[x] += times * len(at)
        first += times
    table = spark.sparkContext.broadcast({x: (np.array([r[0] for r in v]), v) for x, v in runs.items()})

    def place(rows):
        for b in rows:
            t = pa.Table.from_batches([b])
            size, rank = t.column("length").to_numpy(), t.column("rank").to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for x in np.unique(size).tolist():
                at = np.flatnonzero(size == x)
                starts, v = table.value[x]
                run = np.searchsorted(starts, rank[at], "right") - 1
                for i in np.unique(run).tolist():
                    sel = at[run == i]
                    start, base, places = v[i]
                    o = rank[sel] - start
                    seq[sel], off[sel] = base + o // len(places), np.array(places)[o % len(places)]
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "bucket", "base")
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("local", F.row_number().over(local)).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("local") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str, capacity: int = 2048) -> DataFrame:
    """Tokenises, cuts and packs ``docs`` (doc_id, text); one row for each piece. An empty table gives an empty result."""
    return pack(token_pieces(docs, vocabulary, ranks, capacity), capacity)
