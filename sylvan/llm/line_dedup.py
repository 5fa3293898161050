"""Line deduplication by an exact set-similarity join.

A line is the set of its distinct words. Words are ordered by rarity: those of one line only, which no match can share, then
unlisted ones, then the listed frequent ones by rising frequency. Of that order a line indexes a prefix, which is extended so that
its words can be taken in pairs inside hash groups (as the frequent shingles of ``ngram_join`` are): two lines seldom hold the
same two words by chance, however large the corpus. Candidates pass length and positional filters and one on 64-bit maps of their
words, and Jaccard is verified over the whole sets. A line goes if an earlier line, in the order (doc_id, line number), has a Jaccard of 0.8 or more with it, whether or
not that earlier line stays itself.

Why no match is lost. Of a line of n words, at most n // 5 are missing in a smaller match and n // 9 in a larger one. A group with c
words of the prefix counts c - 1, and removing fewer words than the counts' sum leaves two of one group. Prefixes end where the sum
exceeds what can be missing beyond the words of one line only, so of two matching lines, the one whose prefix ends first in the
order holds a pair that the other's prefix holds as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import MAP_COLUMNS, U64, Words, batches, bloom_has, bloom_of, dealt, forget, lean, lean_group, local_maps, maps_allow, mix, prefixes_meet, rare_prefixes, release, stored, task_count
from sylvan.llm.ngram_join import _HELD

#: Lines with a word counted from here may be listed with their frequency, and the most entries of that list.
LISTED_FROM, LISTED_MOST = 8, 1_000_000
#: Line sets that share a signature up to which all pairs of them are looked at in place.
SMALL = 16
#: Line sets of one task that share a signature from which they go past the bucket that others of the signature meet in.
LOCAL = 64


class Lines:
    """The sets of the lines of some texts: words of line i are ``hash[start[i]:start[i + 1]]``.

    With ``listed`` (hashes, ascending, and frequencies of frequent words, and a Bloom filter of all words of two lines or more) only
    words that other lines may have are there, in the global order; ``size`` counts all words in any case, and ``own`` those that
    are left out. ``code`` is a word's place in the list, or its hash.
    """

    def __init__(self, ids: list, texts: list, listed: tuple[np.ndarray, ...] | None = None):
        w = Words(texts)
        feed, first = w.lines()
        word, words = pd.factorize(w.hash)
        place = np.arange(len(words))
        code = words
        if listed is not None and len(words):
            keys, times, repeated = listed
            at = np.minimum(np.searchsorted(keys, words), max(0, len(keys) - 1))
            often = keys[at] == words if len(keys) else np.zeros(len(words), bool)
            code = np.where(often, at.astype(U64), words)
            rank = np.zeros(len(words), np.int64)
            rank[~often] = bloom_has(repeated, words[~often])
            rank[often] = 1 + times[at[often]]
            by_rank = np.lexsort((words, rank))
            place[by_rank] = np.arange(len(words))
            words, code, rank = words[by_rank], code[by_rank], rank[by_rank]
        begins = np.r_[True, feed[1:] != feed[:-1]] if len(feed) else np.zeros(0, bool)
        width = max(1, len(words))
        key = (np.cumsum(begins) - 1) * width + place[word]
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        self.of, self.word = key // width, key % width
        lines = feed[begins]
        doc = np.searchsorted(first, lines, "right") - 1
        self.line, self.doc = lines - first[doc], np.array(ids, np.int64)[doc]
        self.words = words
        self.size = np.bincount(self.of, minlength=len(lines))
        self.hash = words[self.word]
        self._ids = self._set_ids()
        self.own = np.zeros(len(lines), np.int64)
        if listed is not None and len(words):
            shared = rank[self.word] > 0
            self.own = np.bincount(self.of[~shared], minlength=len(lines))
            self.of, self.word, self.hash = self.of[shared], self.word[shared], self.hash[shared]
        self.code = code[self.word]
        self.start = np.searchsorted(self.of, np.arange(len(lines) + 1))

    def _set_ids(self) -> np.ndarray:
        if not len(self.size):
            return np.zeros(0, np.int64)
        start = np.r_[0, np.cumsum(self.size)[:-1]]
        x = np.add.reduceat(mix(self.words)[self.word], start)
        y = np.bitwise_xor.reduceat(mix(self.words + U64(77))[self.word], start)
        return mix(x + mix(y) * U64(0x9E3779B97F4A7C15) + self.size.astype(U64)).astype(np.int64)

    def bitmaps(self) -> np.ndarray:
        """64 bits for each line, of which each word sets one (without ``listed``, as it needs all words)."""
        if not len(self.size):
            return np.zeros(0, np.int64)
        return np.bitwise_or.reduceat((U64(1) << (mix(self.words) >> U64(58)))[self.word], self.start[:-1]).view(np.int64)

    def ids(self) -> np.ndarray:
        """A 64-bit id for each line, equal for equal sets: two sums over mixed hashes, whatever their order."""
        return self._ids


def describe_lines(docs: DataFrame) -> DataFrame:
    """Rows of lines (bucket null: doc_id, line, n words, id of its set, its bitmap) and of word counts (words, and lines that have them, in blocks)."""
    n_buckets = min(1 << 15, 4 * task_count(docs))

    def run(rows):
        held: list = []

        def flush():
            at, key = pd.factorize(np.concatenate([h for h, _ in held]))
            n = np.bincount(at, weights=np.concatenate([c for _, c in held]), minlength=len(key)).astype("<u4")
            held.clear()
            bucket = (key % U64(n_buckets)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")  # a radix sort
            cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            key, n = key[order], n[order]
            full = [b for b in range(n_buckets) if cut[b] < cut[b + 1]]
            none = pa.nulls(len(full), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), none, pa.nulls(len(full), pa.int32()), none, none, none, pa.array([key[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()), pa.array([n[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())], names)

        names = ["bucket", "doc_id", "line", "n", "id", "bits", "words", "times"]
        for ids, texts in batches(rows, "doc_id", "text"):
            for lo in range(0, len(ids), 250):
                x = Lines(ids[lo : lo + 250], texts[lo : lo + 250])
                if not len(x.size):
                    continue
                held.append((x.words, np.bincount(x.word, minlength=len(x.words))))
                none = pa.nulls(len(x.size), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x.size), pa.int32()), pa.array(x.doc, pa.int64()), pa.array(x.line, pa.int32()), pa.array(x.size, pa.int64()), pa.array(x.ids(), pa.int64()), pa.array(x.bitmaps(), pa.int64()), none, none], names)
                if sum(len(h) for h, _ in held) > _HELD:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(lean(run), "bucket int, doc_id long, line int, n long, id long, bits long, words binary, times binary")


def listed_words(described: DataFrame, most: int = LISTED_MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (ascending) and line counts of the words of ``LISTED_FROM`` lines or more, the most frequent ``most``, and
    a Bloom filter of all words in two lines or more. Where the bounded filter is full it lacks none.
    """

    def total(t: pa.Table) -> pa.Table:
        at, key = pd.factorize(np.frombuffer(b"".join(t.column("words").to_pylist()), U64))
        n = np.bincount(at, weights=np.frombuffer(b"".join(t.column("times").to_pylist()), "<u4")).astype(np.int64)
        return pa.table({"key": key[n >= 2].astype(np.int64), "df": n[n >= 2]})

    found = stored(described.where("bucket is not null").select("bucket", "words", "times").groupBy("bucket").applyInArrow(lean_group(total), "key long, df long"), "line-words")
    repeated = bloom_of(found.select("key"))
    often = found.where(F.col("df") >= LISTED_FROM)
    levels = {r["level"]: r["n"] for r in often.groupBy(F.floor(F.log2("df")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()}
    level = min(levels, default=0)
    while sum(n for x, n in levels.items() if x >= level) > most:
        level += 1
    t = often.where(F.floor(F.log2("df")) >= level).toArrow()
    forget(found)
    key, df = t.column("key").to_numpy().astype(U64), t.column("df").to_numpy()
    order = np.argsort(key)
    return key[order], df[order], repeated


#: Sizes and positions are kept up to ``_BIG``; a set of that size or more passes all filters on them.
_BIG = 65535
#: Roles: bit 1 probes as the larger set, 2 is indexed as the smaller one, 4 marks a signature that has gone another way.
_ENTRY = np.dtype([("sig", "<u4"), ("id", "<i8"), ("n", "<u2"), ("pos", "<u2"), ("role", "u1")])


def line_signatures(x: Lines, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and entries of the lines marked in ``use``: line set, its size, place of the pair's later word, and the role.

    Sets of fewer than 4 words match equal ones only and need no entry. Signatures of the larger set carry the band of its size,
    those of the smaller one its own band and the next.
    """
    band = np.floor(np.log(np.maximum(1, x.size)) / np.log(1.25)).astype(np.int64)
    probe, index = x.size // 5 - x.own + 1, x.size // 9 - x.own + 1
    place = np.arange(len(x.of)) - x.start[x.of]
    out = [(np.zeros(0, U64), np.zeros(0, _ENTRY))]
    for step in (0, 1):
        need = np.where(use & (x.size >= 4), index if step else probe, 0)
        n_groups = np.maximum(1, (1.25 ** (band + step) / 4).astype(np.int64))
        take = np.flatnonzero((need > 0)[x.of] & (place < (need + n_groups)[x.of]))  # so many words are always enough
        if not len(take):
            continue
        of, h, pos = x.of[take], x.hash[take], place[take]
        group = (mix(h + (band + step)[of].astype(U64)) % n_groups[of].astype(U64)).astype(np.int64)
        width, deep = int(n_groups.max()), int(pos.max()) + 1
        key = (of * width + group) * deep + pos
        order = np.argsort(key, kind="stable")
        team = key[order] // deep
        again = np.zeros(len(order), np.int64)
        again[order[1:]] = team[1:] == team[:-1]
        count = np.cumsum(again)
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        before = count - again - np.repeat(count[begin] - again[begin], np.diff(np.r_[begin, len(of)]))
        order = order[(before < need[of])[order]]
        team, of, h, at, early = key[order] // deep, of[order], h[order], pos[order], (before < index[of])[order]
        for lag in range(1, len(order)):
            i = np.flatnonzero(team[lag:] == team[:-lag])
            if not len(i):
                break
            j = i + lag
            line = of[j]
            sig = mix(np.minimum(h[i], h[j]) * U64(0x9E3779B97F4A7C15) + np.maximum(h[i], h[j]) + U64(2) * (band[line] + step).astype(U64) + U64(1))
            e = np.zeros(len(i), _ENTRY)
            e["sig"], e["id"], e["n"] = sig >> U64(32), x.ids()[line], np.minimum(x.size[line], _BIG)
            e["pos"], e["role"] = np.minimum(x.own[line] + at[j], _BIG), 2 if step else np.where(early[j], 3, 1)
            out.append((sig, e))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of entries of one signature pass the filters on roles, lengths and positions."""
    n, m, i, j = (v.astype(np.int64) for v in (p["n"], q["n"], p["pos"], q["pos"]))
    roles = (n <= m) & (p["role"] & 2 > 0) & (q["role"] & 1 > 0) | (m <= n) & (q["role"] & 2 > 0) & (p["role"] & 1 > 0)
    most = np.minimum(i, j) + np.minimum(n - i, m - j)
    big = (n == _BIG) | (m == _BIG)
    return (big | roles & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * most >= 4 * (n + m))) & (p["id"] != q["id"])


def shared_entries(docs: DataFrame, listed: tuple[np.ndarray, np.ndarray, np.ndarray], small: int = SMALL, local: int = LOCAL) -> DataFrame:
    """Candidates of the index: pairs (a, b) of line sets for signatures that few hold, and for those that many hold the entries
    (sig, a = id, n, pos, role), with b null.

    Entries travel in binary blocks by hash bucket. Of a signature that ``local`` line sets of one task hold or more, only a mark
    goes to its bucket; the entries go to buckets of the task's own, so that no bucket grows with a hot signature.
    """
    n_buckets = min(1 << 15, 4 * task_count(docs))
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    def run(rows):
        held, n, known, turn = [], 0, set(), 0

        def flush():
            bucket, e = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            return dealt((bucket << U64(32)) | e["sig"].astype(U64), bucket, e, n_buckets, local, turn)

        for ids, texts in batches(rows, "doc_id", "text"):
            for lo in range(0, len(ids), 250):
                x = Lines(ids[lo : lo + 250], texts[lo : lo + 250], shared.value)
                if not len(x.size):
                    continue
                if len(known) > 1_000_000:
                    known.clear()
                fresh = np.array([v not in known and not known.add(v) for v in x.ids().tolist()], bool)
                sig, e = line_signatures(x, fresh)
                held.append(((sig & U64(0xFFFFFFFF)) % U64(n_buckets), e))
                n += len(e)
                if n >= _HELD // 2:
                    yield flush()
                    n, turn = 0, turn + 1
        if n:
            yield flush()

    def shared_only(t: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(t.column("rows").to_pylist()), _ENTRY)
        number = t.column("bucket")[0].as_py()
        pairs = [np.zeros((0, 2), np.int64)]
        if number < 0:
            whole = (np.frombuffer(b"".join(t.column("of").to_pylist()), "<u4").astype(np.int64) << 32) + e["sig"].astype(np.int64)
        else:
            # most signatures have one holder: those go before the rows are put in order
            order = np.argsort(e["sig"])
            sig = e["sig"][order]
            new = np.r_[True, sig[1:] != sig[:-1]]
            e = e[order[~(new & np.r_[new[1:], True])]]
            e = e[np.lexsort((e["id"], e["sig"]))]
            role = e["role"]
            if len(e):
                first = np.flatnonzero(np.r_[True, (e["sig"][1:] != e["sig"][:-1]) | (e["id"][1:] != e["id"][:-1])])
                role = np.bitwise_or.reduceat(role, first)
                e = e[first].copy()
                e["role"] = role
            start = np.flatnonzero(np.r_[True, e["sig"][1:] != e["sig"][:-1]]) if len(e) else np.zeros(0, np.int64)
            held = np.diff(np.r_[start, len(e)])
            past = np.bitwise_or.reduceat(e["role"], start) & 4 > 0 if len(e) else held > 0
            for g in np.unique(held[(held > 1) & (held <= small) & ~past]).tolist():
                i, j = np.triu_indices(g, 1)
                at = start[(held == g) & ~past]
                step = max(1, 500_000 // len(i))
                for lo in range(0, len(at), step):
                    p, q = e[(at[lo : lo + step, None] + i).ravel()], e[(at[lo : lo + step, None] + j).ravel()]
                    ok = near(p, q)
                    pairs.append(np.stack([np.minimum(p["id"][ok], q["id"][ok]), np.maximum(p["id"][ok], q["id"][ok])], axis=1))
            e = e[np.repeat(past | (held > small), held) & (e["role"] & 4 == 0)] if len(e) else e
            # a bucket's number and half a signature stand for the signature
            whole = (number << 32) + e["sig"].astype(np.int64)
        two = np.concatenate(pairs)
        two = two[np.lexsort((two[:, 1], two[:, 0]))]
        two = two[np.r_[True, (two[1:] != two[:-1]).any(axis=1)]] if len(two) else two
        columns = {"sig": pa.array(np.r_[np.zeros(len(two), np.int64), whole]), "a": pa.array(np.r_[two[:, 0], e["id"]])}
        columns["b"] = pa.array(np.r_[two[:, 1], np.zeros(len(e), np.int64)], mask=np.r_[np.zeros(len(two), bool), np.ones(len(e), bool)])
        for c in ("n", "pos", "role"):
            columns[c] = pa.array(np.r_[np.zeros(len(two), np.int32), e[c].astype(np.int32)])
        return pa.table(columns)

    found = docs.mapInArrow(lean(run), "bucket int, rows binary, of binary").groupBy("bucket")
    return found.applyInArrow(lean_group(shared_only), "sig long, a long, b long, n int, pos int, role int")


def _sets_of(docs: DataFrame, needed: DataFrame, first: DataFrame, listed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(id, size, often, rest) of the line sets of ``needed`` (id), from the line that is the first to have each.

    Listed words go by their places in the list, others by their whole hashes; of words that no other line has, ``size`` has the
    number. Some sets that are not needed may be there as well.
    """
    sc = docs.sparkSession.sparkContext
    places = stored(needed.distinct().join(first, "id").select("doc_id", F.col("id").bitwiseXOR(F.col("doc_id")).alias("at")), "line-needed")
    in_docs, in_lines, shared = sc.broadcast(bloom_of(places.select("doc_id").distinct())), sc.broadcast(bloom_of(places.select("at"))), sc.broadcast(listed)
    forget(places)

    def sets(rows):
        for b in rows:
            b = b.filter(b.column(0).is_valid())
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = np.flatnonzero(bloom_has(in_docs.value, ids)) if len(ids) else []
            for lo in range(0, len(hit), 250):
                part = hit[lo : lo + 250]
                x = Lines(ids[part].tolist(), b.column(1).take(pa.array(part)).to_pylist(), shared.value)
                of = x.ids()
                if not len(of):
                    continue
                keep = np.flatnonzero(bloom_has(in_lines.value, of ^ x.doc))
                keep = keep[np.unique(np.stack([x.doc[keep], of[keep]], axis=1), axis=0, return_index=True)[1]]
                code, often = x.code, x.code < U64(LISTED_MOST)
                some = [code[x.start[i] : x.start[i + 1]][often[x.start[i] : x.start[i + 1]]] for i in keep]
                rest = [code[x.start[i] : x.start[i + 1]][~often[x.start[i] : x.start[i + 1]]] for i in keep]
                yield pa.RecordBatch.from_pydict({"id": pa.array(of[keep], pa.int64()), "size": pa.array(x.size[keep].astype(np.int32)), "often": pa.array([_three(v) for v in some], pa.binary()), "rest": pa.array([v.tobytes() for v in rest], pa.binary())})

    return docs.mapInArrow(lean(sets), "id long, size int, often binary, rest binary")


def _similar(have: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (early, late) of line sets, those with Jaccard 0.8 or more, by the sets of ``_sets_of``."""

    def verify(rows):
        for b in rows:
            for lo in range(0, b.num_rows, 2000):
                t = b.slice(lo, 2000)
                c = {n: t.column(i) for i, n in enumerate(t.schema.names)}
                owner, code = [], []
                for side in ("p", "q"):
                    for name, width in (("often", 3), ("rest", 8)):
                        blobs = c[f"{side}_{name}"].to_pylist()
                        owner.append(np.repeat(np.arange(len(blobs)), [len(v) // width for v in blobs]))
                        code.append(_whole(b"".join(blobs)) if width == 3 else np.frombuffer(b"".join(blobs), U64))
                word = pd.factorize(np.concatenate(code))[0]
                key = np.concatenate(owner) * (int(word.max(initial=0)) + 1) + word
                key.sort()
                # a word is once in each set, so what comes twice is common to both
                twice = key[1:][key[1:] == key[:-1]] // (int(word.max(initial=0)) + 1)
                both = np.bincount(twice, minlength=t.num_rows)
                n, m = (c[f"{s}_size"].to_numpy(zero_copy_only=False).astype(np.int64) for s in "pq")
                ok = pa.array(5 * both >= 4 * (n + m - both))
                yield pa.RecordBatch.from_arrays([c["early"].filter(ok), c["late"].filter(ok)], ["early", "late"])

    side = lambda s, c: have.select(F.col("id").alias(c), *(F.col(n).alias(f"{s}_{n}") for n in ("size", "often", "rest")))
    both = pairs.join(side("q", "late"), "late").join(side("p", "early"), "early")
    return both.mapInArrow(lean(verify), "early long, late long")


def _rare_here(have: DataFrame, lines: DataFrame) -> DataFrame:
    """Candidates (early, late) among the line sets ``lines`` (id, at, size, bits, still), late being one that still stands.

    Lines that share a frequent passage share pairs of its words. Among themselves those are the most frequent words: in the order of
    rarity within these lines alone, a prefix of single words ends before them.
    """

    def spelled(rows):
        for b in rows:
            often, rest = b.column(2).to_pylist(), b.column(3).to_pylist()
            n = np.array([len(o) // 3 + len(r) // 8 for o, r in zip(often, rest, strict=True)], np.int64)
            code = [np.zeros(0, U64), *(_whole(o) if k else np.frombuffer(r, U64) for o, r in zip(often, rest, strict=True) for k in (1, 0))]
            # mixed, so that places in the list spread over the bits of the maps as hashes do
            yield pa.RecordBatch.from_pydict({"id": pa.array(np.repeat(b.column(0).to_numpy(), n), pa.int64()), "code": pa.array(mix(np.concatenate(code)).view(np.int64))})

    words = have.join(lines.select("id"), "id", "left_semi").dropDuplicates(["id"]).select("id", "size", "often", "rest").mapInArrow(lean(spelled), "id long, code long")
    words = stored(words, "line-words-here")
    maps = local_maps(words, lines.count())
    found = stored(rare_prefixes(words, lines.join(maps, "id", "left").fillna(0, MAP_COLUMNS)), "line-rare-here")
    forget(words)
    x, y = found.alias("x"), found.where("still").alias("y")
    return y.join(x, prefixes_meet("x", "y") & F.expr("x.at < y.at") & _alike("x", "y") & maps_allow("x", "y", "size")).select(F.col("x.id").alias("early"), F.col("y.id").alias("late"))


def _alike(p: str, q: str):
    """Whether two sets can have a Jaccard of 0.8, as their bitmaps show; a bit of only one of them is a word of only that."""
    only = lambda r, t: F.bit_count(F.col(f"{r}.bits").bitwiseAND(F.bitwise_not(F.col(f"{t}.bits"))))
    return 9 * F.least(F.col(f"{p}.size") - only(p, q), F.col(f"{q}.size") - only(q, p)) >= 4 * (F.col(f"{p}.size") + F.col(f"{q}.size"))


def _three(code: np.ndarray) -> bytes:
    return code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes()


def _whole(three: bytes) -> np.ndarray:
    out = np.zeros((len(three) // 3, 8), np.uint8)
    out[:, :3] = np.frombuffer(three, np.uint8).reshape(-1, 3)
    return out.view("<u8").ravel()


def duplicate_lines(docs: DataFrame, small: int = SMALL, local: int = LOCAL, listed_most: int = LISTED_MOST) -> DataFrame:
    """(doc_id, line) of the lines that go; lines are counted from 0 and split at line feeds.

    A line without words is never removed. A null or empty text has no line that could go. Rows that repeat a doc_id are one
    document, whose lines of one number are not earlier than each other. Lines of rows with a null doc_id neither go nor
    make others go. Other columns are ignored. The last three arguments move cost and not results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    described = stored(describe_lines(docs), "lines")
    listed = listed_words(described, min(listed_most, LISTED_MOST))
    every = described.where("bucket is null")
    lines = stored(every.select("doc_id", "line", "id"), "line-ids")
    first = stored(every.groupBy("id").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.max("n").alias("size"), F.max("bits").alias("bits")), "line-classes")
    forget(described)
    by_id = first.select("id", "at.doc_id", "at.line")

    index = stored(shared_entries(docs, listed, small, local), "line-index")
    at = lambda c, as_: first.select(F.col("id").alias(c), F.struct("at", "size", "bits").alias(as_))

    # which of a pair is the earlier one is known by the first places of their sets
    few = index.where("b is not null").select("a", "b").distinct().join(at("a", "p"), "a").join(at("b", "q"), "b").where(_alike("p", "q"))
    few = few.select(F.when(F.col("p.at") < F.col("q.at"), F.col("a")).otherwise(F.col("b")).alias("early"), F.when(F.col("p.at") < F.col("q.at"), F.col("b")).otherwise(F.col("a")).alias("late"))
    groups = stored(index.where("b is null").select("sig", F.col("a").alias("id"), "n", "pos", "role").join(first, "id"), "line-groups")
    col = lambda a: lambda c: F.col(f"{a}.{c}")

    def close(p, q):
        most = F.least(p("pos"), q("pos")) + F.least(p("n") - p("pos"), q("n") - q("pos"))
        roles = (p("n") <= q("n")) & (p("role").bitwiseAND(2) > 0) & (q("role").bitwiseAND(1) > 0) | (p("n") >= q("n")) & (p("role").bitwiseAND(1) > 0) & (q("role").bitwiseAND(2) > 0)
        fits = roles & (F.least(p("n"), q("n")) * 5 >= F.greatest(p("n"), q("n")) * 4) & (9 * most >= 4 * (p("n") + q("n")))
        return fits | (F.greatest(p("n"), q("n")) == _BIG)

    # All pairs of signatures of few sets, and for those of many each set against the earliest, which settles most members of groups
    # of near copies ...
    hub = groups.groupBy("sig").agg(F.min(F.struct("at", "id", "n", "pos", "role", "size", "bits")).alias("hub"))
    star = groups.alias("y").join(hub.select("sig", "hub.*").alias("x"), "sig").where(F.col("x.id") != F.col("y.id")).where(close(col("x"), col("y")) & _alike("x", "y"))
    star = star.groupBy(F.col("y.id").alias("late")).agg(F.min_by("x.id", F.col("x.at")).alias("early")).select("early", "late")
    tried = stored(few.union(star).distinct(), "line-pairs")
    forget(index)
    ids = lambda *cs: tried.select(F.col(cs[0]).alias("id")).union(tried.select(cs[1]))
    gone = stored(_similar(_sets_of(docs, ids("early", "late"), by_id, listed), tried).select(F.col("late").alias("id")).distinct(), "line-gone")
    # ... then those that still stand against all earlier lines of their signatures, by words that are rare there.
    still = groups.join(gone, "id", "left_anti").select("sig", "id")
    met = groups.join(still.select("sig").distinct(), "sig", "left_semi").select("id", "at", "size", "bits").dropDuplicates(["id"])
    met = stored(met.join(still.select("id").distinct().withColumn("still", F.lit(True)), "id", "left").fillna(False, "still"), "line-met")
    forget(groups)
    if not met.isEmpty():
        have = stored(_sets_of(docs, met.select("id"), by_id, listed), "line-sets")
        rest = stored(_rare_here(have, met).distinct().join(tried, ["early", "late"], "left_anti"), "line-rest")
        more = stored(_similar(have, rest).select(F.col("late").alias("id")).distinct(), "line-gone")
        gone = gone.union(more).distinct()
        forget(have)
        forget(rest)
    forget(met)
    forget(tried)
    classes = first.select("id", "at").join(gone.withColumn("gone", F.lit(True)), "id", "left")
    out = lines.join(classes, "id").where(F.coalesce("gone", F.lit(False)) | (F.struct("doc_id", "line") > F.col("at"))).select("doc_id", "line")
    release(docs.sparkSession)
    return out


def dedup_lines(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """``docs`` with the duplicate lines cut out of ``text``; documents all of whose lines with words go are left out.

    All columns stay; ``n_chars``, where there is one, counts the new text. Texts without a duplicate line are unchanged.
    """
    cut = duplicate_lines(docs).distinct().groupBy("doc_id").agg(F.collect_set("line").alias("_cut"))
    out = docs.join(cut, "doc_id", "left")
    split = F.split("text", "\n")
    kept = F.array_join(F.filter(split, lambda line, i: ~F.array_contains(F.coalesce("_cut", F.array().cast("array<int>")), i)), "\n")
    out = out.withColumn("_text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(kept))
    if drop_emptied:
        out = out.where(F.col("_cut").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("text", F.col("_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
