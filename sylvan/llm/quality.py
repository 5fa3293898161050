"""Quality filter by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of target text and one of all text, give each document a log
likelihood ratio. To the bigrams belongs the one of word classes that says whether a word repeats the one before. A bucket's
target probability is drawn towards that of all text, so that a word seen a few times only says little. Adding Gumbel noise and taking the top k draws k documents without replacement, with odds that follow the
ratios.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import U64, Words, batches, lean, mix, stored

N_BUCKETS = 1 << 18
#: Pseudo-counts by which a bucket's target count is drawn to what all text would give.
PRIOR = 100.0


def _features(texts: list) -> list[np.ndarray]:
    """Buckets of the unigrams and bigrams of each text."""
    w, out = Words(texts), []
    for a, b in zip(w.cut[:-1].tolist(), w.cut[1:].tolist(), strict=True):
        h = w.hash[a:b]
        out.append((np.concatenate([h, mix(h[1:] * U64(31) + h[:-1]), np.where(h[1:] == h[:-1], U64(1), U64(2))]) % U64(N_BUCKETS)).astype(np.int64))
    return out


def labelled_sample(labels: DataFrame, max_rows: int = 20_000, salt: str = "quality") -> dict[int, bool]:
    """doc_id -> whether target, for about ``max_rows`` labelled documents chosen by a hash of doc_id.

    Rows with a null doc_id or quality are left out; a document with different labels counts by the lowest.
    """
    rows = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    t = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).toArrow()
    return dict(zip(t.column("doc_id").to_pylist(), (q > 0 for q in t.column("quality").to_pylist()), strict=True))


def fit(docs: DataFrame, target: set[int]) -> np.ndarray:
    """Log ratio of each bucket's probability in the target documents to that in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(target))

    def count(rows):
        raw, good = np.zeros(N_BUCKETS, np.int64), np.zeros(N_BUCKETS, np.int64)
        for ids, texts in batches(rows, "doc_id", "text"):
            for lo in range(0, len(ids), 500):
                found = _features(texts[lo : lo + 500])
                raw += np.bincount(np.concatenate(found), minlength=N_BUCKETS)
                of_target = [f for f, doc in zip(found, ids[lo : lo + 500], strict=True) if doc in shared.value]
                if of_target:
                    good += np.bincount(np.concatenate(of_target), minlength=N_BUCKETS)
        k = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"at": k.astype(np.int64), "raw": raw[k], "good": good[k]})

    t = docs.mapInArrow(lean(count), "at long, raw long, good long").groupBy("at").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(N_BUCKETS), np.zeros(N_BUCKETS)
    at = t.column("at").to_numpy()
    raw[at], good[at] = t.column("raw").to_numpy(), t.column("good").to_numpy()
    return np.log(good + PRIOR) - np.log(raw / max(1, raw.sum()) * good.sum() + PRIOR)


def scores(docs: DataFrame, ratio: np.ndarray, seed: int = 5, temper: float = 1.0) -> DataFrame:
    """(doc_id, score, key): the log likelihood ratio of the whole text, and that over ``temper`` plus Gumbel noise fixed by doc_id and
    seed."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(rows):
        for ids, texts in batches(rows, "doc_id", "text"):
            s = np.array([shared.value[f].sum() for f in _features(texts)])
            u = (mix(np.array([(i or 0) & (1 << 64) - 1 for i in ids], U64) * U64(2 * seed + 1) + U64(seed)) >> U64(11)).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "score": s, "key": s / temper - np.log(-np.log((u + 0.5) / (1 << 53)))})

    return docs.mapInArrow(lean(run), "doc_id long, score double, key double")


def top_k(rows: DataFrame, k: int, order: str = "key", tie: str = "doc_id") -> DataFrame:
    """The k rows of the largest ``order``, ties by the least ``tie``; rows that are equal in both stay or go together.

    The k-th row is found by counting in ever narrower ranges, 4,096 at a time, until few rows are left to sort.
    """
    lo, hi, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    if k >= n:
        return rows
    if k <= 0:
        return rows.limit(0)
    above = 0
    inside = rows
    while n > 10_000 and lo < hi:
        step = (hi - lo) / 4096
        cell = F.least(F.lit(4095), F.floor((F.col(order) - lo) / step)).cast("int")
        counts = sorted(((r["cell"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).collect()), reverse=True)
        for _, m, a, b in counts:
            if above + m >= k:
                n, lo, hi = m, a, b
                break
            above += m
        inside = rows.where((F.col(order) >= lo) & (F.col(order) <= hi))
    last = inside.orderBy(F.desc(order), F.asc_nulls_last(tie)).limit(k - above).agg(F.max_by(F.struct(order, tie), F.struct(-F.col(order), tie)).alias("r")).first()["r"]
    tied = (F.col(order) == last[order]) & ((F.col(tie) <= last[tie]) if last[tie] is not None else F.lit(True))
    return rows.where((F.col(order) > last[order]) | tied)


def cut_for(labelled: DataFrame, keep: float) -> float:
    """Key at which labelled rows (key, good) are told apart best, ``keep`` being the weight of a target row that goes."""
    t = labelled.toArrow()
    key, good = t.column("key").to_numpy(), t.column("good").to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(key)
    key, good = key[order], good[order]
    if good.all() or not len(good):
        return -np.inf
    lost, caught = np.r_[0, np.cumsum(good)] / max(1, good.sum()), np.r_[0, np.cumsum(~good)] / (~good).sum()
    i = int(np.argmax(caught - keep * lost))
    # half way to the next row up
    return -np.inf if i == 0 else float(key[i - 1] + key[min(i, len(key) - 1)]) / 2


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, max_labels: int = 20_000, keep: float = 4.0, budget: float | None = None, temper: float = 1.0) -> DataFrame:
    """(doc_id, score, key) of the documents drawn from ``docs`` (doc_id, text) with ``labels`` (doc_id, quality).

    The sampled labelled rows are halved by doc_id. The target model is counted on the rows of quality 1 of one half, the raw
    model on all documents. ``budget`` gives k as a share of the documents. Without ``k`` and ``budget``, k is the number
    of documents above the key that tells the other half apart best. Whole texts have ratios far beyond the noise, so that such a draw
    hardly varies; a larger ``temper`` divides the ratios and lets documents of lower ones in. A null or blank text scores 0. A null
    doc_id is scored as 0 is. Rows that repeat a doc_id and a text share a fate. Without usable labels all documents stay.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labelled_sample(labels, max_labels)
    fitting = {d for d in known if zlib.crc32(str(d).encode()) & 1}
    good = {d for d in fitting if known[d]}
    if not good:
        return scores(docs, np.zeros(N_BUCKETS))
    rows = stored(scores(docs, fit(docs, good), temper=temper), "quality")
    if k is None and budget is not None:
        k = round(budget * rows.count())
    if k is None:
        spark, held = docs.sparkSession, sorted(set(known) - fitting)
        known_rows = F.broadcast(spark.createDataFrame(pa.table({"doc_id": pa.array(held, pa.int64()), "good": pa.array([known[d] for d in held], pa.bool_())})))
        cut = cut_for(rows.join(known_rows, "doc_id").select("key", "good"), keep)
        k = rows.where(F.col("key") >= cut).count()
    return top_k(rows, k)
