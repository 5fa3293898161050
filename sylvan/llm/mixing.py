"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic); the sums are raked until their marginals meet the targets. A document's weight
is its cell's fitted tokens over its cell's tokens, and documents are sampled with probabilities proportional to the weights,
calibrated so that the expected tokens meet the budget.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import ascii_words, batches, lean, stored

DIMENSIONS = ("source", "lang", "topic")
#: Cells up to which the fit runs on the driver; beyond it each sweep is a job.
DRIVER_CELLS = 200_000


def with_topics(docs: DataFrame, n_topics: int = 8, least: int = 6) -> DataFrame:
    """(doc_id, source, lang, topic, tokens): tokens counts the words of the whole text, topic is found by its lead word.

    The lead word is the most frequent one of ``least`` bytes or more, the first in byte order on ties; its CRC-32 picks one of
    ``n_topics``. A text without such a word is ``none``; a null text has no tokens. Null sources and languages are a category
    of their own.
    """

    def run(rows):
        for ids, sources, langs, texts in batches(rows, "doc_id", "source", "lang", "text"):
            topic, tokens = [], []
            for t in texts:
                words = ascii_words(t)
                tokens.append(len(words))
                long = Counter(w for w in words if len(w) >= least)
                topic.append(f"t{zlib.crc32(min(long, key=lambda w: (-long[w], w))) % n_topics}" if long else "none")
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "source": pa.array(sources, pa.string()), "lang": pa.array(langs, pa.string()), "topic": pa.array(topic), "tokens": pa.array(tokens, pa.int64())})

    cast = [F.col(c).cast(k).alias(c) for c, k in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("text", "string"))]
    return docs.select(*cast).mapInArrow(lean(run), "doc_id long, source string, lang string, topic string, tokens long")


def tempered(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """Targets (value, share) of each dimension: its token shares to a power, scaled to 1."""
    out = {}
    for d, p in powers.items():
        own = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0").select("value", F.pow("n", F.lit(p)).alias("s"))
        out[d] = own.crossJoin(F.broadcast(own.agg(F.sum("s").alias("all")))).select("value", (F.col("s") / F.col("all")).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 100, tolerance: float = 1e-9, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(dimensions..., tokens, weight): factors by which the cells' tokens meet the target shares of each dimension.

    Values without a target keep the share that they have; targets without tokens are left out and the rest scaled up. Cells
    without tokens have weight 0. The fit stops when no marginal is off by more than ``tolerance`` of its target.
    """
    dims = list(targets)
    if cells.count() > driver_cells:
        return _rake_by_jobs(cells, targets, sweeps, tolerance)
    t = cells.toArrow()
    tokens = t.column("tokens").to_numpy().astype(float)
    w = np.ones(len(tokens))
    plan = []
    for d in dims:
        values, index = _index(t.column(d).to_pylist())
        share = {r["value"]: r["share"] for r in targets[d].collect()}
        have = np.bincount(index, weights=tokens, minlength=len(values)).astype(float)
        fixed = np.array([share.get(v, have[i] / max(tokens.sum(), 1)) if have[i] else 0.0 for i, v in enumerate(values)])
        plan.append((index, fixed / fixed.sum() * tokens.sum() if fixed.sum() else have.astype(float)))
    for _ in range(sweeps):
        off = 0.0
        for index, goal in plan:
            now = np.bincount(index, weights=w * tokens, minlength=len(goal)).astype(float)
            f = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            off = max(off, np.abs(f[now > 0] - 1).max(initial=0.0))
            w *= f[index]
        if off <= tolerance:
            break
    out = t.append_column("weight", pa.array(np.where(tokens > 0, w, 0.0)))
    return cells.sparkSession.createDataFrame(out)


def _index(values: list) -> tuple[list, np.ndarray]:
    at: dict = {}
    index = np.fromiter((at.setdefault(v, len(at)) for v in values), np.int64, len(values))
    return list(at), index


def _rake_by_jobs(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float) -> DataFrame:
    """The same fit with the cells spread over the executors."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for d, target in targets.items():
        have = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0")
        share = have.join(target, have.value.eqNullSafe(target.value), "left").select(have.value, F.coalesce("share", F.col("n") / max(total, 1)).alias("share"))
        goals[d] = stored(share.crossJoin(F.broadcast(share.agg(F.sum("share").alias("all")))).select("value", (F.col("share") / F.col("all") * total).alias("goal")), "mix-goal")
    now = cells.withColumn("weight", F.when(F.col("tokens") > 0, F.lit(1.0)).otherwise(0.0))
    for _ in range(sweeps):
        off = 0.0
        for d, goal in goals.items():
            have = now.groupBy(F.col(d).alias("value")).agg(F.sum(F.col("weight") * F.col("tokens")).alias("n"))
            f = have.join(goal, have.value.eqNullSafe(goal.value)).select(have.value.alias("_value"), F.when(F.col("n") > 0, F.col("goal") / F.col("n")).otherwise(0.0).alias("_f"))
            now = stored(now.join(f, F.col(d).eqNullSafe(F.col("_value")), "left").withColumn("weight", F.col("weight") * F.coalesce("_f", F.lit(0.0))).withColumn("_off", F.abs(F.col("_f") - 1)), "mix-cells")
            off = max(off, now.where("tokens > 0").agg(F.max("_off")).first()[0] or 0.0)
            now = now.drop("_value", "_f", "_off")
        if off <= tolerance:
            break
    return now


def calibrate(cells: DataFrame, budget: float) -> float:
    """The scale s at which the expected tokens, sum of tokens * min(1, s * weight), are ``budget`` of all tokens."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    lo, hi = 0.0, 1.0
    expected = lambda s: cells.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * s))).first()[0] or 0.0
    if not total:
        return 1.0
    while expected(hi) < min(budget, 1 - 1e-9) * total and hi < 1e12:
        hi *= 4
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expected(mid) < budget * total else (lo, mid)
        if hi - lo <= 1e-6 * hi:
            break
    return hi


def mix(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = 0.5, seed: int = 3, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, sampled) for each row of ``docs``.

    ``docs`` has doc_id, text, source and lang; other columns are ignored. A document without tokens has weight 1 and the
    probability of that weight. sampled is fixed by doc_id and seed, so rows that repeat a doc_id share it; a null doc_id is
    sampled as one document would be.
    """
    rows = stored(with_topics(docs), "mix-documents")
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    fitted = stored(rake(cells, targets or tempered(cells, powers or {"source": 0.5, "lang": 0.7, "topic": 0.5})), "mix-weights")
    n_cells = fitted.count()
    local = fitted
    if n_cells <= DRIVER_CELLS:  # a bounded table: calibrated on the driver, and small enough to send along
        t = fitted.toArrow()
        tokens, weight = t.column("tokens").to_numpy().astype(float), t.column("weight").to_numpy()
        scale = _scale(tokens, weight, budget)
        local = F.broadcast(fitted)
    else:
        scale = calibrate(fitted, budget)
    local = local.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), F.col("weight"), F.col("tokens").alias("_tokens"))
    same = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS]
    weight = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.col("weight"))
    out = rows.join(local, same[0] & same[1] & same[2], "left").withColumn("weight", weight)
    out = out.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return out.select("doc_id", *DIMENSIONS, "tokens", "weight", "probability", (u < F.col("probability")).alias("sampled"))


def _scale(tokens: np.ndarray, weight: np.ndarray, budget: float) -> float:
    total = tokens.sum()
    if not total:
        return 1.0
    lo, hi = 0.0, 1.0
    while (tokens * np.minimum(1, weight * hi)).sum() < min(budget, 1 - 1e-9) * total and hi < 1e12:
        hi *= 4
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (tokens * np.minimum(1, weight * mid)).sum() < budget * total else (lo, mid)
    return hi
