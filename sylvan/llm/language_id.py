"""Language identification of mixed texts: script ranges, scores for each word, and Viterbi with a switching penalty.

The model holds log probabilities of hashed letter n-grams for each language and the scripts that each language uses. It is
counted on a bounded sample of the labelled rows. A word's candidates are the languages that use its script; the path of
labels through the words of a text pays a penalty for each change of language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import U64, batches, lean, mix

N_BUCKETS = 1 << 16
#: First words of the Unicode names of letters by which scripts are told apart.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "BENGALI", "TAMIL", "THAI", "HANGUL", "HIRAGANA", "KATAKANA", "CJK", "ARMENIAN", "GEORGIAN", "OTHER")
_LETTERS = re.compile(r"[^\W\d_]+")


def script_ranges() -> tuple[np.ndarray, np.ndarray]:
    """First code points of runs of letters of one script, and the index of each run's script (-1: no letters)."""
    starts, of, last = [], [], None
    for c in range(0x30000):
        ch = chr(c)
        s = -1
        if ch.isalpha():
            first = unicodedata.name(ch, "OTHER").split()[0]
            s = SCRIPTS.index(first) if first in SCRIPTS else len(SCRIPTS) - 1
        if s != last:
            starts.append(c)
            of.append(s)
            last = s
    return np.array(starts), np.array(of)


class _Scripts:
    def __init__(self):
        self.starts, self.of = script_ranges()

    def __call__(self, runs: list[str]) -> np.ndarray:
        """The script of the first letter of each run of letters."""
        first = np.fromiter((min(ord(r[0]), 0x2FFFF) for r in runs), np.int64, len(runs))
        return self.of[np.searchsorted(self.starts, first, "right") - 1]


def grams(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, run) of the 1- to 4-grams of the UTF-8 bytes of runs of letters with their ends marked."""
    data = np.frombuffer("".join(f"<{r.lower()}>" for r in runs).encode("utf-8", "surrogatepass"), np.uint8)
    run = np.cumsum(data == 60) - 1
    value, at, of = np.zeros(len(data), U64), [], []
    for n in range(1, 5):
        value = value[: len(data) - n + 1] * U64(256) + data[n - 1 :]
        inside = run[: len(data) - n + 1] == run[n - 1 :]
        if n == 1:
            inside &= (data != 60) & (data != 62)
        at.append((mix(value[inside] * U64(8) + U64(n)) % U64(N_BUCKETS)).astype(np.int32))
        of.append(run[: len(inside)][inside])
    return np.concatenate(at), np.concatenate(of)


def train(labelled: DataFrame, max_rows: int = 20_000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities [bucket, language], scripts used [script, language]) from (doc_id, text, lang).

    Rows without text or language are left out. About ``max_rows`` rows, chosen by a hash of doc_id, are read in full, and all
    their languages are learned. Without any row, no language is learned.
    """
    rows = labelled.where("text is not null and lang is not null")
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))

    def count(batch_rows):
        scripts = _Scripts()
        counts: dict[str, np.ndarray] = {}
        for langs, texts in batches(batch_rows, "lang", "text"):
            words: dict[str, Counter] = {}
            for lang, text in zip(langs, texts, strict=True):
                words.setdefault(lang, Counter()).update(_LETTERS.findall(text))
            for lang, found in words.items():
                if not found:
                    continue
                runs, times = list(found), np.fromiter(found.values(), np.int64, len(found))
                at, of = grams(runs)
                c = counts.setdefault(lang, np.zeros(N_BUCKETS + len(SCRIPTS), np.int64))
                c += np.bincount(at, weights=times[of], minlength=len(c)).astype(np.int64)
                size = np.fromiter(map(len, runs), np.int64, len(runs))
                c[N_BUCKETS:] += np.bincount(np.maximum(0, scripts(runs)), weights=times * size, minlength=len(SCRIPTS)).astype(np.int64)
        for lang, c in counts.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k)), "at": k.astype(np.int64), "n": c[k]})

    counted = rows.select("lang", "text").mapInArrow(lean(count), "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    table = np.zeros((N_BUCKETS + len(SCRIPTS), len(languages)))
    at = {x: i for i, x in enumerate(languages)}
    t = counted.toArrow()
    for lang, k, c in zip(t.column("lang").to_pylist(), t.column("at").to_pylist(), t.column("n").to_pylist(), strict=True):
        table[k, at[lang]] = c
    found, scripts = table[:N_BUCKETS], table[N_BUCKETS:]
    logp = np.log((found + 0.1) / (found.sum(axis=0) + 0.1 * N_BUCKETS)).astype(np.float32)
    return languages, logp, scripts > 0.01 * np.maximum(1, scripts.sum(axis=0))


class WordScores(dict):
    """Row of each word seen in ``scores`` and ``letters``, for up to about ``most`` different words.

    New words get rows when they are looked up, and their scores when ``settle`` is called.
    """

    def __init__(self, logp: np.ndarray, scripts: np.ndarray, most: int = 500_000):
        super().__init__()
        self.logp, self.used, self.most = logp - logp.max(axis=1, keepdims=True), scripts, most
        self.script = _Scripts()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self[""] = 0  # a word without letters, with which short texts are filled up
        self.scores, self.letters = np.zeros((1, self.logp.shape[1]), np.float32), np.zeros(1, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def settle(self) -> None:
        """Mean over each run's n-grams, weighed up by its letters, with languages ruled out that lack its script."""
        runs, of = [], []
        for i, w in enumerate(self.new):
            for r in _LETTERS.findall(w):
                if not r.isalpha():  # numerals such as fractions
                    r = "".join(filter(str.isalpha, r))
                if r:
                    runs.append(r)
                    of.append(i)
        score, letters = np.zeros((len(self.new), self.logp.shape[1]), np.float32), np.zeros(len(self.new), np.int64)
        for lo in range(0, len(runs), 50_000):
            part, word = runs[lo : lo + 50_000], np.array(of[lo : lo + 50_000])
            at, run = grams(part)
            n = np.bincount(run, minlength=len(part))
            mean = np.stack([np.bincount(run, weights=self.logp[at, k], minlength=len(part)) / n for k in range(score.shape[1])], axis=1)
            size = np.fromiter(map(len, part), np.int64, len(part))
            can = self.used[np.maximum(0, self.script(part))]
            mean = mean * np.minimum(8, size)[:, None] - 50.0 * (~can & can.any(axis=1, keepdims=True))
            np.add.at(score, word, mean.astype(np.float32))
            np.add.at(letters, word, size)
        self.scores, self.letters = np.concatenate([self.scores, score]), np.concatenate([self.letters, letters])
        self.new = []


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best label path for each text: ``scores`` is [word, text, language]; result [word, text]."""
    steps, n, k = scores.shape
    v, back = scores[0].copy(), np.zeros((steps, n, k), np.int16)
    own = np.arange(k, dtype=np.int16)
    for t in range(1, steps):
        best = v.argmax(axis=1)
        switch = v[np.arange(n), best][:, None] - penalty
        stay = v >= switch
        back[t] = np.where(stay, own, best[:, None].astype(np.int16))
        v = np.where(stay, v, switch) + scores[t]
    path = np.zeros((steps, n), np.int16)
    path[-1] = v.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t, np.arange(n), path[t]]
    return path


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], penalty: float = 12.0) -> DataFrame:
    """(doc_id, lang, score, spans) for each row of ``docs`` (doc_id, text).

    spans are (first word, last word, language) over the blank-separated words, ends included; lang is the language of most
    letters and score its share of them. A text that is null or has no letter is ``und`` with score 0 and no spans, as is every
    text if the model has no language. Ties go to the language that is first by name.
    """
    languages, logp, scripts = model
    shared = docs.sparkSession.sparkContext.broadcast((logp, scripts))

    def label(rows):
        words = WordScores(*shared.value) if languages else None
        for ids, texts in batches(rows, "doc_id", "text", most=4000):
            lang, share, spans = ["und"] * len(ids), [0.0] * len(ids), [[] for _ in ids]
            if words is not None and len(words) > words.most:
                words.reset()
            coded = []
            for i, t in enumerate(texts):
                if w := t.split() if words is not None and t else []:
                    coded.append((len(w), i, np.fromiter(map(words.__getitem__, w), np.int32, len(w))))
            if coded:
                words.settle()
                coded = [c for c in coded if words.letters[c[2]].any()]
            coded.sort(key=lambda x: x[0])
            lo = 0
            while lo < len(coded):
                hi = lo + 1
                while hi < len(coded) and (hi + 1 - lo) * coded[hi][0] <= 200_000 and hi - lo < 512:
                    hi += 1
                part, steps = coded[lo:hi], coded[hi - 1][0]
                at = np.zeros((steps, len(part)), np.int32)
                for j, (n, _, a) in enumerate(part):
                    at[:n, j] = a
                path = viterbi(words.scores[at], penalty)
                weight = words.letters[at]
                total = np.stack([(weight * (path == k)).sum(axis=0) for k in range(len(languages))])
                for j, (n, i, _) in enumerate(part):
                    k = int(total[:, j].argmax())
                    lang[i], share[i] = languages[k], float(total[k, j] / total[:, j].sum())
                    p = path[:n, j]
                    cut = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1, n]
                    spans[i] = [{"first": int(a), "last": int(b) - 1, "lang": languages[p[a]]} for a, b in zip(cut[:-1], cut[1:], strict=True)]
                lo = hi
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang), pa.array(share), pa.array(spans, kind)], ["doc_id", "lang", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(label), "doc_id long, lang string, score double, spans array<struct<first:int,last:int,lang:string>>")
