"""The joins on shingles, lines and passages against brute force, with nulls, ties, copies and empty tables."""

import cProfile
import pstats
import random

import numpy as np
import pytest

from sylvan.llm.common import ascii_words, components, shingles
from sylvan.llm.line_dedup import dedup_lines, duplicate_lines
from sylvan.llm.ngram_join import jaccard_components
from sylvan.llm.substring_dedup import aligned, compare, near_windows, passage, repeated_passages, settle, widened, window_runs


def _texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = words(120)
    base, docs = [words(rng.choice([3, 4, 9, 40, 90, 200])) for _ in range(12)], []
    for b in base:
        for _ in range(rng.choice([1, 3, 25])):
            w = list(b)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                w = w + common
            docs.append(w)
    out = [(i, " ".join(w[:30]) + "\n" + " ".join(w[30:])) for i, w in enumerate(docs)]
    out += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "Only FOUR words here"), (1004, "only four WORDS here"), (None, out[0][1]), (1005, out[3][1]), (1005, out[3][1])]
    return out


def _sets(text):
    w = ascii_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def _brute_components(rows):
    sets = [(i, _sets(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_shingle_components(spark, seed):
    rows = _texts(seed)
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, component_id int, digest string").repartition(3)
    got = jaccard_components(docs).collect()
    assert len(got) == len(rows)
    want = _brute_components(rows)
    sizes = {i: len(_sets(t)) for i, t in rows}
    for r in got:
        assert r["n_shingles"] == (sizes[r["doc_id"]])
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)


def _brute_lines(rows):
    lines = [(i, n, set(ascii_words(x))) for i, t in rows if i is not None and t for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    return {(i, n) for i, n, s in lines if any((j, m) < (i, n) and 5 * len(s & q) >= 4 * len(s | q) for j, m, q in lines)}


@pytest.mark.parametrize(("seed", "switches"), [(1, {}), (2, {}), (1, {"small": 2, "local": 1 << 30}), (2, {"small": 2, "local": 2}), (1, {"local": 3, "listed_most": 5}), (2, {"listed_most": 0})])
def test_lines(spark, seed, switches):
    """Whatever the sizes from which groups go another way, and however few words are listed."""
    rows = _texts(seed)
    docs = spark.createDataFrame([(i, t, "z", len(t or "")) for i, t in rows], "doc_id long, text string, line string, n_chars long").repartition(2)
    got = {(r["doc_id"], r["line"]) for r in duplicate_lines(docs, **switches).collect()}
    assert got == _brute_lines(rows)
    out = dedup_lines(docs, drop_emptied=False)
    assert out.columns == docs.columns and out.count() == len(rows)
    for r in out.collect():
        before = dict(rows)[r["doc_id"]] if r["doc_id"] is not None else rows[0][1]
        cut = {n for i, n in got if i == r["doc_id"]}
        assert r["text"] == (None if before is None else "\n".join(x for n, x in enumerate(before.split("\n")) if n not in cut))


def test_passages(spark):
    rng = random.Random(5)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage, near, short = words(70), words(80), words(30)
    changed = list(near)
    changed[40] = "other"
    rows = [(i, " ".join(words(rng.randrange(20, 90)) + passage + words(rng.randrange(5, 60)))) for i in range(12)]
    rows += [(20 + i, " ".join(words(90) + short + words(90))) for i in range(12)]
    rows += [(50, " ".join(near + words(10))), (51, " ".join(words(33) + changed)), (60, rows[12][1]), (61, None), (62, ""), (None, rows[0][1])]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append((r["first_word"], r["last_word"], r["other"]))
    text = {i: (t or "").split() for i, t in rows}
    for i in range(12):
        at = next(k for k in range(len(text[i])) if text[i][k : k + 70] == passage)
        assert [(a, b) for a, b, _ in spans[i]] == [(at, at + 69)]
    assert set(spans) == {*range(12), 20, 60, 50, 51}
    assert spans[20][0][2] == 60 and spans[60][0][2] == 20
    assert spans[51][0][0] >= 33 and spans[51][0][1] - spans[51][0][0] >= 49


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_passages_beside_a_frequent_one(spark):
    """Recall at Jaccard 0.8 where a passage that six documents share takes the first partner of each."""
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    texts, at = [], []
    for k in range(60):
        licence, near = licence if k % 3 else words(300), words(50)
        changed = list(near)
        changed[25] = "other"
        for p in (near, changed):
            head, mid, tail = words(rng.randrange(5, 40)), words(rng.randrange(20, 40)), words(rng.randrange(5, 40))
            first = rng.random() < 0.5
            texts.append(head + (p + mid + licence if first else licence + mid + p) + tail)
            at.append(len(head) if first else len(head) + 300 + len(mid))
    around = lambda k: [frozenset(tuple(texts[k][j : j + 5]) for j in range(i, i + 46)) for i in range(max(0, at[k] - 5), at[k] + 6) if i + 50 <= len(texts[k])]
    want = {i for k in range(0, len(texts), 2) if any(_jaccard(x, y) >= 0.8 for x in around(k) for y in around(k + 1)) for i in (k, k + 1)}
    assert len(want) == len(texts)
    got = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)).collect()
    found = {r["doc_id"] for r in got if r["first_word"] < at[r["doc_id"]] + 25 <= r["last_word"]}
    assert len(found & want) >= 0.95 * len(want)


def test_passage_held_by_copies_in_any_order(spark):
    rng = random.Random(9)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage = words(70)
    copied = " ".join(words(30) + passage + words(30))
    rows = [(9, copied), (5, copied), (2, copied), (7, " ".join(words(40) + passage + words(20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["first_word"], r["last_word"], r["other"]) for r in repeated_passages(docs).collect()}
    assert got == {2: (0, 129, 5), 5: (0, 129, 2), 9: (0, 129, 2), 7: (40, 109, 2)}


@pytest.mark.parametrize(("period", "times"), [(12, 5), (1, 60), (18, 4), (7, 30)])
def test_passage_of_a_repeated_phrase(period, times):
    rng = random.Random(period)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    repeated = words(period) * times
    n = len(repeated) - 4
    for more in ([], words(60)):
        texts = [" ".join(words(a) + repeated + words(40) + more + words(9)) for a in (33, 21)]
        x, y = ((s >> np.uint64(32)).astype("<u4") for s in shingles(texts))
        got = passage(x, y, 80, 46)
        assert got and got[1] - got[0] >= 45 and _jaccard(set(x[got[0] : got[1] + 1]), set(y[got[2] : got[3] + 1])) >= 0.8
        of, sig, first, last = window_runs(shingles(texts), 46)
        side = lambda k: [(g, f, m) for o, g, f, m in zip(of.tolist(), sig.tolist(), first.tolist(), last.tolist(), strict=True) if o == k]
        runs = [(g, a, b, c, d) for g, a, b in side(0) for h, c, d in side(1) if g == h]
        found = compare(x, y, runs, 80, 46)
        assert {i for _, a, b, _, _ in found for i in range(a, b + 1)} >= set(range(33, 33 + n))
        assert {i for _, _, _, a, b in found for i in range(a, b + 1)} >= set(range(21, 21 + n))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert jaccard_components(docs).count() == 0
    assert duplicate_lines(docs).count() == 0
    assert repeated_passages(docs).count() == 0


def test_passages_whatever_goes_past_the_buckets(spark):
    rows = _texts(3)
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, hashes string, first int").repartition(3)
    want = {tuple(r) for r in repeated_passages(docs).select("doc_id", "first_word", "last_word").collect()}
    got = {tuple(r) for r in repeated_passages(docs, local=2).select("doc_id", "first_word", "last_word").collect()}
    assert got == want and len(want) > 20


def test_passages_against_brute_force(spark):
    """Every document with a 46-shingle window of Jaccard 0.8 or more in another one, and no document without."""
    rng = random.Random(4)
    words = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    texts = []
    for _ in range(30):
        p = words(rng.choice([40, 50, 58, 70]))
        for _ in range(2):
            q = list(p)
            for _ in range(rng.choice([0, 1, 1, 3])):
                q[rng.randrange(len(q))] = "other"
            texts.append(words(rng.randrange(20)) + q + words(rng.randrange(20)))
    windows = [[frozenset(tuple(t[j : j + 5]) for j in range(i, i + 46)) for i in range(len(t) - 49)] for t in texts]
    near = lambda x, y: any(_jaccard(p, q) >= 0.8 for p in x for q in y)
    want = {i for i, x in enumerate(windows) if any(near(x, y) for j, y in enumerate(windows) if j in (i ^ 1,))}
    got = {r["doc_id"] for r in repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)).collect()}
    # a passage may be longer than a window and still similar as a whole, so pairs just below 0.8 may be there as well
    assert len(got & want) >= 0.95 * len(want) and len(want) >= 20
    assert all(max(_jaccard(p, q) for p in windows[i] for q in windows[i ^ 1]) >= 0.7 for i in got - want)


def test_passages_of_blocks_in_another_order(spark):
    """Windows of Jaccard 0.84 that neither begin nor end with one shingle, in passages that are no near copies as a whole."""
    rng = random.Random(11)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for k in range(0, 12, 2):
        head, one, two, tail = words(8), words(25), words(25), words(8)
        rows += [(k, " ".join(words(20) + head + one + two + tail + words(20))), (k + 1, " ".join(words(30) + tail + two + one + head + words(10)))]
    x, y = shingles([rows[0][1], rows[1][1]])
    assert near_windows(x, y, 80, 46)[28, 38]
    got = {(r["doc_id"], r["component_id"]) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == {(i, i // 2 * 2) for i, _ in rows}


def test_every_component_of_passages_is_linked(spark):
    """Passages that all have a partner already, in groups that only one pair of windows connects."""
    rng = random.Random(12)
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for g in range(12):
        p = words(80)
        for k in range(4):
            q = list(p)
            # the first two are almost alike, and so are the last two; each of the last has 50 words of the first
            if k > 1:
                q[54:] = far
            else:
                far = words(26)
            rows.append((10 * g + k, " ".join(words(20) + q + words(20))))
    got = {r["doc_id"]: r["component_id"] for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


@pytest.mark.parametrize("values", [4, 30, 300])
def test_windows_are_settled_as_by_brute_force(values):
    """All windows of regions of one signature that have a near copy are found, and components are those of all near pairs."""
    rng = np.random.default_rng(values)
    for _ in range(15):
        base = rng.integers(0, values, 30).astype(np.uint64)
        regions = []
        for _ in range(14):
            r = base[rng.integers(0, 8) : 30 - rng.integers(0, 8)].copy()
            r[rng.integers(0, len(r), rng.integers(0, 4))] = rng.integers(1000, 1004)
            regions.append(np.concatenate([rng.integers(2000, 2020, rng.integers(0, 5)).astype(np.uint64), r]))
        n = len(regions)
        window = [[set(r[s : s + 10].tolist()) for s in range(len(r) - 9)] for r in regions]
        near = {(e, f): [(s, t) for s, a in enumerate(window[e]) for t, b in enumerate(window[f]) if 100 * len(a & b) >= 80 * len(a | b)] for e in range(n) for f in range(n) if e != f}
        for e, f in near:
            assert sorted(near[e, f]) == sorted(map(tuple, np.argwhere(near_windows(regions[e], regions[f], 80, 10)).tolist()))
        ids = np.arange(n)
        got = settle(np.zeros(n, np.int64), ids, ids, ids, np.ones(n, bool), regions, 80, 10)
        found = {(e, s) for e, f, a, b, c, d in got for s in range(a, b + 1)} | {(f, t) for e, f, a, b, c, d in got for t in range(c, d + 1)}
        assert found == {(e, s) for (e, _), some in near.items() for s, _ in some}
        up = {i: {i} for i in range(n)}
        for links, out in (([(e, f) for (e, f), some in near.items() if some], {}), ([(e, f) for e, f, *_ in got], up)):
            out.update({i: {i} for i in range(n)})
            for e, f in links:
                if out[e] is not out[f]:
                    both = out[e] | out[f]
                    out.update(dict.fromkeys(both, both))
            if out is not up:
                want = dict(out)
        assert up == want


def test_settling_compares_only_what_can_be_near(monkeypatch):
    """Phrases that are repeated in each region, and one shingle that all have: no window is near another, and none is compared."""
    from sylvan.llm import substring_dedup

    calls, near_ranges = [], substring_dedup._near_ranges
    monkeypatch.setattr(substring_dedup, "_near_ranges", lambda *a: calls.append(a) or near_ranges(*a))
    regions = []
    for e in range(24):
        # six shingles again and again: 0 is everywhere, three are of half of the regions, two of a third
        phrase = np.array([0, 1 + e % 2, 3 + e % 2, 5 + e % 2, 10 + e % 3, 20 + e % 3], np.uint64)
        regions.append(np.tile(phrase, 4))
    n = np.arange(len(regions))
    got = settle(np.zeros(len(n), np.int64), n, n, n, np.ones(len(n), bool), regions, 80, 10)
    assert {frozenset((e % 6, f % 6)) for e, f, *_ in got} == {frozenset({k}) for k in range(6)}
    assert len({e for e, *_ in got} | {f for _, f, *_ in got}) == len(n)
    assert len(calls) == len({(e, f) for e, f, *_ in got}) <= len(n)


def test_settling_many_near_copies_takes_steps_for_each_and_not_for_pairs():
    """Each of many near copies gets a partner, and those of two components become one, without a step for every pair."""
    rng = np.random.default_rng(8)
    base = np.arange(24, dtype=np.uint64)
    regions = [base.copy() for _ in range(400)]
    for e, r in enumerate(regions):
        r[rng.integers(0, 24)] = 1000 + e // 2
    n = np.arange(len(regions))
    steps = cProfile.Profile()
    got = steps.runcall(settle, np.zeros(len(n), np.int64), n, n, n % 2, np.ones(len(n), bool), regions, 80, 10)
    found = {(e, s) for e, f, a, b, c, d in got for s in range(a, b + 1)} | {(f, t) for e, f, a, b, c, d in got for t in range(c, d + 1)}
    assert found == {(e, s) for e in n for s in range(15)}
    assert any(e % 2 != f % 2 for e, f, *_ in got)
    assert pstats.Stats(steps).total_calls < 1000 * len(n)


def test_settling_near_copies_looks_up_holders_until_windows_are_served(monkeypatch):
    """The tables of holders that settling fills grow with the near copies, and not with the pairs of them."""
    from sylvan.llm import substring_dedup

    class Counted:
        cells = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def zeros(self, shape, *a):
            self.cells += int(np.prod(shape))
            return np.zeros(shape, *a)

    def cells(many):
        rng = np.random.default_rng(8)
        regions = [np.arange(24, dtype=np.uint64) for _ in range(many)]
        for e, r in enumerate(regions):
            r[rng.integers(0, 24)] = 1000 + e // 2
        n, counted = np.arange(many), Counted()
        monkeypatch.setattr(substring_dedup, "np", counted)
        got = settle(np.zeros(many, np.int64), n, n, n * 0, np.ones(many, bool), regions, 80, 10)
        monkeypatch.undo()
        assert {e for e, *_ in got} | {f for _, f, *_ in got} == set(range(many))
        return counted.cells

    assert cells(1600) < 3 * cells(800)


def test_a_window_of_two_signatures_needs_one_partner():
    """The same windows have a partner whether or not signatures know of each other; it may be another one."""
    rng = np.random.default_rng(5)
    for _ in range(15):
        base = rng.integers(0, 200, 40).astype(np.uint64)
        texts = [base.copy() for _ in range(8)]
        for t in texts:
            t[rng.integers(0, 40, 3)] = rng.integers(1000, 1010, 3)
        # two signatures, whose regions overlap
        sig, ids, at = (np.array(v) for v in zip(*[(s, i, a) for s, a in ((0, 0), (1, 8)) for i in range(8)], strict=True))
        regions = [texts[i][a : a + 30] for i, a in zip(ids, at, strict=True)]
        once, both = (settle(sig, ids, ids, ids, np.ones(len(sig), bool), regions, 80, 10, *p) for p in ((at,), ()))
        places = lambda got: {(ids[g], at[g] + s) for e, f, a, b, c, d in got for g, r in ((e, (a, b)), (f, (c, d))) for s in range(r[0], r[1] + 1)}  # noqa: E731, B023
        assert places(once) == places(both)


def test_windows_beside_each_other():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.integers(0, 1 << 60, 120).astype(np.uint64)
        y = np.concatenate([rng.integers(0, 1 << 60, 9).astype(np.uint64), x])
        y[rng.integers(0, len(y), 12)] = 5
        y = np.delete(y, rng.integers(0, len(y), 2))
        found, loose = aligned([x], [y], 80, 46)
        ok = near_windows(x, y, 80, 46)
        for _, a0, a1, b0, b1, *_ in found.tolist():
            assert ok[a0 : a1 - 44].any(axis=1).all() and ok[:, b0 : b1 - 44].any(axis=0).all()
        for _, a, b, c, d in widened([x], [y], loose[:, [0, 5, 6, 7, 8]], 80, 46).tolist():
            p, q = set(x[a : b + 1].tolist()), set(y[c : d + 1].tolist())
            assert 100 * len(p & q) >= 80 * len(p | q) and min(b - a, d - c) >= 45


@pytest.mark.parametrize("most", [5, 40, 400_000])
def test_components_against_brute_force(spark, most):
    rng = random.Random(most)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1060)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(5), most=most).collect())
    up = {}
    for a, b in edges:
        up.setdefault(a, {a}).add(b)
        up.setdefault(b, {b}).add(a)
    for a in got:
        seen, todo = set(), [a]
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += up[n]
        assert got[a] == min(seen)
    assert set(got) == {v for e in edges if e[0] != e[1] for v in e}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 5), (7, 7)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
