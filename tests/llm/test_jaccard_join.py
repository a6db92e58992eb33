import random
import re

import numpy as np
import pytest

from quillstone.llm import jaccard_join


def shingle_set(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, num, den):
    sets = [shingle_set(t, size) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, len(s), least.get(c) if s else i) for (i, _), s, c in zip(rows, sets, comp)), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["w%d" % rng.randrange(300) for _ in range(3000)]
    passage = words[:120]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A B"), (8, "a b c"), (None, "a  b\tc"), (9, "a b c d"), (None, None)]
    for i in range(10, n):
        k = rng.randrange(2000)
        w = words[k : k + rng.randint(3, 150)]
        if rng.random() < 0.4:
            w = passage[: rng.randint(5, 120)] + w[:20]
        if i > 20 and rng.random() < 0.6:
            w = (rng.choice(rows[11:])[1] or "x").split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "new%d" % rng.randrange(50)
        rows.append((i, " ".join(w)))
    return rows + [(n - 1, rows[-1][1])]


@pytest.mark.parametrize(("size", "num", "den", "task"), [(3, 9, 10, 3_000_000), (5, 8, 10, 300), (2, 5, 10, 3_000_000)])
def test_equals_brute_force(spark, size, num, den, task):
    rows = corpus(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_join.join(docs, size, num, den, task).collect()), key=str)
    assert got == brute(rows, size, num, den)


@pytest.mark.parametrize(("size", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_large_groups_in_blocks(spark, size, num, den):
    """Near copies of one text, a chain that drifts away from it, and texts that share half with it, in families far beyond a task."""
    rng = random.Random(size)
    base = ["w%d" % rng.randrange(5000) for _ in range(120)]
    rows = []
    for i in range(160):
        w = base[:]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(900)
        rows.append((3 * i, " ".join(w)))
    drift = base[:]
    for i in range(40):
        drift[(5 * i) % 120] = "y%d" % i
        rows.append((3 * i + 1, " ".join(drift)))
    for i in range(60):
        rows.append((3 * i + 2, " ".join(base[: rng.randint(90, 112)] + ["z%d" % rng.randrange(9000) for _ in range(rng.randint(0, 16))])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_join.join(docs, size, num, den, 1500).collect()), key=str)
    assert got == brute(rows, size, num, den)


def test_common_phrases_make_no_large_family(spark, monkeypatch):
    """Short unrelated texts share phrases of common words with many others; that alone does not put them into one family."""
    rng = random.Random(8)
    common, weights = ["c%d" % i for i in range(12)], [1 / (i + 1) for i in range(12)]
    rows = []
    for i in range(500):
        w = [rng.choices(common, weights)[0] if rng.random() < 0.6 else "r%d" % rng.randrange(10**9) for _ in range(rng.randint(20, 45))]
        rows.append((2 * i, " ".join(w)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join([*w, "end"])))
    large = []
    monkeypatch.setattr(jaccard_join, "_large_families", lambda df, *_: large.append(df.count()) or df.selectExpr("key a", "key b").limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_join.join(docs, 3, 9, 10, 1500).collect()), key=str)
    assert not large
    assert got == brute(rows, 3, 9, 10)


def test_asked_prefix_lengths_follow_cost():
    bound = jaccard_join.Bound(8, 10)
    places = np.arange(60)
    rare_first = np.array([2] * 21 + [500] * 39)
    rare_last = np.array([500] * 25 + [2] * 35)
    short, kept = jaccard_join.asked(200, places, rare_first, bound)
    assert len(kept) == int(bound.prefix(200, short)) - short + 1
    long, _ = jaccard_join.asked(200, places, rare_last, bound)
    assert short < long
    assert jaccard_join.asked(200, places[:0], rare_first[:0], bound) is None


def test_spanning_links_on_many_candidates():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    sets = []
    for _ in range(400):
        own = rng.choice(base, rng.integers(150, 190), replace=False)
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 60, 8).astype(np.uint64)])))
    keys = [b"%05d" % i for i in range(len(sets))]
    bound = jaccard_join.Bound(8, 10)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if bound.linked(common, len(sets[i]), len(sets[j])):
                a, b = find(keys[i]), find(keys[j])
                parent[max(a, b)] = min(a, b)
    want = {k: find(k) for k in keys if find(k) != k}
    assert dict(jaccard_join.spanning_links(keys, sets, bound)) == want


def test_one_of_each_keeps_columns(spark):
    text = " ".join("w%d" % i for i in range(60))
    docs = spark.createDataFrame([(1, text, "a", 1), (2, text + " more", "b", 2), (3, None, None, 3), (None, text, "c", 4), (5, "else", "d", 5)], "doc_id long, text string, component_id string, n long")
    kept = {(r.doc_id, r.component_id, r.n) for r in jaccard_join.one_of_each(docs).collect()}
    assert kept == {(1, "a", 1), (3, None, 3), (None, "c", 4), (5, "d", 5)}


def test_one_of_each_decides_by_row(spark):
    text, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "wxy")
    rows = [(7, other, "a"), (7, text + " more", "b"), (2, text, "c"), (2, text, "c"), (4, third, "d"), (4, third + " end", "e"), (9, "", "f"), (9, "", "f"), (11, "alone here", "g"), (11, "alone here", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r.doc_id, r.source) for r in jaccard_join.one_of_each(docs).collect())
    assert [k for k in kept if k[0] != 4] == [(2, "c"), (7, "a"), (9, "f"), (9, "f"), (11, "g")]
    assert len([k for k in kept if k[0] == 4]) == 1


def test_empty(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
