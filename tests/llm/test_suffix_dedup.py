import hashlib
import random

import numpy as np
import pytest

from quillstone.llm import deep_shallow, suffix_dedup


def brute(rows, length):
    """Remove each byte covered by a string that starts earlier, by a dictionary of all strings."""
    docs = sorted({(i if i is not None else 1 << 63, t or "") for i, t in rows})
    seen, out = set(), {}
    for i, t in docs:
        data = t.encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = [True] * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        n_spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[None if i == 1 << 63 else i, t] = (len(data), sum(gone), n_spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "a" * 400), (4, "ab" * 300), (5, "a" * 250 + "b" + "a" * 250), (None, shared[0])]
    for i in range(6, 60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a:], text(rng.randint(0, 25))]
        rows.append((i, "".join(parts)))
    for i in range(60, 80):  # near copies
        t = list(rows[rng.randint(6, 59)][1] or "x")
        t[rng.randrange(len(t))] = "#"
        rows.append((i, "".join(t)))
    rows += [(80, rows[10][1]), (80, rows[10][1])]  # an exact copy in a repeated row
    return rows


@pytest.mark.parametrize("chunk", [suffix_dedup.CHUNK, 300])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = corpus(chunk)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 100)
    got = suffix_dedup.digest(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(want[i, t or ""])
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in by[r.doc_id], r


def test_remove_keeps_columns(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    docs = spark.createDataFrame([(1, "x" + passage, "u", 7), (2, "y " + passage + " tail", None, 8), (3, None, "w", 9)], "doc_id long, text string, source string, __id int")
    got = {r.doc_id: r for r in suffix_dedup.remove(docs.withColumnRenamed("__id", "size")).collect()}
    assert got[1].text == "x" + passage and got[2].text == "y  tail" and got[3].text is None
    assert got[2].size == 8


def test_empty(spark):
    assert suffix_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sort_orders_and_measures():
    rng = np.random.default_rng(1)
    for n, length, letters in ((0, 10, 2), (1, 10, 2), (50, 20, 2), (500, 100, 2), (300, 76, 4)):
        m = rng.integers(97, 97 + letters, (n, length)).astype(np.uint8)
        if n > 100:
            m[rng.integers(0, n, n // 2)] = m[rng.integers(0, n, n // 2)]
            for i in rng.integers(0, n, n // 3):
                m[i] = m[0]
                m[i, rng.integers(10, length)] = 97
        order, common = deep_shallow.sort(m)
        placed = [m[i].tobytes() for i in order]
        assert placed == sorted(placed)
        for a, b, k in zip(placed, placed[1:], common[1:].tolist()):
            assert a[:k] == b[:k] and (k == length or a[k] != b[k])


def test_keys_part_one_gram_with_many_contexts():
    """Contexts around one gram: only windows that are equal in all bytes repeat, whichever side they reach to."""
    rng = np.random.default_rng(6)
    n, reach, length = 400, 76, 100
    strings = rng.integers(97, 99, (n, reach + length)).astype(np.uint8)
    strings[:, reach : reach + 24] = 120
    for i in range(0, n, 4):  # each fourth shares a stretch around the gram with the first
        a, b = rng.integers(0, reach + 1), rng.integers(reach + 24, reach + length + 1)
        strings[i, a:b] = strings[0, a:b]
    ids, tags, places = np.arange(n), np.zeros(n, np.int64), np.full(n, 1000, np.uint32)
    least, most = np.zeros(n, np.uint8), np.full(n, reach, np.uint8)
    want = np.zeros((n, reach + 1), bool)
    seen = set()
    for i in range(n):
        for o in range(reach + 1):
            w = o, strings[i, reach - o : reach - o + length].tobytes()
            want[i, o] = w in seen
            seen.add(w)
    assert 0 < want.sum() < want.size / 2
    whole = suffix_dedup.repeats(strings[:, :reach][:, ::-1], strings[:, reach:], ids, tags, places, least, most)
    assert (whole == want).all()
    sides = suffix_dedup._Sides(length, 24)
    for kind in (suffix_dedup.LEFT, suffix_dedup.RIGHT):
        low, high = sides.offsets(kind, least, most)
        before = sides.before[kind]
        part = sides.part(kind, strings)
        found = np.zeros_like(want)
        keys = sides.key(kind, strings)
        assert len(np.unique(keys)) > n // 2
        for some in suffix_dedup._runs(keys, 20):
            found[some, : before + 1] = suffix_dedup.repeats(part[some][:, :before][:, ::-1], part[some][:, before:], *(x[some] for x in (ids, tags, places, low, high)))
        offsets = slice(int(low.min()), int(high.max()) + 1)
        assert (found[:, offsets] == want[:, offsets]).all()
