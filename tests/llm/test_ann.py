import numpy as np
import pytest
from quillstone.llm import ann


def exact(vectors, query, own, k):
    scores = sorted(((-float((np.array(v) * np.array(query)).sum()), i) for i, v in vectors if i != own))
    return [(i, -s) for s, i in scores[:k]]


def recall(got, vectors, queries, k=20):
    hits = total = 0
    for i, q in queries:
        want = exact(vectors, q, i, k)
        mine = {r.vec_id for r in got if r.query_id == i}
        hits += len(mine & {w for w, _ in want})
        total += len(want)
    return hits / total


def test_recall_on_the_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = [(r.vec_id, [float(x) for x in r.embedding]) for r in rows.collect()]
    got = ann.query(spark, "/root/testdata/sf0.1").collect()
    queries = [(i, v) for i, v in vectors if i % 20 == 0]
    assert len(got) == 20 * len(queries)
    assert recall(got, vectors, queries) > 0.95
    by = dict(vectors)
    for r in got:
        assert r.score == pytest.approx(float(np.dot(by[r.query_id], by[r.vec_id])), abs=1e-9)


def test_blocks_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELLS", 7 * 9)  # blocks of 9 rows and 9 queries
    monkeypatch.setattr(ann, "TABLES", 4)
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=7).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(120)]
    bad = [(1000, None), (1001, [0.0] * 7), (1002, [float("nan")] * 7), (1003, [float("inf")] + [1.0] * 6), (1004, [None] + [1.0] * 6), (1005, [1.0, 2.0]), (1020, []), (None, [1.0] * 7)]
    rows = spark.createDataFrame([(*v, 1) for v in vectors + bad], "vec_id long, embedding array<double>, score int")
    got = ann.search(rows, rows.where("vec_id % 20 = 0"), k=20).collect()
    queries = [(i, v) for i, v in vectors if i % 20 == 0]
    assert {r.query_id for r in got} == {i for i, _ in queries}
    assert recall(got, vectors, queries) > 0.9
    mine = [(r.vec_id) for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)]
    assert mine == [i for i, _ in exact(vectors, vectors[0][1], 0, 20)]
    more = spark.createDataFrame([(*v, 1) for v in vectors] + [(2000 + i, [float(i), -1.0], 2) for i in range(1, 30)], "vec_id long, embedding array<double>, score int")
    both = [(r.query_id, r.vec_id, r.score) for r in ann.search(more, more.where("vec_id in (0, 2010, 2020)"), k=3).orderBy("query_id", "rank").collect()]
    assert [x[:2] for x in both[:3]] == [(0, i) for i, _ in exact(vectors, vectors[0][1], 0, 3)]
    assert both[3:] == [(2010, 2029, 291.0), (2010, 2028, 281.0), (2010, 2027, 271.0), (2020, 2029, 581.0), (2020, 2028, 561.0), (2020, 2027, 541.0)]
    few = spark.createDataFrame(vectors[:4], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(k + 1, i) for k, (i, _) in enumerate(exact(vectors[:4], vectors[0][1], 0, 20))]
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


def test_large_groups_of_near_copies_are_searched_whole():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[0] + rng.normal(size=(1000, 64)) * 0.05 / 8
    away = -x[:5] + rng.normal(size=(5, 64)) * 0.01
    x = np.concatenate([x, near, away])
    ids = np.arange(len(x))
    quantiser = ann.Quantiser(64).fit(x[::3])
    codes = np.frombuffer(quantiser.pack(quantiser.assign(x)).tobytes(), np.uint8).reshape(len(x), -1)
    asks = np.concatenate([ids[:2000:50], ids[2000:3000:25], ids[3000:]])
    of, found, scores = ann.scan(quantiser, asks, x[asks], ids, x, codes, 20, ann.RERANK)
    for a in asks:
        want = exact(list(enumerate(x)), x[a], a, 20)
        assert found[of == a].tolist() == [i for i, _ in want]
        assert scores[of == a].tolist() == [s for _, s in want]
    # a decoded row of zeros, and fewer rows than k that score above zero, bound nothing
    quantiser.words[:] = 0
    assert ann.scan(quantiser, asks, x[asks], ids, x, codes, 20, ann.RERANK)[1].tolist() == found.tolist()


def test_parallel_error_counts_more():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aware, plain = ann.Quantiser(16), ann.Quantiser(16)
    aware.weight, plain.weight = 3.0, 0.0
    along = []
    for q in (aware, plain):
        codes = q.fit(x).assign(x)
        back = np.stack([q.words[m][codes[:, m]] for m in range(q.parts)], 1).reshape(len(x), -1)[:, :16]
        along.append((((x - back) * x).sum(1) ** 2).mean())
    assert along[0] < 0.8 * along[1]
