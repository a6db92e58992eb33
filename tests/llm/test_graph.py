import random

from quillstone.llm.graph import components, rounds_of_stars


def test_components(spark):
    edges = [(1, 2), (2, 1), (2, 3), (5, 4), (9, 9), (None, 1), *((i, i + 1) for i in range(20, 40))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, **{i: 20 for i in range(20, 41)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_paths_take_few_rounds(spark):
    """Pieces of two edges: almost nothing is put together before it meets others."""
    rng = random.Random(5)
    ids = rng.sample(range(10**9), 10_000)
    edges = list(zip(ids, ids[1:]))
    rng.shuffle(edges)
    hub = [(10**9 + 1, 10**9 + 2 + i) for i in range(500)] + [(2 * 10**9 + 600, 2 * 10**9 + i) for i in range(500)]
    stars, rounds = rounds_of_stars(spark.createDataFrame(edges + hub, "a long, b long"), batch_rows=2)
    got = {r.a: r.b for r in stars.collect()}
    assert rounds <= 16
    assert {got[i] for i in ids if i != min(ids)} == {min(ids)} and len(got) == 9_999 + 500 + 500
    assert all(got[10**9 + 2 + i] == 10**9 + 1 for i in range(500)) and got[2 * 10**9 + 600] == 2 * 10**9
