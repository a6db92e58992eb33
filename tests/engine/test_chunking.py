import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import chunking as C
from quillstone.operators import document_tasks as D
from quillstone.plans import answer as A
from quillstone.streaming import ingest


def chunks(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_word_packing(spark):
    assert chunks(spark, "aa bbb cccc d eeeeeeeeeeee", lambda c: C.word_chunks(c, 8)) == ["aa bbb", "cccc d", "eeeeeeeeeeee"]
    assert chunks(spark, "", lambda c: C.word_chunks(c, 8)) == []


def test_paragraph_packing(spark):
    assert chunks(spark, "aaaa\n\nbbbb\n\ncccccccccccccc\n\nd", lambda c: C.paragraph_chunks(c, 12)) == ["aaaa\n\nbbbb", "cccccccccccccc", "d"]


TEXT = (
    "SECTION A - Cover\nThe insured medical coverage pays up to € 500 if the traveler is ill. It is not covered when excluded.\n"
    "ARTICLE 1\na) The policyholder must tell us within 3 days. See section 1 for the limit.\nb) Baggage insurance covers baggage. The baggage insurance needs baggage.\n"
    "Exclusions\nDelay is excluded and the limitation applies to all insured persons who did not tell us in time.\n"
) * 6


def test_invariants_for_every_strategy(spark):
    docs = spark.createDataFrame([(i, TEXT[i * 7 :] if i < 8 else None) for i in range(9)], "doc_id long, text string")
    for name in D.STRATEGIES:
        first = None
        for parts in (1, 4):
            rows = D.chunk_documents(docs.repartition(parts), name).select("doc_id", "chunk_ord", "text", "word_count").collect()
            by = {}
            for r in rows:
                by.setdefault(r.doc_id, []).append(r.chunk_ord)
                assert r.word_count == len(r.text.split())
            assert all(sorted(v) == list(range(len(v))) for v in by.values()) and 8 not in by
            got = sorted((r.doc_id, r.chunk_ord, r.text) for r in rows)
            assert first in (None, got)
            first = got


def test_semantic_keeps_all_words():
    out = D.semantic(TEXT, least=1)
    assert Counter(" ".join(c.text for c in out).split()) == Counter(TEXT.split())
    assert all(int(c.extra["sentences"]) <= 15 for c in out)


def test_sections_take_lines_below_their_heading(spark):
    docs = spark.createDataFrame([(1, "before " * 10 + "\nSECTION A\n" + "x " * 40 + "\nSECTION B\nshort")], "doc_id long, text string")
    assert [(r.title, r.body[:3]) for r in C.sections(docs).orderBy("section").collect()] == [("General Content", "bef"), ("SECTION A", "x x")]
    assert [c.section for c in D.section("SECTION A\n" + "Some words. " * 250)] == ["SECTION A"] * 2


def test_overlap(spark):
    rows = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "e f"), (2, 0, "g")], "doc_id long, chunk_ord int, text string")
    assert [r.text for r in C.with_overlap(rows, 2).orderBy("doc_id", "chunk_ord").collect()] == ["a b c d", "c d e f", "g"]


def test_graph_pieces():
    assert D.merged_spans([(0, 10), (50, 60), (300, 310)]) == [(0, 60), (300, 310)]
    assert D.dense_clusters(np.array([[0.0, 0], [0.1, 0], [5, 5]])) == [[0, 1]]
    assert D.components(4, iter([(0, 1), (2, 3)])) == [[0, 1], [2, 3]]


def test_answers(spark):
    docs = spark.createDataFrame([(1, "p", "Lost baggage is paid up to 500 euro."), (2, "q", "Dogs and cats are welcome here.")], "doc_id long, policy_id string, text string")
    asked = spark.createDataFrame([(1, "Is lost baggage paid?", "p"), (2, "hello there", "p")], "query_id long, question string, policy_id string")
    got = {r.query_id: r for r in A.answer(asked, docs, A.Settings(irrelevant=("hello",), k=1)).collect()}
    assert got[1].outcome == "Yes" and got[1].quote_found and got[1].chunk_ids == ["1_simple_0"]
    assert got[2].outcome == "No - Unrelated event" and got[2].chunk_ids == []


def test_stream_equals_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, TEXT[i:]) for i in range(4)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    ingest.write_stream(ingest.chunk_stream(ingest.document_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    key = lambda df: sorted((r.doc_id, r.chunk_ord, r.text) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(ingest.chunk_stream(docs))


def test_sentence_graph_links_all_pairs_of_an_entity():
    middle = ["Nothing was said about rain in spring.", "Green hills lie far behind our town.", "Many birds sing before dawn breaks."]
    text = " ".join(f"{a} {b}" for a, b in zip([f"Part {w} pays EUR 500 for {w} things." for w in ("one", "two", "three", "four")], [*middle, "They sleep when night falls."]))
    sentences = [s + "." for s in text.rstrip(".").split(". ")]
    low = [s.lower() for s in sentences]
    found = Counter(m.group(0).lower() for p in D._SENTENCE_ENTITY.values() for m in p.finditer(text))
    names = sorted(e for e, c in found.items() if c >= 2)
    assert max(sum(name in s for s in low) for name in names) == 4
    vectors = D.embed([*sentences, *names])
    n, edges = len(sentences), {}
    for i in range(n):
        for j in range(i + 1, n):
            alike = float(vectors[i] @ vectors[j])
            if alike > 0.75:
                edges[i, j] = alike / (1 + (j - i) / 10)
            for name in names:
                if name in low[i] and name in low[j]:
                    edges[i, j] = edges[i, j] + 0.2 if (i, j) in edges else 1.5
            if j == i + 1:
                edges[i, j] = max(edges.get((i, j), 0.0), 0.8)
        for e, name in enumerate(names):
            if name in low[i] and (alike := float(vectors[i] @ vectors[n + e])) > 0.5:
                edges[i, n + e] = alike * 1.5
    size = len({x for e in edges for x in e})
    (got,) = D.semantic_graph(text)
    mean = sum(edges.values()) / len(edges)
    assert got.extra == {"sentences": "8", "mean_weight": f"{mean:.4f}", "density": f"{2 * len(edges) / (size * (size - 1)):.4f}"}
    assert abs(got.confidence - min(mean, 1.0)) < 1e-9


def test_patterns_are_only_tried_where_they_can_match():
    rng = random.Random(2)
    bits = "EUR CHF 500 1,000.50 , . € up to fino a 7 days within 3 hours insured requires covers for medical coverage trip delay if when İf ıf ſubject to not covered except means solo se purché è - ; limited K 5 USD".split(" ")
    kinds = [*D._QUICK_SIGNAL.values(), *D._ENTITY.values(), *D._SENTENCE_ENTITY.values(), *D._RELATION.values()]
    assert all(q.needs for q in kinds) and not any(q.may("thnd onre") for q in kinds)
    for _ in range(300):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))
        for q in kinds:
            assert q.search(text, D._lowered(text)) == bool(q.pattern.search(text))
        for q in kinds[len(D._QUICK_SIGNAL) :]:
            assert [m.group(0) for m in D.matches(q, D.stretches(text))] == [m.group(0) for m in q.pattern.finditer(text)]
