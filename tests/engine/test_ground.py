import random

from pyspark.sql import functions as F
from quillstone.functions import text as T
from quillstone.operators import document_tasks, ground
from quillstone.operators import ground as G


def test_quotes_are_counted_whatever_their_number(spark):
    rng = random.Random(1)
    words = ["bag", "flight", "lost", "paid", "é", "ab", "abc"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "x" * 50_000 + "needle"]
    quotes = ["bag", "ab", "abc", "lost bag", "needle", "nowhere", "", None, "é a", "bag", "x" * 300]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = {q: n for q in set(quotes) - {None} if (n := sum(t is not None and q in t for t in texts))}
    for most in (1 << 20, 8):
        got = ground.documents_with(spark.createDataFrame([(q,) for q in quotes], "quote string"), docs, most).collect()
        assert {r.quote: r.n for r in got} == want and len(got) == len(want)
    assert ground.documents_with(spark.createDataFrame([], "quote string"), docs).count() == 0


def test_sentence_graph_goes_through_the_whole_text(monkeypatch):
    text = " ".join(f"Article {i % 7} covers the insured person number {i}." for i in range(300))
    whole = document_tasks.semantic_graph(text)
    assert " ".join(c.text for c in whole) == text and len(whole) > 3
    assert [c.text for c in document_tasks.semantic_graph(text, compat=True)] == [whole[0].text]
    more = document_tasks.semantic_graph(text, hierarchical=True)
    assert [c.text for c in more[: len(whole)]] == [c.text for c in whole] and more[-1].cover == "summary"
    monkeypatch.setattr(document_tasks, "ROWS", 7)
    assert [c.extra for c in document_tasks.semantic_graph(text, hierarchical=True)] == [c.extra for c in more]
    assert [c.extra for c in document_tasks.semantic_graph(text)] == [c.extra for c in whole]


def test_windows_of_long_texts_are_compared_in_their_rows(spark):
    words = "a b c d e f g h \x1ci j k l m n o p".split(" ")
    pairs = [(1, " ".join(words), " ".join(words[3:9])), (1, "x " + " ".join(words[:6]), "zz\x0bnothing*"), (2, 'one "two"\nthree\xa0four five', "one two three four five six"), (3, "too short", "too short"), (5, "a b c d e", None)]
    df = spark.createDataFrame(pairs, "doc_id long, text string, source string")
    explode = lambda c: F.posexplode(G.windows(T.tokens(G.sanitise(F.col(c))))).alias("i", "w")
    theirs = df.select("doc_id", explode("source")).select("doc_id", "w").distinct().withColumn("hit", F.lit(True))
    want = df.select("doc_id", explode("text")).join(theirs, ["doc_id", "w"], "left").select("doc_id", "i", F.coalesce("hit", F.lit(False)).alias("hit"))
    assert sorted(G.found_windows(df).collect()) == sorted(want.collect()) and want.where("hit").count() >= 3
    counts = want.groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.count_if("hit").alias("n_found"))
    assert sorted(G.window_counts(df).collect()) == sorted(counts.collect())
    assert sorted(G.found_runs(df).collect()) == sorted(G.quote_runs(want).select("doc_id", "first", "n_words").collect())
    plan = G.window_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
