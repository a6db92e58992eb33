import zlib

import numpy as np
import pyarrow as pa

from quillstone.llm import language_id as l


def naive(text):
    out = []
    b = bytes(l._LETTERS[c] for c in text.lower().encode())
    framed = b" " + b + b" "
    for n in l.GRAMS:
        for i in range(len(framed) - n + 1):
            g = framed[i : i + n]
            if 32 in g[1:-1] or (n == 2 and g == b"  "):
                continue
            v = int.from_bytes(g, "little")
            h = (v * 2654435761 & 0xFFFFFFFF) ^ (0x85EBCA6B * n & 0xFFFFFFFF)
            out.append(((h ^ (h >> 15)) * 0x846CA68B & 0xFFFFFFFF) >> 16)
    return sorted(out)


def test_features_equal_a_plain_loop():
    texts = ["Hello, World 42", None, "", "été à Noël", "x", "a b", "  ", "Straße"]
    buckets, bounds = l.features(pa.array(texts))
    for d, t in enumerate(texts):
        assert sorted(buckets[bounds[d] : bounds[d + 1]].tolist()) == [x for x in naive(t or "")]


def test_held_out_accuracy_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    model = l.fit(docs.where(~l.held_out()), per_language=80)
    got = {r.doc_id: r for r in l.predict(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 1), (2, "le chat et le chien", "fr", 2), (3, None, "en", 3), (4, "12 34!", None, 4), (5, "", "fr", 5), (None, "le chat", None, 6)], "doc_id long, text string, lang string, score int")
    model = l.fit(docs)
    got = {r.doc_id: r for r in l.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"]
    assert got[3].score == 0 and got[4].rejected
    assert {r.lang_pred for r in l.predict(docs, l.fit(docs.limit(0))).collect()} == {"und"}


def test_predictions_equal_a_plain_loop(spark):
    """Scores by a loop over subwords, temperature and rejection included."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    model = l.fit(docs, per_language=40)
    texts = [(1, "The weather was fine and we went home."), (2, "Le temps était beau."), (3, "zqx vvv kkj"), (4, "ein Haus\nund ein Garten"), (5, "a"), (6, "été " * 5000)]
    got = {r.doc_id: r for r in l.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, text in texts:
        subwords = naive(text)
        mean = np.sum([model.table[b].astype(float) for b in subwords], axis=0) / len(subwords) if subwords else np.zeros(len(model.languages))
        z = (mean + model.bias) / model.temperature
        chance = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(got[i].score - chance.max()) < 1e-5 and got[i].lang_pred == model.languages[int(chance.argmax())]
        assert got[i].rejected == (got[i].score < model.reject_below)


def test_calibration_and_rejection_on_held_out_texts(spark):
    """What is not rejected is right nearly always; what is in no language that was learned is mostly rejected."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = l.fit(docs.where(~l.held_out()), per_language=80)
    held = l.predict(docs.where(l.held_out()), model).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    sure = [r for r in held if not r.rejected]
    assert len(sure) > 0.8 * len(held) and np.mean([r.lang_pred == r.lang for r in sure]) >= 0.98
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == r.lang for r in held])) < 0.1
    rng = np.random.default_rng(3)
    strange = [(i, " ".join("".join(rng.choice(list("qxzjkvwy"), rng.integers(3, 9))) for _ in range(8))) for i in range(60)]
    found = l.predict(spark.createDataFrame(strange, "doc_id long, text string"), model).collect()
    assert np.mean([r.rejected for r in found]) > np.mean([r.rejected for r in held])


def test_rows_that_repeat_are_learned_once(spark):
    rows = [(1, "the cat and the dog", "en")] * 400 + [(i, f"le chat {i} et le chien", "fr") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(l.fit(docs, per_language=1000).languages) == {"en", "fr"}
