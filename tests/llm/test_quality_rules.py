import random
import re
from collections import Counter

from quillstone.llm import quality_rules as q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def texts():
    rng = random.Random(2)
    yield from (None, "", " \n\t ", "a", "a b\x0bc\x0cd\re", "é" * 9, "line\nline\n\nline \nline", "x " * 40, "a b c d e f g h " * 3 + "z", "<a> & | #")
    words = [f"w{i}" for i in range(12)]
    for n in (7, 8, 9, 40, 200):
        for k in (2, 12):
            yield " ".join(rng.choice(words[:k]) for _ in range(n)) + "\n" * rng.randint(0, 3)
    yield " ".join(f"u{i}" for i in range(300)) + " " + " ".join(f"u{i}" for i in range(100, 140))


def test_statistics_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in q.statistics(docs).collect():
        assert tuple(r[c] for c in q.BASE) == brute(rows[r.doc_id][1]), rows[r.doc_id]


def corpus(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(90)]
    junk = [" ".join(word() + "###" for _ in range(60)) for _ in range(60)] + [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "n", 1) for i, t in enumerate(clean + junk)]
    docs = spark.createDataFrame([*rows, (500, None, None, None), (500, "too short", "s", 2), (None, clean[0], "t", 3)], "doc_id long, text string, n_words string, kept int")
    labels = [(i, int(i < 90), 0) for i in range(len(rows)) if i % 3] + [(3, None, None), (None, 0, 0), (999, 0, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_list_rejects_junk_and_keeps_clean(spark):
    docs, labels = corpus(spark)
    got, rules = q.judge(docs, labels)
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert rules and kept >= set(range(90)) | {None} and len(kept & set(range(90, 210))) <= 6
    assert got.where("doc_id = 500").where("base_failed and not kept").count() == 2
    assert [str(r) for r in q.judge(docs, labels)[1]] == [str(r) for r in rules]


def test_keep_returns_the_input_columns(spark):
    docs, labels = corpus(spark)
    out = q.keep(docs, labels)
    assert out.columns == docs.columns and 91 <= out.count() <= 97
    assert out.where("doc_id is null and n_words = 't' and kept = 3").count() == 1


def test_without_labels_the_base_rule_decides(spark):
    docs, labels = corpus(spark)
    got, rules = q.judge(docs, labels.limit(0))
    assert rules == [] and got.where("kept = base_failed").count() == 0
    assert q.judge(docs.limit(0), labels)[0].count() == 0
