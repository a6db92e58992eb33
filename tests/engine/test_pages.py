import random
import re

from pyspark.sql import functions as F
from quillstone.functions import structure as S
from quillstone.operators import splitting as P
from quillstone.sources import pages


def reader():
    """A stand-in for a parser: pages apart by form feeds, tables as lines with bars."""

    def read(content):
        if content == b"broken":
            raise ValueError("no pages")
        out = []
        for page in content.decode().split("\f"):
            words = [{"text": w, "x0": float(i % 3), "top": float(i // 3)} for i, w in enumerate(page.split())]
            rows = [[c.strip() or None for c in line.split("|")] for line in page.split("\n") if "|" in line]
            tables = [{"rows": rows, "method": "lattice", "accuracy": 90.0}, {"rows": rows, "method": "stream", "accuracy": 70.0}] if rows else []
            out.append({"candidates": ["", page if not page.startswith("~") else " "], "words": words[::-1], "height": 800.0, "tables": tables})
        return out

    return read


def test_pages_tables_and_errors(spark):
    files = spark.createDataFrame([("f/a.pdf", bytearray(b"one two\f~three four five six\f")), ("f/b.pdf", bytearray(b"broken")), ("f/c.pdf", bytearray("Name|Amount|\nbag||7\ntrip|5|\n||".encode()))], "path string, content binary")
    found = pages.parsed(files, reader())
    texts = {r.doc: r.text for r in pages.documents(pages.page_texts(found)).collect()}
    assert texts["f/a.pdf"] == "--- Page 1 ---\none two\n--- Page 2 ---\n~three four five six" and "f/b.pdf" not in texts
    assert [r.error for r in found.where("doc = 'f/b.pdf'").collect()] == ["ValueError: no pages"]
    assert pages.conversion_counts(found).first().asDict() == {"total": 3, "success": 2, "failed": 1}
    got = pages.tables(found).collect()
    assert [(r.doc, r.method, r.headers, r.records) for r in got] == [("f/c.pdf", "lattice", ["Name", "Amount", "Column_3"], [{"Name": "bag", "Column_3": "7"}, {"Name": "trip", "Amount": "5"}])]
    assert got[0].score == 0.8 and pages.tables(found, {"lattice": 95.0, "stream": 60.0}).first().method == "stream"
    assert pages.tables(found, adaptive=False).count() == 2
    assert found.where("size(tables) > 0").select(pages.table_text(F.col("tables")[0]["rows"])).first()[0] == "Name\tAmount\t\nbag\t\t7\ntrip\t5\t"
    chunks = spark.createDataFrame([("f/c.pdf", 1, "x"), ("f/a.pdf", 1, "y")], "doc string, page int, text string")
    assert {r.doc: r.n_tables for r in pages.with_tables(chunks, pages.tables(found)).collect()} == {"f/c.pdf": 1, "f/a.pdf": 0}
    assert [r.path for r in pages.not_converted(files, spark.createDataFrame([("g/a.txt",), ("g/b.txt",)], "path string")).collect()] == ["f/c.pdf"]


def test_table_edges(spark):
    rows = spark.createDataFrame([(1, []), (2, [[None, " "], [None, None]]), (3, [["a", "b"]]), (4, [["x", "x"], ["1", "2"], [None, "3"]]), (5, None)], "id int, rows array<array<string>>")
    got = {r.id: r.t for r in rows.select("id", S.records(F.col("rows")).alias("t")).collect()}
    assert got[1] is None and got[2] is None and got[5] is None
    assert (got[3].headers, got[3].records) == (["a", "b"], [])
    assert got[4].records == [{"x": "2"}, {"x": "3"}]


def test_splitting_loses_nothing_and_keeps_to_sizes():
    rng = random.Random(3)
    words = ["cover", "loss", "and", "the", "Insured", "pays", "which", "sum", "therefore", "bag"]
    limits = P.Limits(least=40, best=120, most=200, overlap=0)
    for kind in ("general", "coverage", "exclusions", "procedures", "definitions"):
        for n in (5, 60, 400):
            text = " ".join(rng.choice(words) + (rng.choice([". ", ", ", "; ", "\n\n", " "]) if rng.random() < 0.2 else "") for _ in range(n)).strip()
            chunks = P.split(text, kind, limits)
            squash = lambda s: re.sub(r"[\s.]+|;(?=\s|$)", "", s).replace(";", "")
            assert squash("".join(chunks)) == squash(text), (kind, n)
            if kind in ("general", "coverage") and not P.is_protected(text, kind):
                assert max(map(len, chunks)) <= limits.most + limits.least + 2
    assert P.split("", "general", limits) == [""] and P.split("x" * 500, "general", limits)


def test_sentences_tails_and_halves():
    assert P.sentences("The red bag is lost. The claim is paid in full! What is owed then? Nothing more is owed") == ["The red bag is lost.", "The claim is paid in full!", "What is owed then?", "Nothing more is owed"]
    assert P.halves("aaaa bbbb cccc") == ["aaaa bbbb...", "cccc"]
    text = "The first rule is long enough to count. " * 6 + "The last rule stands here."
    assert P.tail(text, 60, "general") == "The last rule stands here." and P.tail("short", 60, "general") == ""
    assert P.whole_sentences("The bag is lost today. The claim is paid in full. The rest of it is still") == "The bag is lost today. The claim is paid in full."
    limits = P.Limits(least=30, best=50, most=90, overlap=40)
    parts = P.split("The first rule is that bags count. " * 8, "general", limits)
    assert any("[goes on]" in p for p in parts)
