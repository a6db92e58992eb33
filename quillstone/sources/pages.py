"""Pages and tables of binary documents. No parser is part of this package: one is handed in, a function of a file's bytes.

A parser gives pages: a dict with candidates (texts by one method each, best first), words (text, x0, top), height, and
tables (rows of cells, method, accuracy). Everything after it is DataFrame work on rows of pages, words and tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import structure as S
from quillstone.session import ship

Parser = Callable[[bytes], list[dict]]
MARGIN = 50.0
PAGES = "doc string, page int, candidates array<string>, words array<struct<text:string,x0:double,top:double>>, height double, tables array<struct<rows:array<array<string>>,method:string,accuracy:double>>, error string"


def parsed(files: DataFrame, parser: Parser) -> DataFrame:
    """Pages of files (path, content). A file that the parser fails on is one row with the error and no text."""
    ship(files.sparkSession)
    kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.struct([("text", pa.string()), ("x0", pa.float64()), ("top", pa.float64())])), pa.float64(), pa.list_(pa.struct([("rows", pa.list_(pa.list_(pa.string()))), ("method", pa.string()), ("accuracy", pa.float64())])), pa.string()]
    names = ["doc", "page", "candidates", "words", "height", "tables", "error"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [(path, i + 1, p.get("candidates", []), p.get("words", []), p.get("height"), p.get("tables", []), None) for i, p in enumerate(parser(content))]
                except Exception as e:  # any parser, any error: it becomes data
                    rows = [(path, None, [], [], None, [], f"{type(e).__name__}: {e}")]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(task, PAGES)


def page_texts(pages: DataFrame, marked: bool = True) -> DataFrame:
    """doc, page, text: the first candidate that is not blank, else the words in reading order; marked puts the page number above."""
    first = F.get(F.filter("candidates", lambda c: F.trim(c) != ""), F.lit(0))
    order = F.array_sort(F.transform("words", lambda w: F.struct(w["top"], w["x0"], w["text"].alias("t"))))
    text = F.coalesce(first, F.array_join(F.transform(order, lambda w: w["t"]), " "))
    mark = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), text) if marked else text
    return pages.where("page is not null").select("doc", "page", F.when(text != "", mark).alias("text")).where("text is not null")


def documents(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """doc, text: pages joined in order; a document whose pages are all blank has the empty text."""
    got = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return got.select("doc", F.array_join(F.transform("p", lambda x: x["text"]), separator).alias("text"))


def blocks_text(blocks: Column) -> Column:
    """Text of nested blocks (lines of spans with a text), line by line, blank lines left out."""
    lines = F.flatten(F.transform(blocks, lambda b: F.transform(b["lines"], lambda line: F.array_join(F.transform(line["spans"], lambda s: s["text"]), ""))))
    return F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n")


def is_header_footer(top: Column, height: Column, margin: float = MARGIN) -> Column:
    return (top < margin) | (top > height - margin)


def read_in_order(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, n_words: words (top, x0, text) of each key from the top, then from the left."""
    got = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))).alias("w"))
    return got.select(*keys, F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"), F.size("w").cast("long").alias("n_words"))


def tables(pages: DataFrame, least: dict[str, float] | None = None, adaptive: bool = True) -> DataFrame:
    """doc, page, table_id, method, accuracy, headers, header_row, records, score. least: accuracy that a method needs (0 if not named). adaptive keeps only the first method of a page that has such tables."""
    rows = pages.select("doc", "page", F.posexplode("tables").alias("table_id", "t")).select("doc", "page", "table_id", "t.*")
    need = F.coalesce(F.create_map(*(F.lit(x) for item in least.items() for x in item))[F.col("method")], F.lit(0.0)) if least else F.lit(0.0)
    rows = rows.where(F.col("accuracy") >= need)
    if adaptive:
        first = F.first("method").over(Window.partitionBy("doc", "page").orderBy("table_id"))
        rows = rows.withColumn("first", first).where("method = first")
    read = rows.withColumn("r", S.records(F.col("rows"))).where("r is not null")
    return read.select("doc", "page", "table_id", "method", "accuracy", "r.headers", "r.header_row", "r.records", S.table_score(F.col("r.headers"), F.col("r.records")).alias("score"))


def table_text(rows: Column, least: int = 2) -> Column:
    """Rows of a table as lines of cells apart by tabs; null for tables of fewer than least rows. Blank rows are left out."""
    line = lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), "\t")
    kept = F.filter(F.transform(rows, line), lambda x: F.trim(F.translate(x, "\t", "")) != "")
    return F.when(F.size(rows) >= least, F.array_join(kept, "\n"))


def tables_per_page(found: DataFrame) -> DataFrame:
    return found.groupBy("doc", "page").agg(F.count("*").alias("n_tables"))


def with_tables(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks (doc, page, ...) with the number of tables of their page, 0 where there are none."""
    n = tables_per_page(found)
    return chunks.join(n, ["doc", "page"], "left").withColumn("n_tables", F.coalesce("n_tables", F.lit(0)))


def not_converted(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (path) whose name without extension is not among those done (path): what a batch conversion still has to do."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    return files.withColumn("__stem", stem(F.col("path"))).join(done.select(stem(F.col("path")).alias("__stem")).distinct(), "__stem", "left_anti").drop("__stem")


def conversion_counts(pages: DataFrame) -> DataFrame:
    """Files, and how many were read and failed."""
    per = pages.groupBy("doc").agg(F.max(F.col("error").isNotNull()).alias("failed"))
    return per.agg(F.count("*").alias("total"), F.count_if(~F.col("failed")).alias("success"), F.count_if("failed").alias("failed"))


def section_contents(docs: DataFrame) -> DataFrame:
    """doc_id, header, content: sections below numbered or all-capital headings; of sections of one name the last."""
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    head = F.col("line").rlike(r"^[0-9]+(\.[0-9]+)*[.)]? +\S") | F.col("line").rlike(r"(?d)^[A-Z][A-Z ]{4,}$")
    n = F.sum(F.col("head").cast("int")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.withColumn("head", head).withColumn("n", n).where("n > 0")
    got = numbered.groupBy("doc_id", "n").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("header"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("i", "line")))).alias("b"))
    rows = got.select("doc_id", "n", F.trim("header").alias("header"), F.trim(F.array_join(F.transform("b", lambda x: x["line"]), " ")).alias("content"))
    return rows.groupBy("doc_id", "header").agg(F.max_by("content", "n").alias("content"))
