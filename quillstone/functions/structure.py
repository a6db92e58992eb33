"""Structure and quality of texts and tables as expressions: marker repair, reading form, completeness, keywords, tables.

White space means the six ASCII characters without the vertical tab, digits are ASCII, word characters are letters, digits
and the underscore of any script; so the patterns mean the same in Spark and in SQL engines with RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import structure_rules as R


def portable(pattern: str) -> str:
    """A pattern whose classes mean the same in all engines."""
    inside = pattern.replace("[A-Z\\d]", "[A-Z0-9]").replace("*\\d+.)", "*0-9+.)")
    return inside.replace(r"\s", r"[\t\n\f\r ]").replace(r"\d", "[0-9]").replace(r"\w", r"[\p{L}\p{N}_]")


def _rewrite(c: Column, rules, flags: str) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, f"(?{flags}){portable(pattern)}", to.replace("{", "$").replace("}", ""))
    return c


def has(c: Column, pattern: str, flags: str = "iu") -> Column:
    return c.rlike(f"(?d{flags}){portable(pattern)}")


def fixed_markers(c: Column) -> Column:
    """Page markers, headings and sentences that extraction has run together, each on a line of its own."""
    return _rewrite(_rewrite(c, R.MARKER_REWRITES, "dimu"), R.PAGE_REWRITES, "d")


def readable(c: Column) -> Column:
    """One line with a blank after each sentence end and none before a mark or inside a number."""
    return F.trim(_rewrite(c, R.READING_REWRITES, "d"))


def is_list(c: Column) -> Column:
    return has(c, R.LIST_ITEM, "m")


def is_complete(c: Column, kind: Column) -> Column:
    """Does the text end as a sentence or list does, and hold what its kind calls for?"""
    cut = c.endswith("...") | c.endswith("…")
    ended = has(c, r"[.!?]\s*$", "") | is_list(c)
    fits = F.when(kind == "definitions", has(c, R.DEFINES)).when(kind == "procedures", has(c, R.PROCEDURE_OR_HOW)).otherwise(True)
    return ~cut & ended & fits


def is_protected(c: Column, kind: Column) -> Column:
    """Lists, questions with answers, tables, definitions, procedures and terms stay in one piece if they can."""
    marks = lambda m: F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))
    table = (marks("|") >= 4) | (marks("\t") >= 4)
    return has(c, R.LONG_LIST, "m") | has(c, R.QUESTION_ANSWER, "") | table | kind.isin("definitions", "procedures") | has(c, R.DEFINES) | has(c, R.PROCEDURE) | has(c, R.TERMS)


def complexity(c: Column) -> Column:
    """Sections, articles, questions and list items of a text, as high, medium, low or minimal; unknown without text."""
    count = lambda p, flags: F.regexp_count(c, F.lit(f"(?d{flags}){portable(p)}"))
    n = count(R.SECTION_MARKS, "imu") + count(R.ARTICLE_MARKS, "imu") + count(r"\?", "") + count(R.LIST_ITEM, "m")
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").when(n >= 20, "high").when(n >= 10, "medium").when(n >= 5, "low").otherwise("minimal")


def keywords(c: Column, kind: Column, language: Column) -> Column:
    """The kind (unless general) and the terms of the text's language that it holds, sorted, each once."""
    low = F.lower(c)
    terms = F.lit(None)
    for lang, words in R.DOMAIN_TERMS.items():
        terms = F.when(language == lang, F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))).otherwise(terms)
    own = F.when(kind != "general", F.array(kind)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(own, F.coalesce(terms.cast("array<string>"), F.array().cast("array<string>")))))


def ease(words: Column, sentences: Column, listed: Column) -> Column:
    """Ease of reading by words in a sentence, a tenth more with lists; 0 without words."""
    mean = words / sentences
    step = F.when(mean <= 20, 0.9).when(mean <= 30, 0.7).when(mean <= 40, 0.5).otherwise(0.3)
    return F.when((words == 0) | (sentences == 0), 0.0).otherwise(F.least(F.lit(1.0), F.round(step + F.when(listed, 0.1).otherwise(0.0), 6)))


def section_score(title: Column, content: Column, section_id: Column, kind: Column) -> Column:
    """Points of a section: title, content, number, question, kind, length of title."""
    there = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    points = ((there(title), 3), (there(content), 3), (there(section_id), 1), (title.endswith("?"), 1), (kind != "general", 1), (F.length(title).between(50, 200), 1))
    return sum((F.when(F.coalesce(p, F.lit(False)), n).otherwise(0) for p, n in points), F.lit(0)) / 10


def chunk_score(title: Column, content: Column, kind: Column, has_id: Column, orphaned: Column, least: int = 150, best: int = 1000) -> Column:
    """Points of a chunk, 1 at most: a fifth for the title, two for the content, one for its kind, one for wholeness."""
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    words = F.regexp_count(F.coalesce(content, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    t, c = there(title), there(content)
    points = (
        (t, 2), (t & F.length(title).between(10, 100), 1), (t & title.endswith("?"), 1),
        (c, 2), (c & F.length(content).between(least, best), 2), (c & (words >= 20), 1), (c & has(content, "[.!?]", ""), 1), (c & ~F.contains(content, F.lit("...")) & ~F.contains(content, F.lit("…")), 2),
        (kind != "general", 2), (kind.isin("coverage", "exclusions", "definitions", "procedures"), 2),
        (is_complete(content, kind), 2), (has_id, 1), (~orphaned, 1),
    )
    return F.least(F.lit(1.0), sum((F.when(F.coalesce(p, F.lit(False)), n).otherwise(0) for p, n in points), F.lit(0)) / 20)


def chunk_ease(words: Column, sentences: Column, long_words: Column, punctuated: Column) -> Column:
    """Ease of reading of a chunk in tenths: steps by words in a sentence, one more with sentence ends, two less if over a tenth of the words are long."""
    mean = words / sentences
    step = F.when(mean <= 15, 10).when(mean <= 25, 8).when(mean <= 35, 6).otherwise(4)
    tenths = step + punctuated.cast("int") - F.when(10 * long_words > words, 2).otherwise(0)
    return F.when((words == 0) | (sentences == 0), 0.0).otherwise(F.least(F.lit(10), F.greatest(F.lit(0), tenths)) / 10)


def document_title(c: Column) -> Column:
    """The first of the first 15 lines, of 11 to 199 characters, that holds a title word; empty if none does."""
    lines = F.transform(F.slice(F.split(c, "\n"), 1, 15), lambda x: F.trim(x))
    good = F.filter(lines, lambda x: F.length(x).between(11, 199) & F.upper(x).rlike("|".join(R.TITLE_WORDS)))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def converted(c: Column) -> Column:
    """A converted file's text: without NUL and byte order marks, lines trimmed, no blank lines at its ends."""
    bare = F.translate(F.coalesce(c, F.lit("")), "\x00\ufeff", "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(x, r"^[\t\f\r ]+|[\t\f\r ]+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


# ---------------------------------------------------------------- tables


def header(c: Column, index: Column) -> Column:
    """A column's name: without dashes around it, 50 characters at most, Column_i where it is blank."""
    blank = F.concat(F.lit("Column_"), (index + 1).cast("string"))
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\n\f\r ]+", " "))
    bare = F.regexp_replace(F.regexp_replace(text, "^ *[-–—]+ *", ""), " *[-–—]+ *$", "")
    short = F.trim(F.when(F.length(bare) > 50, F.concat(F.substring(bare, 1, 47), F.lit("..."))).otherwise(bare))
    return F.when(F.lower(text).isin("", "nan", "none") | (short == ""), blank).otherwise(short)


def header_row(rows: Column) -> Column:
    """Place of the row, among the first three, that looks most like a header. rows: array of arrays of cells, null where empty."""

    def score(row: Column) -> Column:
        def cell(c: Column) -> Column:
            t = F.trim(c)
            words = F.split(F.regexp_replace(t, "[^A-Za-z]+", " "), " ")
            title = has(t, "[A-Za-z]", "") & F.forall(words, lambda w: (w == "") | (w == F.initcap(w)))
            points = ((has(F.upper(t), "|".join(R.TABLE_HEADER_WORDS), ""), 5), (F.length(t).between(3, 50), 2), (title | ((t == F.upper(t)) & has(t, "[A-Z]", "")), 1), (~F.regexp_replace(t, "[.,]", "").rlike("^[0-9]+$"), 1))
            return sum((F.when(p, n).otherwise(0) for p, n in points), F.lit(0))

        filled = F.filter(row, lambda c: c.isNotNull())
        return F.size(filled) / F.size(row) * 10 + F.aggregate(filled, F.lit(0), lambda a, c: a + cell(c))

    scores = F.transform(F.slice(rows, 1, 3), score)
    return F.when(F.size(rows) <= 1, 0).otherwise(F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def records(rows: Column) -> Column:
    """A table as headers, their row, and records: an array of maps from header to cell, blanks left out.

    Rows and columns without any cell go first; a record without cells goes; of equal headers the last cell counts.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.when(~blank(c), c))), lambda r: F.exists(r, lambda c: c.isNotNull()))

    def narrow(t: Column) -> Column:
        used = F.filter(F.sequence(F.lit(0), F.size(t[0]) - 1), lambda i: F.exists(t, lambda r: F.get(r, i).isNotNull()))
        return F.transform(t, lambda r: F.transform(used, lambda i: F.get(r, i)))

    def read(t: Column) -> Column:
        def of(s: Column) -> Column:
            names = F.transform(F.get(s["t"], s["at"]), header)
            body = F.slice(s["t"], s["at"] + 2, F.greatest(F.size(s["t"]) - s["at"] - 1, F.lit(0)))
            row = lambda r: F.map_from_entries(F.filter(F.transform(F.arrays_zip(names.alias("k"), r.alias("v")), lambda e, i: F.when(e["v"].isNotNull() & ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["k"]), F.struct(e["k"].alias("key"), F.trim(e["v"]).alias("value")))), lambda e: e.isNotNull()))
            kept = F.filter(F.transform(body, row), lambda m: F.size(m) > 0)
            return F.struct(names.alias("headers"), s["at"].alias("header_row"), kept.alias("records"))

        return F.transform(F.array(F.struct(t.alias("t"), header_row(t).alias("at"))), of)[0]

    found = F.transform(F.array(empty), lambda t: F.when(F.size(t) > 0, read(F.transform(F.array(t), narrow)[0])))[0]
    return found


def table_score(headers: Column, rows: Column) -> Column:
    """Points of a table: headers, all different, records, and most cells filled on average."""
    cells = F.aggregate(rows, F.lit(0), lambda a, m: a + F.size(m))
    filled = (F.size(rows) > 1) & (cells / F.size(rows) >= F.size(headers) * 0.7)
    points = F.when(F.size(headers) > 0, F.when(F.size(F.array_distinct(headers)) == F.size(headers), 5).otherwise(3)).otherwise(0)
    return (points + F.when(F.size(rows) > 0, F.when(filled, 5).otherwise(3)).otherwise(0)) / 10
