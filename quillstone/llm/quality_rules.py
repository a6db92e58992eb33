"""Quality rules: a learned decision list over text statistics, applied as ordered Spark conditional expressions.

Statistics are computed inside each row with built-in functions (no shuffle, no Python). The decision list is fitted by
sequential covering on labelled rows: each rule grows, one threshold at a time, on two thirds of them and is pruned on
the rest; rows it covers leave and the next rule is grown. Growing needs only counts by feature, bin and label, which
Spark sums; the driver sees at most (features x bins x 2) counts for each step. The fitted list becomes one CASE WHEN.

Defined cases: a null text has no words, so it fails the base rule; a document without a label takes no part in
fitting; labels that are null are ignored; a document labelled several times counts once for each label; without both
classes among the labels the list is empty and the base rule alone decides. Other columns of the input pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import BLANKS, let, stored, words_of

WINDOW = 8
#: Labelled documents that are learned from, about.
MOST_ROWS = 200_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that rules may test; each is a name and an expression over the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "shout_ratio": "n_marks / greatest(n_words, 1)",
}


def _covered(hashes: Column) -> Column:
    """Word positions inside windows whose hash occurs twice or more; sorting makes it n log n for any repetition."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        again = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(again, lambda e: e["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1), x + WINDOW) - x))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(let(pairs, starts), total)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the text statistics as long columns; texts are read whole."""
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.length(body) - F.length(F.regexp_replace(body, pattern, ""))

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(repeats).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0)
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    packed = docs.withColumns({"__w": let(words_of(F.col(text)), windows), "__l": of_lines})
    return packed.withColumns(
        {
            **{c: F.col("__w")[c] for c in ("n_words", "word_chars", "n_repeat_words")},
            **{c: F.col("__l")[c] for c in ("n_lines", "n_dup_lines")},
            "n_symbols": count(r"[#*$%&|<>]").cast("long"),
            "n_upper": count(r"\p{Lu}").cast("long"),
            "n_marks": count("[!?]").cast("long"),
        }
    ).drop("__w", "__l")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    bad: int = 0  #: labelled rows set aside for pruning that it covers, and how many of them are good
    good: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return f"{' and '.join(map(str, self.tests))} ({self.bad} bad, {self.good} good set aside)"


def _edges(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Candidate thresholds of each feature: its quantiles, and the smallest value above its minimum (ratios are often zero)."""
    probs = [i / bins for i in range(1, bins)]
    aggs = []
    for name, e in FEATURES.items():
        aggs += [F.percentile_approx(F.expr(e), probs, 10_000).alias(f"q_{name}"), F.min(F.when(F.expr(e) > 0, F.expr(e))).alias(f"m_{name}")]
    got = rows.agg(*aggs).first()
    return {n: sorted({x for x in (*(got[f"q_{n}"] or []), got[f"m_{n}"]) if x is not None}) for n in FEATURES}


def _histogram(rows: DataFrame, edges: dict[str, list[float]]) -> dict[tuple[str, int, bool], list[int]]:
    """Counts of bad and good rows by feature, bin and part (grow or prune): one pass, summed before it is shuffled."""
    cells = []
    for name, cuts in edges.items():
        e = F.expr(FEATURES[name])
        place = sum(((e >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
        cells.append(F.struct(F.lit(name).alias("f"), place.alias("b")))
    got = rows.select("bad", "prune", F.explode(F.array(*cells)).alias("c")).groupBy("c.f", "c.b", "prune").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    return {(r["f"], r["b"], r["prune"]): [r["p"], r["n"]] for r in got.collect()}


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    from math import log2

    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p and p0 else 0.0


def _grow(rows: DataFrame, edges: dict[str, list[float]], longest: int, least: int) -> tuple[list[Test], list[tuple[int, int]]]:
    """Add the test of greatest information gain until no bad row is confused with a good one; also prune counts after each."""
    tests: list[Test] = []
    pruned: list[tuple[int, int]] = []
    while len(tests) < longest:
        now = rows
        for t in tests:
            now = now.where(t.column())
        counts = _histogram(now, edges)

        def side(name: str, k: int, above: bool, prune: bool, counts=counts) -> tuple[int, int]:
            bins = range(k + 1, len(edges[name]) + 1) if above else range(k + 1)
            got = [counts.get((name, b, prune), (0, 0)) for b in bins]
            return sum(x[0] for x in got), sum(x[1] for x in got)

        any_name = next(iter(edges))
        everything = [counts.get((any_name, b, False), (0, 0)) for b in range(len(edges[any_name]) + 1)]
        p0, n0 = sum(x[0] for x in everything), sum(x[1] for x in everything)
        if p0 < least or (tests and n0 == 0):
            break
        options = []
        for name, cuts in edges.items():
            for k, cut in enumerate(cuts):
                for above in (True, False):
                    p, n = side(name, k, above, False)
                    if p >= least:
                        options.append((_gain(p, n, p0, n0), p, name, above, cut, k))
        best = max(options, default=(0.0,), key=lambda o: (o[0], o[1] if len(o) > 1 else 0))
        if best[0] <= 0:
            break
        _, _, name, above, cut, k = best
        tests.append(Test(name, above, float(cut)))
        pruned.append(side(name, k, above, True))
    return tests, pruned


def fit(labelled: DataFrame, *, most_rows: int = MOST_ROWS, most_rules: int = 6, longest: int = 3, bins: int = 16, least: int = 8, precision: float = 0.9) -> list[Rule]:
    """Learn rules that reject. labelled: the statistics and an integer column bad (1: reject), plus a key column doc_id.

    most_rows bounds the labelled sample, taken by a hash of doc_id. A rule is kept if, on the rows set aside for
    pruning, at least the share precision of what it covers is bad; so clean documents stay.
    """
    total = labelled.count()
    share = min(1.0, most_rows / max(total, 1))
    key = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1_000_000))
    rows = labelled.where(key < F.lit(int(share * 1_000_000))) if share < 1 else labelled
    rows = rows.withColumn("prune", F.pmod(F.xxhash64(F.lit(29), F.col("doc_id")), F.lit(3)) == 0)
    rules: list[Rule] = []
    edges = _edges(rows, bins) if total else {}
    while total and len(rules) < most_rules:
        tests, pruned = _grow(rows, edges, longest, least)
        if not tests:
            break
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in pruned]
        cut = worth.index(max(worth))
        p, n = pruned[cut]
        if p + n == 0 or p / (p + n) < precision:
            break
        rules.append(Rule(tuple(tests[: cut + 1]), p, n))
        rows = rows.where(~rules[-1].column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional: base rule first, then each learned rule, else kept."""
    out = F.when(F.coalesce(base_failed(), F.lit(True)), F.lit(False))
    for r in rules:
        out = out.when(F.coalesce(r.column(), F.lit(False)), F.lit(False))
    return out.otherwise(F.lit(True))


def _marked(labels: DataFrame, most_rows: int) -> DataFrame:
    """doc_id and bad of labelled documents, each label of a document once; about most_rows of them at most, by hash of doc_id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") == 0).cast("int").alias("bad")).distinct()
    known = stored(known, "quality-marked")
    total = known.count()
    share = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1_000_000)) < F.lit(int(most_rows / max(total, 1) * 1_000_000))
    return known if total <= most_rows else known.where(share)


def judge(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, **options) -> tuple[DataFrame, list[Rule]]:
    """Statistics and verdict of every row of docs (doc_id and the statistics, without texts), and the rules fitted on labels."""
    stats = stored(statistics(docs.select("doc_id", "text")).drop("text"), "quality-stats")
    rules = fit(stored(stats.join(F.broadcast(_marked(labels, most_rows)), "doc_id").where(~base_failed()), "quality-labelled"), most_rows=most_rows, **options)
    return stats.withColumns({"base_failed": base_failed(), "kept": verdict(rules)}), rules


def keep(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, **options) -> DataFrame:
    """Documents that the rules keep, with their own columns.

    No text is shuffled: the labelled sample, bounded by most_rows, is broadcast to the texts it needs the statistics of,
    and those of the rows to judge are computed beside the text again.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(_marked(labels, most_rows)), "doc_id")
    rules = fit(stored(statistics(marked).drop("text").where(~base_failed()), "quality-labelled"), most_rows=most_rows, **options)
    inner = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text"))
    return statistics(inner, "__text").where(verdict(rules)).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from quillstone.llm.common import table

    rows, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *BASE, "base_failed", "kept")
