"""Token counts by section: each document is encoded once, and its tokens' character spans are joined to sections.

A token belongs to the sections that it overlaps. One that crosses a boundary is allocated by a rule:
  most   to the section that holds most of its characters, the earlier one on a tie (default);
  first  to the section that holds the first of its characters that lies in any section;
  split  in parts, in proportion to the characters that each section holds (counts become fractions).
A character that several tokens share (a character cut into bytes) belongs in part to each; such a token's span is the
characters it touches. Tokens that touch no section count as outside, so counts always add up to the document's.

Sections are intervals [start, end) of characters, lines by default (with their line feed). They may stand in any order
and overlap: of several that hold as much of a token, or the same first character, the earlier one in the list has it.

Defined cases: a null or empty text has no tokens and no sections; an empty section has count 0; repeated rows are
counted each; sections that are null count as none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.byte_bpe import public_vocabulary, read_ranks
from quillstone.llm.common import map_arrow, slices, table

RULES = ("most", "first", "split")
_CODERS: dict[tuple[str, str], tuple] = {}


def _coder(path: str, pattern: str):
    if (path, pattern) not in _CODERS:
        import tiktoken

        ranks = read_ranks(path)
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _CODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _CODERS[path, pattern]


def spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character that each token of the text touches."""
    coder, sizes = _coder(path, pattern)
    ids = np.array(coder.encode_ordinary(text), np.int64)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) == len(text):
        return starts, ends
    character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    return character[starts], character[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens (or parts) of each section [low, high), and how many lie outside: an interval join, by the run of tokens that each section touches."""
    full = np.flatnonzero(highs > lows)
    first = np.searchsorted(ends, lows[full], side="right")  # first token that ends after the section starts
    n = np.maximum(np.searchsorted(starts, highs[full], side="left") - first, 0)
    section = np.repeat(full, n)
    token = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    times = np.bincount(token, minlength=len(starts))
    several = times[token] > 1
    counts = np.bincount(section[~several], minlength=len(lows)).astype(float)
    token, section = token[several], section[several]
    if len(token):
        begin = np.maximum(starts[token], lows[section])
        shared = np.minimum(ends[token], highs[section]) - begin
        if rule == "split":
            total = np.bincount(token, weights=shared, minlength=len(starts))
            np.add.at(counts, section, shared / total[token])
        else:
            order = np.lexsort((section, -shared if rule == "most" else begin, token))
            chosen = order[np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1]))]
            np.add.at(counts, section[chosen], 1)
    return counts, float((times == 0).sum())


def _line_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    return np.concatenate([[0], ends[:-1]]), ends


def attribute(docs: DataFrame, path: str, pattern: str, rule: str = "most", sections: str | None = None) -> DataFrame:
    """doc_id, section (from 0; null: outside), start, end, n_tokens. sections: a column of array<struct<start int, end int>>; lines if none is named. A document without sections or tokens has one row, outside, of what it has."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            ids, number, low, high, tokens = [], [], [], [], []
            given = batch.column("sections").to_pylist() if sections else None
            for d, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                text = text or ""
                if given is None:
                    lows, highs = _line_bounds(text)
                else:
                    own = given[d] or []
                    lows, highs = np.array([s["start"] for s in own], np.int64), np.array([s["end"] for s in own], np.int64)
                counts, outside = allocate(*spans(text, path, pattern), lows, highs, rule)
                ids += [doc_id] * len(lows)
                number += range(len(lows))
                low += lows.tolist()
                high += highs.tolist()
                tokens += counts.tolist()
                if outside or not len(lows):
                    ids.append(doc_id)
                    number.append(None)
                    low.append(None)
                    high.append(None)
                    tokens.append(outside)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(tokens, pa.float64())], ["doc_id", "section", "start", "end", "n_tokens"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(sections).alias("sections")] if sections else []))
    out = map_arrow(chosen, task, "doc_id long, section int, start long, end long, n_tokens double")
    return out if rule == "split" else out.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return attribute(table(spark, sf_dir, "documents"), *public_vocabulary())
