"""Connected components of an edge table, by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import discard, map_arrow, stored

#: Edges that a task puts together before it passes on a spanning star of each piece.
BATCH = 300_000


def _forest(a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    """Each node of edges that is not the least of its piece, with the one that is."""
    coded = pa.concat_arrays([a, b]).dictionary_encode()
    values = coded.dictionary
    order = pc.sort_indices(values).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[coded.indices.to_numpy()]
    parent = list(range(len(order)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for x in range(len(parent)):  # parents come first
        parent[x] = parent[parent[x]]
    least = np.array(parent, np.int64)
    some = np.flatnonzero(least != np.arange(len(least)))
    return pa.RecordBatch.from_arrays([values.take(pa.array(order[some])), values.take(pa.array(order[least[some]]))], ["a", "b"])


def _stars(batch_rows: int):
    """Edges as (larger, least node of the piece): of each run of batch_rows edges only a spanning forest of stars is left."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                held.append(batch.slice(start, batch_rows))
                size += held[-1].num_rows
                if size >= batch_rows:
                    yield _forest(*(pa.concat_arrays([x.column(c) for x in held]) for c in ("a", "b")))
                    held, size = [], 0
        if held:
            yield _forest(*(pa.concat_arrays([x.column(c) for x in held]) for c in ("a", "b")))

    return task


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def rounds_of_stars(edges: DataFrame, batch_rows: int = BATCH) -> tuple[DataFrame, int]:
    """Edges (a, b), a != b, as stars (node, least node of its component), and how many rounds that took.

    A round ties each node's larger neighbours to the least of its neighbourhood, then its smaller ones and itself. Both
    keep the components, edges never grow in number, and paths and hubs shorten by a factor: rounds follow the logarithm
    of the number of nodes. It ends when a round changes nothing, or with the one task that all edges left fit into.
    """
    kind = dict(edges.dtypes)["a"]
    pieces = lambda e: map_arrow(e, _stars(batch_rows), f"a {kind}, b {kind}").distinct()
    now, rounds = stored(pieces(edges), "cc-edges"), 0
    before = _state(now)
    while before[0]:
        if before[0] <= batch_rows:
            last = stored(map_arrow(now.coalesce(1), _stars(batch_rows), f"a {kind}, b {kind}"), "cc-edges")
            discard(now)
            return last, rounds + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(pieces(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))), "cc-edges")
        discard(now)
        now, rounds, after = new, rounds + 1, _state(new)
        if after == before:
            break
        before = after
    return now, rounds


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node it reaches.

    Rounds are written to the shared folder and the one before is removed. Null ends are ignored, self-loops and repeated
    edges do no harm, an empty table gives no rows. Tasks pass on spanning stars of what they read, so a hub or a large
    group is a few edges a task; what is left of a hub's join is split by adaptive execution.
    """
    clean = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    stars, _ = rounds_of_stars(clean.where(F.col("a") != F.col("b")))
    loops = clean.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("a").alias("root"))
    own = stars.select(F.col("b").alias("node"), F.col("b").alias("root"))
    named = stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own).unionByName(loops)
    labels = stored(named.groupBy("node").agg(F.min("root").alias("root")), "cc-labels")
    discard(stars)
    return labels
