"""Maximum inner product search by score-aware (anisotropic) quantisation with four-bit tables and exact reranking.

A vector is cut into subspaces of a few dimensions, each with sixteen codewords, so a code takes four bits. Codewords and
codes minimise |r|^2 + (eta - 1) (r . x/|x|)^2 for the residual r: error along the vector, which moves its own large inner
products, counts eta times. Codebooks are fitted on a bounded sample (SAMPLE rows by hash); every row is encoded.

Search: rows are put in blocks by a hash of their id, queries too, and every block of queries meets every block of rows.
There a query's tables (two subspaces to a byte of codes) are summed over the codes. Inner products of the best RERANK rows,
taken exactly in double precision, give a k-th best score; every other row whose score could reach it goes on as well, and
none else: the angle between query and row is at least that between query and decoded row less that between row and decoded
row, so the table's sum bounds the score from above. Nothing is cut, results are those of a full scan. Blocks hold CELLS
components at most, so a task's memory is bounded; a row is copied once for each block of queries. The best of all blocks are merged by exact score. Equal vectors in a block are searched once and
stand for their smallest ids.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part; vectors of one
length are searched by themselves, as others have no inner product with them; a query finds all others if they are
fewer than k; ties go to the smaller vec_id; rows with a null vec_id take no part; a row that repeats a vec_id is another
candidate of that id, but never of its own query id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import map_arrow, ship, table

WORDS = 16
SAMPLE = 10_000
RERANK = 96
#: Components of the rows of a block, and of its queries.
CELLS = 1 << 20
#: Queries whose tables are held at a time.
TABLES = 256
THRESHOLD = 0.2


def eta(dimensions: int, threshold: float = THRESHOLD) -> float:
    """Weight of parallel error for inner products above threshold times the norms."""
    return max(1.0, (dimensions - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    def __init__(self, dimensions: int, part: int = 2):
        self.dimensions, self.part = dimensions, part
        self.parts = -(-dimensions // part)
        self.parts += self.parts % 2  # two codes to a byte
        self.weight = eta(dimensions) - 1
        self.words = np.zeros((self.parts, WORDS, part))

    def _split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.parts * self.part))
        wide[:, : self.dimensions] = x
        return wide.reshape(len(x), self.parts, self.part)

    def assign(self, x: np.ndarray, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x parts) by coordinate descent on the score-aware loss."""
        pieces = self._split(x)
        units = self._split(x / np.linalg.norm(x, axis=1, keepdims=True))
        n = np.arange(len(x))
        if codes is None:
            plain = [((pieces[:, m, None] - self.words[m]) ** 2).sum(2).argmin(1) for m in range(self.parts)]
            codes = np.stack(plain, 1)
        along = np.zeros((len(x), self.parts))
        for m in range(self.parts):
            along[:, m] = ((pieces[:, m] - self.words[m][codes[:, m]]) * units[:, m]).sum(1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(self.parts):
                residual = pieces[:, m, None] - self.words[m]
                each = (residual * units[:, m, None]).sum(2)
                loss = (residual**2).sum(2) + self.weight * ((total - along[:, m])[:, None] + each) ** 2
                codes[:, m] = loss.argmin(1)
                new = each[n, codes[:, m]]
                total += new - along[:, m]
                along[:, m] = new
        return codes

    def fit(self, x: np.ndarray, rounds: int = 8, seed: int = 1) -> Quantiser:
        rng = np.random.default_rng(seed)
        pieces, units = self._split(x), self._split(x / np.linalg.norm(x, axis=1, keepdims=True))
        for m in range(self.parts):
            self.words[m] = pieces[rng.integers(0, len(x), WORDS), m]
        codes = None
        for _ in range(rounds):
            codes = self.assign(x, codes, sweeps=1)
            along = np.stack([((pieces[:, m] - self.words[m][codes[:, m]]) * units[:, m]).sum(1) for m in range(self.parts)], 1)
            total = along.sum(1)
            for m in range(self.parts):
                u, rest = units[:, m], total - along[:, m]
                outer = np.eye(self.part) + self.weight * u[:, :, None] * u[:, None, :]
                target = pieces[:, m] + self.weight * u * (rest + (pieces[:, m] * u).sum(1))[:, None]
                for c in range(WORDS):
                    own = codes[:, m] == c
                    if own.any():
                        self.words[m, c] = np.linalg.solve(outer[own].sum(0), target[own].sum(0))
                new = ((pieces[:, m] - self.words[m][codes[:, m]]) * u).sum(1)
                total += new - along[:, m]
                along[:, m] = new
        return self

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of a code, the inner product's part of each of its 256 values."""
        each = np.einsum("qmd,mcd->qmc", self._split(queries), self.words)
        low, high = each[:, 0::2], each[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), self.parts // 2, 256).astype(np.float32)


    def decode(self, packed: np.ndarray) -> np.ndarray:
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)
        return self.words[np.arange(self.parts), codes].reshape(len(packed), -1)[:, : self.dimensions]


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0)


def _clean(rows: DataFrame) -> DataFrame:
    some = rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("embedding")), F.lit(False)))
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _matrix(column, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def _encode(quantiser: Quantiser, dimensions: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = quantiser.pack(quantiser.assign(_matrix(batch.column("embedding"), dimensions)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "code"])

    return task


def best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest scores; of equal ones at the edge the first."""
    if len(scores) <= n:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: n - len(above)]])


class Bound:
    """Greatest inner products that rows can have with a query, given their tables' sums."""

    def __init__(self, rows: np.ndarray, decoded: np.ndarray, terms: int):
        self.norm, self.decoded = np.linalg.norm(rows, axis=1), np.linalg.norm(decoded, axis=1)
        there = self.decoded > 0
        units = rows / self.norm[:, None]
        along = (decoded * units).sum(1)
        across = np.linalg.norm(decoded - along[:, None] * units, axis=1)
        length = np.where(there, self.decoded, 1.0)
        # a row that decodes to zero has no direction: its bound is the product of the norms
        self.cos, self.sin = np.where(there, along / length, -1.0), np.where(there, across / length, 0.0)
        self.rounding = 2 * (terms + 2) * float(np.finfo(np.float32).eps)

    def __call__(self, rough: np.ndarray, table: np.ndarray, query: np.ndarray) -> np.ndarray:
        q = np.linalg.norm(query)
        slack = self.rounding * float(np.abs(table).max(1).sum())
        c = np.clip((rough + slack) / np.maximum(q * self.decoded, np.finfo(float).tiny), -1.0, 1.0)
        nearest = np.where(c >= self.cos, 1.0, c * self.cos + np.sqrt(1 - c * c) * self.sin)
        return q * self.norm * (nearest + 1e-9)


def _top(found, value, ids, by, bounds, own, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (vec_id, score) of classes of equal vectors in order of score, without the query's own id."""
    rows, scores = [], []
    # every class gives up to k of its smallest ids that are not the query's own
    for c, s in zip(found.tolist(), value.tolist(), strict=True):
        if len(rows) > k and s < scores[k]:
            break
        members = ids[by[bounds[c] : bounds[c + 1]]]
        members = members[members != own][:k]
        rows += members.tolist()
        scores += [s] * len(members)
    r, s = np.array(rows, np.int64), np.array(scores, float)
    top = np.lexsort((r, -s))[:k]
    return r[top], s[top]


def scan(quantiser: Quantiser, query_ids, queries, ids, vectors, codes, k: int, rerank: int) -> tuple[np.ndarray, ...]:
    """The k best rows of a block for each query: query id, vec_id, exact score."""
    order = np.argsort(ids, kind="stable")
    ids, vectors, codes = ids[order], vectors[order], codes[order]
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, first, of = np.unique(raw, return_index=True, return_inverse=True)
    by = np.argsort(of, kind="stable")  # members of each distinct vector, by id
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of))])
    distinct, columns = vectors[first], np.ascontiguousarray(codes[first].T)
    bound = Bound(distinct, quantiser.decode(codes[first]), len(columns))

    def ordered(some: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = (distinct[some] * query).sum(1)
        best_first = np.argsort(-exact, kind="stable")
        return some[best_first], exact[best_first]

    out: list[tuple] = []
    for q in range(len(queries)):
        if q % TABLES == 0:
            tables = quantiser.tables(queries[q : q + TABLES])
        rough = np.zeros(len(first), np.float32)
        for t, c in zip(tables[q % TABLES], columns, strict=True):
            rough += t[c]
        some, query, own = best(rough, rerank), queries[q], query_ids[q]
        r, s = _top(*ordered(some, query), ids, by, bounds, own, k)
        if len(some) < len(first):
            least = s[k - 1] if len(s) == k else -np.inf
            # comparisons are turned round so that a bound that is not a number drops no row
            more = np.flatnonzero(~(bound(rough, tables[q % TABLES], query) < least))
            # the same products by matrix, whose last bits depend on a row's place; those near the edge are summed again
            product = distinct[more] @ query if 4 * len(more) < len(first) else (distinct @ query)[more]
            margin = 1e-12 * (1 + len(query)) * bound.norm[more] * np.linalg.norm(query)
            more = more[~(product < least - margin)]
            r, s = _top(*ordered(more, query), ids, by, bounds, own, k)
        if len(r):
            out.append((np.full(len(r), own), r, s))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(quantiser: Quantiser, dimensions: int, k: int, rerank: int):
    def task(group: pa.Table) -> pa.Table:
        asks = group.column("is_query").to_numpy(zero_copy_only=False)
        vectors = _matrix(group.column("embedding"), dimensions)
        ids = group.column("vec_id").to_numpy()
        rows = np.flatnonzero(~asks)
        codes = np.frombuffer(b"".join(group.column("code").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
        if len(rows) and asks.any():
            found = scan(quantiser, ids[asks], vectors[asks], ids[rows], vectors[rows], codes, k, rerank)
        else:
            found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    return task


def search(rows: DataFrame, queries: DataFrame, k: int = 20, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows of greatest inner product with each query. rows, queries: vec_id, embedding."""
    ship(rows.sparkSession)
    clean, asked = _clean(rows), _clean(queries)
    lengths = lambda df: {r["d"]: r["n"] for r in df.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    there, wanted = lengths(clean), lengths(asked)
    found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for d in sorted(there.keys() & wanted.keys()):
        same = F.size("embedding") == d
        found = found.unionByName(_of_one_length(clean.where(same), there[d], asked.where(same), wanted[d], d, k, rerank))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_one_length(rows: DataFrame, n: int, queries: DataFrame, n_queries: int, dimensions: int, k: int, rerank: int) -> DataFrame:
    """query_id, vec_id, score: of every block the k best rows for each query, and more."""
    share = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, SAMPLE / n)))
    sample = [r[0] for r in rows.where(share).orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(2 * SAMPLE).collect()]
    if not sample:
        sample = [r[0] for r in rows.select("embedding").limit(SAMPLE).collect()]
    quantiser = Quantiser(dimensions).fit(np.array(sample))
    coded = map_arrow(rows, _encode(quantiser, dimensions), "vec_id long, embedding array<double>, code binary")
    size = max(1, CELLS // dimensions)
    row_blocks, query_blocks = -(-n // size), max(1, -(-n_queries // size))
    block = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = coded.select(F.lit(False).alias("is_query"), "vec_id", "embedding", "code", block(11, row_blocks).alias("r"), every(query_blocks).alias("q"))
    right = queries.select(F.lit(True).alias("is_query"), "vec_id", "embedding", F.lit(b"").alias("code"), every(row_blocks).alias("r"), block(13, query_blocks).alias("q"))
    return left.unionByName(right).groupBy("r", "q").applyInArrow(_search(quantiser, dimensions, k, rerank), "query_id long, vec_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
