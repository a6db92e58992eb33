"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is lower-cased, ASCII characters other than letters become blanks, and the byte n-grams of its words (with their
bounds) are hashed into BUCKETS embeddings; their average goes through a linear softmax. Both are trained together on a
sample of labelled texts of at most PER_LANGUAGE rows for each language, taken by hash (documented bound). A fifth of
the sample calibrates: a temperature by likelihood, and the score below which a prediction is marked as rejected.
For prediction the two linear maps are multiplied out to one small table of scores, which is broadcast; each whole text
is read once.

Defined cases: a null text, or one without a letter, is `und` with score 0; null languages are not learned; without
labelled rows everything is `und`; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import map_arrow, slices, table, text_bytes

BUCKETS, WIDTH = 1 << 16, 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 500
CHUNK = 1 << 20
_SPACE = 32
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:65] = _SPACE
_LETTERS[91:97] = _SPACE
_LETTERS[123:128] = _SPACE


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of every text, and the bounds of each text in it (n + 1)."""
    data, bounds = text_bytes(pc.utf8_lower(texts))
    b = _LETTERS[data]
    framed = np.full(len(b) + len(bounds), _SPACE, np.uint8)  # a blank between texts
    shift = np.arange(len(bounds))
    framed[np.arange(len(b)) + np.repeat(shift[1:], np.diff(bounds))] = b
    edges = bounds + shift  # start of each text's leading blank
    x = framed.astype(np.uint32)
    blank = framed == _SPACE
    buckets, owners = [], []
    for n in GRAMS:
        m = len(x) - n + 1
        if m < 1:
            continue
        value = x[:m].copy()
        good = ~(blank[:m] & blank[n - 1 :]) if n == 2 else np.ones(m, bool)
        for k in range(1, n):
            value |= x[k : m + k] << np.uint32(8 * k)
            if k < n - 1:
                good &= ~blank[k : m + k]
        at = np.flatnonzero(good)
        hashed = value[at] * np.uint32(2654435761) ^ np.uint32(0x85EBCA6B * n & 0xFFFFFFFF)
        buckets.append(((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x846CA68B) >> np.uint32(16)).astype(np.int64))
        owners.append(at)
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    counts = sum(np.diff(np.searchsorted(o, edges)) for o in owners)
    out = np.empty(int(counts.sum()), np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    fill = ends[:-1].copy()
    for o, bk in zip(owners, buckets, strict=True):
        cut = np.searchsorted(o, edges)
        size = np.diff(cut)
        place = np.arange(cut[-1] - cut[0]) - np.repeat(cut[:-1] - cut[0], size) + np.repeat(fill, size)
        out[place] = bk[cut[0] : cut[-1]]
        fill += size
    return out, ends


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = np.diff(bounds)
        sums = np.zeros((len(n), len(self.languages)))
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(self.table[buckets], bounds[:-1][full], axis=0)
        return softmax((sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.5, seed: int = 1) -> Model:
    """rows: language, distinct buckets and their counts."""
    rng = np.random.default_rng(seed)
    languages = sorted({r[0] for r in rows})
    label = {lang: k for k, lang in enumerate(languages)}
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 5 * len(languages) else order[:0]
    fit = [int(i) for i in order[len(held) :]]
    embeddings = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    shares = [counts / counts.sum() for _, _, counts in rows]
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            lang, at, _ = rows[i]
            lr = rate * (1 - done / steps)
            hidden = shares[i] @ embeddings[at]
            error = softmax(hidden @ weights + bias)
            error[label[lang]] -= 1
            back = weights @ error
            weights -= lr * np.outer(hidden, error)
            bias -= 0.1 * lr * error
            embeddings[at] -= 20 * lr * np.outer(shares[i], back)
            done += 1
    scores = embeddings @ weights
    model = Model(languages, scores.astype(np.float32), bias, 1.0, 0.0)
    if len(held):
        logits = np.array([shares[i] @ scores[rows[i][1]] + bias for i in held])
        truth = np.array([label[rows[i][0]] for i in held])
        spread = np.geomspace(0.05, 20, 80)
        model.temperature = float(min(spread, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()))
        chance = softmax(logits / model.temperature)
        top, right = chance.max(axis=1), chance.argmax(axis=1) == truth
        down = np.argsort(-top)
        precise = np.cumsum(right[down]) / np.arange(1, len(down) + 1)
        good = np.flatnonzero(precise >= 0.99)
        model.reject_below = float(top[down[good[-1]]]) if len(good) else 1.0
    return model


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", CHUNK):
        buckets, bounds = features(batch.column("text"))
        at, counts = [], []
        for d in range(batch.num_rows):
            u, c = np.unique(buckets[bounds[d] : bounds[d + 1]], return_counts=True)
            at.append(u.astype(np.uint16).tobytes())
            counts.append(c.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["lang", "at", "counts"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from labelled (doc_id, text, lang); at most about per_language rows of each language are used."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(1_000_000 * min(1.0, per_language / n))))))
    some = usable.where(F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")])
    some = some.groupBy("lang", "doc_id", F.xxhash64("text")).agg(F.first("text").alias("text"))  # rows that repeat are learned once, so the sample is bounded
    got = map_arrow(some.select("text", "lang"), _sample, "lang string, at binary, counts binary").collect()
    rows = [(r["lang"], np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.uint32).astype(float)) for r in got]
    rows = sorted((r for r in rows if len(r[1])), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return train(rows) if rows else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs (doc_id, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            texts = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model is None:
                names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            else:
                chance = model.probabilities(*features(texts))
                names = np.array(model.languages, object)[chance.argmax(axis=1)]
                score = np.where(letters, chance.max(axis=1), 0.0)
                names[~letters] = "und"
            rejected = ~letters | (score < (model.reject_below if model else 1.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), task, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
