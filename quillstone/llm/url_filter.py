"""URL filters by Bloom filter cascades: exact membership of a host-and-path key in a list, without joins.

A url's keys are every suffix of its host at a label bound, with the path's beginnings of the lengths that rules have.
Level 0 of a cascade encodes the listed keys; the keys of the whole corpus that pass it and are not listed are its false
positives, and level 1 encodes those; listed keys that pass level 1 are level 2, and so on until none is left. A key's
first level that it fails tells whether it is listed: exact for every key of the corpus (its universe). Level 0 has the
rate |L| / (sqrt(2) |U|) and the others one half, so false positives stay near |L| / sqrt(2) however large the corpus is.
One cascade tells listed keys from all others, a second one blocking rules from allowing ones.

Bounds: what is broadcast are the bit maps of at most PART rules, about 1.44 log2(1 / rate) bits for each. A longer list
is cut into parts by hash, one pass over the urls for each, and a url keeps the longest rule found so far. Keys that pass
a first level are gathered without their urls and lose the listed ones by an anti-join; if more false positives are left
than PASSING for each rule (chance, or hosts that are counted badly), the level is made anew with a lower rate.

Defined cases: a null url, or one without ://, has an empty host and path and fits no rule; repeated rows are judged
alike; an empty list or table works; of rules that fit, the longest (host and path together, then host) wins; of
several verdicts for one key, block wins. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import map_arrow, stored, table
from quillstone.llm.hashing import mix

#: Rules of one pass, and false positives of a first level for each of them (and a few) that the driver takes.
PART = 2_000_000
PASSING = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The production rules, as (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Bloom:
    def __init__(self, digests: np.ndarray, rate: float):
        n = max(len(digests), 1)
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(64, math.ceil(n * self.hashes / math.log(2)))
        self.map = np.zeros(-(-self.bits // 8), np.uint8)
        at = self._places(digests).ravel()
        np.bitwise_or.at(self.map, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _places(self, digests: np.ndarray) -> np.ndarray:
        a, b = digests[:, :1], digests[:, 1:] | np.uint64(1)
        return ((a + b * np.arange(self.hashes, dtype=np.uint64)) % np.uint64(self.bits)).astype(np.int64)

    def passes(self, digests: np.ndarray) -> np.ndarray:
        at = self._places(digests)
        return ((self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def salted(digests: np.ndarray, level: int) -> np.ndarray:
    """Hashes of its own for each level."""
    return mix(digests ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1)))


def as_array(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2) if digests else np.zeros((0, 2), np.uint64)


class Cascade:
    def __init__(self, first: Bloom):
        self.levels = [first]

    @staticmethod
    def first_level(listed: np.ndarray, universe: int) -> Bloom:
        rate = min(0.5, max(len(listed), 1) / (math.sqrt(2) * max(universe, 1)))
        return Bloom(salted(listed, 0), rate)

    def complete(self, listed: np.ndarray, false_positives: np.ndarray) -> Cascade:
        """Add the levels after the first from its false positives over the universe."""
        inside, outside = listed, false_positives
        while len(outside):
            level = len(self.levels)
            self.levels.append(Bloom(salted(outside, level), 0.5))
            passing = inside[self.levels[-1].passes(salted(inside, level))]
            inside, outside = outside, passing
        return self

    def contains(self, digests: np.ndarray) -> np.ndarray:
        """A key that first fails level k belongs to the set of level k - 1; one that passes all, to the last level's."""
        out = np.full(len(digests), len(self.levels) % 2 == 1)
        waiting = np.arange(len(digests))
        for k, level in enumerate(self.levels):
            ok = level.passes(salted(digests[waiting], k)) if len(waiting) else np.zeros(0, bool)
            out[waiting[~ok]] = k % 2 == 1
            waiting = waiting[ok]
        return out


def candidates(host: str, path: str, lengths: list[int]) -> list[tuple[str, int]]:
    """Keys of a url with the length of their host, longest key first."""
    suffixes = [host]
    while "." in suffixes[-1]:
        suffixes.append(suffixes[-1].split(".", 1)[1])
    found = [(s + path[:n], len(s)) for s in suffixes for n in lengths if len(path) >= n]
    return sorted(found, key=lambda c: (-len(c[0]), -c[1]))


def _passing(first: Bloom, lengths: list[int]):
    """Digests of the keys of urls that pass a first level."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {k for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True) for k, _ in candidates(h, p, lengths)}
            digests = [digest(k) for k in keys]
            hit = np.flatnonzero(first.passes(salted(as_array(digests), 0))) if digests else []
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in hit], pa.binary())], ["digest"])

    return task


def _cascade(parts: DataFrame, keys: list[bytes], lengths: list[int], universe: int) -> Cascade:
    """The cascade of the listed keys over all keys of the urls in parts."""
    listed = as_array(keys)
    known = parts.sparkSession.createDataFrame(pa.table({"digest": pa.array(keys, pa.binary())}))
    most = PASSING * len(keys) + 10_000
    while True:
        first = Cascade.first_level(listed, universe)
        wrong = map_arrow(parts.select("host", "path"), _passing(first, lengths), "digest binary").distinct().join(known, "digest", "left_anti")
        found = [bytes(r[0]) for r in wrong.limit(most + 1).collect()]
        if len(found) <= most:
            return Cascade(first).complete(listed, as_array(found))
        universe = 16 * max(universe, len(keys))


def _decide(listed: Cascade, blocking: Cascade, lengths: list[int]):
    """The longest rule that fits a url, of these and the one that it has already."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            own = [candidates(h, p, lengths) for h, p in zip(hosts, paths, strict=True)]
            digests = as_array([digest(k) for c in own for k, _ in c])
            inside, blocks = listed.contains(digests), blocking.contains(digests)
            rules, hosts_, verdicts, at = [], [], [], 0
            for c, *before in zip(own, *(batch.column(n).to_pylist() for n in ("rule", "rule_host", "verdict")), strict=True):
                i = next((i for i in range(len(c)) if inside[at + i]), None)
                if i is not None and (before[0] is None or (len(c[i][0]), c[i][1]) > (len(before[0]), before[1])):
                    before = [*c[i], "block" if blocks[at + i] else "allow"]
                for x, to in zip(before, (rules, hosts_, verdicts), strict=True):
                    to.append(x)
                at += len(c)
            new = pa.array(rules, pa.string()), pa.array(hosts_, pa.int32()), pa.array(verdicts, pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("page_id", "host", "path")), *new], ["page_id", "host", "path", "rule", "rule_host", "verdict"])

    return task


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | tuple, part: int = PART) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url). A url that no rule fits is not listed: allowed."""
    block = {h + p for h, p, v in rules if v == "block"}
    keys = sorted(block | {h + p for h, p, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = parts.agg(F.sum(F.size(F.split("host", r"\.")) * len(lengths))).first()[0] or 0
    judged = parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("rule_host"), F.lit(None).cast("string").alias("verdict"))
    passes = max(1, -(-len(keys) // part))
    for k in range(passes):
        own = [(key, digest(key)) for key in keys]
        own = [(key, d) for key, d in own if int.from_bytes(d[:8], "little") % passes == k]
        listed = _cascade(parts, [d for _, d in own], lengths, universe)
        b, a = (as_array([d for key, d in own if (key in block) == side]) for side in (True, False))
        start = Cascade.first_level(b, len(a))
        blocking = Cascade(start).complete(b, a[start.passes(salted(a, 0))] if len(a) else a)
        judged = map_arrow(judged, _decide(listed, blocking, lengths), "page_id long, host string, path string, rule string, rule_host int, verdict string")
        if k + 1 < passes:
            judged = stored(judged, "url-judged")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


SQL = r"""
with rules(rule_host, rule_path, verdict) as (values
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts as (
  select row_number() over () as n, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
fits as (
  select n, rule_host || rule_path as rule, verdict,
         row_number() over (partition by n order by len(rule_host || rule_path) desc, len(rule_host) desc) as k
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join fits on parts.n = fits.n and k = 1
"""
