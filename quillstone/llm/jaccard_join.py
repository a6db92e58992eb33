"""Self-join of documents by Jaccard similarity of word shingles, with adaptive multi-match prefixes.

Each document is the set of hashes of its shingles. The global order is by classes of expected frequency, rare ones
first, and by hash within a class; a bounded sample of the texts says what is frequent. Any order gives the same result,
but by hash alone, prefixes of short sets hold phrases that ever more other sets have, and unrelated sets become one family.
Two sets of similarity t or more share at least l tokens of their l-prefixes, the first n - ceil(t n) + l tokens, for
every l up to a limit that grows with n. Equal sets are one class throughout.

1. Longest prefixes meet by token. A token of a set counts if another set whose size allows a link has it too. A set
   that for some l has fewer than l such tokens in its l-prefix has no partner and leaves. What is left stays in shards.
2. The tokens of these sets are counted. Each set lengthens its prefix to the length l of least estimated cost, which is
   the postings to be read: the counts of its l-prefix without its l - 1 most frequent tokens, as a partner must share l.
   With these rare tokens it asks for partners among all sets that have them, in a window of sizes.
3. Sets that a question ties are a family (connected components). Small families share tasks of bounded size. A larger
   one is cut into blocks by size; each block meets the family's pivots, then only sets outside the family's largest
   component go round the blocks whose sizes allow links: a large group of near copies hangs together after the first.
4. In a task sets are matched by inverted prefixes, again of the length of least cost, and only those that share l tokens
   are verified, exactly. Sets already in one component are not compared again.

Links found span the components; connected components join them across tasks. A token that very many sets have is one
entry for each size and shard wherever it meets others; no task gathers its sets.

Defined cases: null, empty or blank texts have the empty set, size 0, and are alone; with fewer words than a shingle the
whole sequence is one shingle; repeated rows are each returned; a null doc_id is linked like others but is the least of
its component only if there is no other id (then component_id is null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import discard, group_arrow, map_arrow, ship, slices, stored, table, text_bytes
from quillstone.llm.graph import components
from quillstone.llm.hashing import Rarity, mix, shingles
from quillstone.llm.hashing import words as word_hashes
from quillstone.llm.packing import BLOB, by_bucket, first_of, pack, row, schema, unpack, unpack_all

CHUNK, FLUSH, BUCKET = 1 << 20, 16 << 20, 8 << 20
#: Bytes of text, chosen at random, that the order of tokens is learned from, and the words and shingles kept of them.
SAMPLE, FREQUENT = 16 << 20, 1 << 16
#: Shingle hashes of one task of verification.
TASK_TOKENS = 1 << 18
#: Cost of verifying a candidate, in postings read.
VERIFY = 400
#: Sets of a large family that all its blocks meet.
PIVOTS = 16
#: Names of rows (16 bytes each) that are broadcast at most.
SENT_ROWS = 1_000_000
TOKENS, MATCHED, TEXT, DOCS, SETS, GROUPS, EDGES = range(7)


class Bound:
    """Integer bounds for the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n):
        """Least shared tokens of a set of size n with any partner: ceil(t n)."""
        return (self.num * n + self.den - 1) // self.den

    def most(self, n):
        """Longest extension l for a set of size n; it grows with n and is the same for equal sizes."""
        return np.maximum(1, (self.den - self.num) * n // (2 * self.den))

    def sure(self, n):
        """An extension that a set of size n and all its partners have."""
        return self.most(self.overlap(n))

    def prefix(self, n, l):  # noqa: E741
        return np.minimum(n, n - self.overlap(n) + l)

    def options(self, n: int) -> np.ndarray:
        """Extensions tried for a set of size n: all up to 8, then growing by a quarter, and the longest sure one."""
        out, l = [], 1  # noqa: E741
        last = int(self.sure(n))
        while l < last:
            out.append(l)
            l = max(l + 1, l * 5 // 4)  # noqa: E741
        return np.array([*out, last])

    def linked(self, shared: int, a: int, b: int) -> bool:
        return shared > 0 and self.den * shared >= self.num * (a + b - shared)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set: sums and sums of mixed values (order does not matter), with the size."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        out[i] = s.sum(dtype=np.uint64) + np.uint64(len(s)), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return np.stack([mix(out[:, 0]), mix(out[:, 1])], 1)


def _sets(batches: Iterator[pa.RecordBatch], size: int, rarity: Rarity | None = None):
    for batch in slices(batches, "text", CHUNK):
        data, bounds = text_bytes(batch.column("text"))
        sets = shingles(data, bounds, size, rarity)
        yield batch, data, bounds, sets, _digests(sets)


def _new(digests: np.ndarray, seen: set) -> list[int]:
    out = []
    for i, d in enumerate(map(tuple, digests.tolist())):
        if d not in seen:
            seen.add(d)
            out.append(i)
    return out


def _frequent(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent values that come twice or more, and their counts."""
    x, count = np.unique(np.concatenate(values), return_counts=True)
    some = np.flatnonzero(count > 1)
    some = some[np.argsort(-count[some], kind="stable")[:FREQUENT]]
    return x[some], count[some]


def _learn(size: int):
    """Frequent words and shingles of a sample in one task, equal texts once: one row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, chains, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], set()
        for _, data, bounds, sets, digests in _sets(batches, size):
            new = _new(digests, seen)
            hashes, doc = word_hashes(data, bounds)
            all_.append(hashes[np.isin(doc, new)])
            chains += [sets[i] for i in new]
        yield row(0, 0, pack(*_frequent(all_), *_frequent(chains), np.array([sum(map(len, all_))], np.int64)))

    return task


def rarity_of(docs: DataFrame, size: int, total: int) -> Rarity:
    """The classes by which tokens are ordered, from about SAMPLE bytes of docs (text), which hold total bytes."""
    share = min(1.0, SAMPLE / max(total, 1))
    sample = docs.select("text").sample(share, 17) if share < 1 else docs.select("text")
    found = map_arrow(sample.repartition(1), _learn(size), BLOB).collect()
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    *frequent, n = unpack(found[0]["data"], *(np.uint64, np.int64) * 2, np.int64) if found else (*none, *none, np.zeros(1, np.int64))
    return Rarity(*frequent, int(n[0]), int(n[0]) / share)


def _near(t: np.ndarray, n: np.ndarray, bound: Bound) -> np.ndarray:
    """Entries, sorted by token and size, beside one of the same token whose size allows a link (the nearest size does if any does)."""
    out = np.zeros(len(t), bool)
    n = n.astype(np.int64)
    beside = (t[1:] == t[:-1]) & (bound.overlap(n[1:]) <= n[:-1])
    out[1:] |= beside
    out[:-1] |= beside
    return out


def _send_tokens(size: int, bound: Bound, buckets: int, rarity: Rarity):
    """Longest prefixes by token. Tokens that match within a flush go to their sets at once; one entry for each token and size meets those of other tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, places, sizes, held = [], [], [], [], 0
        seen: set = set()

        def flush() -> Iterator[pa.RecordBatch]:
            t, o, p, n = (np.concatenate(x) for x in (tokens, owners, places, sizes))
            order = np.lexsort((n, t))
            t, o, p, n = t[order], o[order], p[order], n[order]
            known = _near(t, n, bound)
            yield from by_bucket((o[known] % np.uint64(buckets)).astype(np.int32), MATCHED, [o[known], p[known]])
            sent = np.flatnonzero(first_of(t, n))
            arrays = [t[sent], o[sent], p[sent], n[sent], known[sent].astype(np.uint8)]
            yield from by_bucket((t[sent] % np.uint64(buckets)).astype(np.int32), TOKENS, arrays)

        for _, data, _, sets, digests in _sets(batches, size, rarity):
            for i in _new(digests, seen):
                s = sets[i]
                if len(s):
                    k = int(bound.prefix(len(s), int(bound.most(len(s)))))
                    tokens.append(s[:k])
                    owners.append(np.broadcast_to(digests[i, 0], k))
                    places.append(np.arange(k, dtype=np.uint32))
                    sizes.append(np.full(k, len(s), np.uint32))
            held += len(data)
            if held >= FLUSH and tokens:
                yield from flush()
                tokens, owners, places, sizes, held = [], [], [], [], 0
                seen.clear()
        if tokens:
            yield from flush()

    return task


def _meet_tokens(bound: Bound, buckets: int):
    """Places of prefix tokens that another set has, back to their sets; what is known already passes."""

    def task(group: pa.Table) -> pa.Table:
        t, a, p, n, known = unpack_all(_of(group, TOKENS), np.uint64, np.uint64, np.uint32, np.uint32, np.uint8)
        order = np.lexsort((known, a, n, t))
        t, a, p, n, known = (x[order] for x in (t, a, p, n, known))
        last = np.append(first_of(t, a)[1:], True) if len(t) else np.zeros(0, bool)  # of a set's entries one that is known, if any
        t, a, p, n, known = (x[last] for x in (t, a, p, n, known))
        found = _near(t, n, bound) & (known == 0)
        out = [row(int(group.column("bucket")[0].as_py()), MATCHED, blob) for blob in _of(group, MATCHED)]
        return pa.Table.from_batches([*out, *by_bucket((a[found] % np.uint64(buckets)).astype(np.int32), MATCHED, [a[found], p[found]])], schema())

    return task


def _send_texts(size: int, buckets: int, rarity: Rarity):
    """Each set's text once a flush, by digest; and the rows (doc_id, tag, size, digest), which stay in buckets of their flush."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, digests_, ids, tags, sizes, all_, held = [], [], [], [], [], [], 0
        seen: set = set()

        def flush() -> Iterator[pa.RecordBatch]:
            d = np.concatenate(all_)
            nulls = np.concatenate([x.is_null().to_numpy(zero_copy_only=False) for x in ids])
            values = np.concatenate([x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in ids])
            turn = int(d[0, 0] % np.uint64(buckets)) if len(d) else 0
            yield row(turn, DOCS, pack(values, nulls.astype(np.uint8), np.concatenate(tags), np.concatenate(sizes), d[:, 0], d[:, 1]))
            if texts:
                o = np.array(digests_, np.uint64)
                target = (o[:, 0] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(target, kind="stable")
                cuts = np.flatnonzero(first_of(target[order]))
                for x, y in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                    some = order[x:y]
                    data = np.concatenate([texts[k] for k in some])
                    yield row(int(target[some[0]]), TEXT, pack(o[some, 0], o[some, 1], np.array([len(texts[k]) for k in some], np.int64), data))

        for batch, data, bounds, sets, digests in _sets(batches, size, rarity):
            ids.append(batch.column("doc_id"))
            tags.append(batch.column("tag").to_numpy(zero_copy_only=False))
            sizes.append(np.array([len(s) for s in sets], np.int64))
            all_.append(digests)
            for i in _new(digests, seen):
                if len(sets[i]):
                    texts.append(data[bounds[i] : bounds[i + 1]])
                    digests_.append(digests[i])
            held += len(data)
            if held >= FLUSH:
                yield from flush()
                texts, digests_, ids, tags, sizes, all_, held = [], [], [], [], [], [], 0
                seen.clear()
        if ids:
            yield from flush()

    return task


def _survive(size: int, bound: Bound, rarity: Rarity):
    """Sets that may have partners with the places of their matched tokens, packed by shard; rows of documents pass."""

    def task(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        blobs = group.column("data")
        of = lambda kind: [blobs[int(k)].as_py() for k in np.flatnonzero(kinds == kind)]
        out = [row(0, DOCS, b) for b in of(DOCS)]
        a, p = unpack_all(of(MATCHED), np.uint64, np.uint32)
        order = np.lexsort((p, a))
        a, p = a[order], p[order]
        once = first_of(a, p)
        a, p = a[once], p[once]
        starts = np.flatnonzero(first_of(a))
        matched = {x: p[i:j] for x, i, j in zip(a[starts].tolist(), starts.tolist(), np.append(starts, len(a))[1:].tolist(), strict=True)}
        done: set = set()
        shard = int(group.column("bucket")[0].as_py())
        left: list[tuple] = []

        def end() -> None:
            if left:
                a, b, s, p = zip(*left, strict=True)
                counts = [np.array([len(x) for x in y], np.uint32) for y in (s, p)]
                out.append(row(shard, SETS, pack(np.array(a, np.uint64), np.array(b, np.uint64), *counts, np.concatenate(s), np.concatenate(p))))
                left.clear()

        for blob in of(TEXT):
            da, db, lengths, data = unpack_all([blob], np.uint64, np.uint64, np.int64, np.uint8)
            ends = np.cumsum(lengths)
            wanted = [k for k, key in enumerate(zip(da.tolist(), db.tolist(), strict=True)) if key[0] in matched and key not in done]
            for i in range(0, len(wanted), 256):
                if len(left) >= 4096:
                    end()
                some = wanted[i : i + 256]
                part = np.concatenate([data[ends[k] - lengths[k] : ends[k]] for k in some])
                sets = shingles(part, np.concatenate([[0], np.cumsum(lengths[some])]), size, rarity)
                for k, s in zip(some, sets, strict=True):
                    key = int(da[k]), int(db[k])
                    done.add(key)
                    n = len(s)
                    sure = int(bound.sure(n))
                    l = np.arange(1, sure + 1)  # noqa: E741
                    own = matched[key[0]][: np.searchsorted(matched[key[0]], n)]  # a set that shares half its digest adds places, never takes any
                    have = np.searchsorted(own, bound.prefix(n, l), side="left")
                    if (have >= np.minimum(l, n)).all():
                        left.append((*key, s, own))
            end()
        return pa.Table.from_batches(out, schema())

    return task


def _key(a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """Digests as 16 bytes, ordered as (a, b)."""
    raw = np.stack([a, b], 1).astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


_SETS = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint64, np.uint32)  # digest, sizes, numbers of matched tokens, tokens, places


def _unpack_sets(blobs: list[bytes]):
    """a, b, n, and for each set its tokens and the places of its matched ones."""
    a, b, n, m, tokens, places = unpack_all(blobs, *_SETS)
    t, p = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), np.concatenate([[0], np.cumsum(m, dtype=np.int64)])
    return a, b, n, [tokens[t[i] : t[i + 1]] for i in range(len(n))], [places[p[i] : p[i + 1]] for i in range(len(n))]


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("data").to_pylist():
            a, b, n, sets, _ = _unpack_sets([blob])
            yield pa.RecordBatch.from_arrays([pa.array(_key(a, b), pa.binary()), pa.array(n.astype(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "n", "tokens"])


def _doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("data").to_pylist():
            ids, nulls, tags, sizes, a, b = unpack_all([blob], np.int64, np.uint8, np.int64, np.int64, np.uint64, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls == 1), pa.array(tags), pa.array(sizes), pa.array(_key(a, b), pa.binary())], ["doc_id", "tag", "n_shingles", "key"])


def _send_matched(buckets: int):
    """Matched tokens of each shard, counted before they are sent: token, count, shard."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                _, _, _, sets, places = _unpack_sets([blob])
                t, count = np.unique(np.concatenate([s[p] for s, p in zip(sets, places, strict=True)]), return_counts=True)
                yield from by_bucket((t % np.uint64(buckets)).astype(np.int32), TOKENS, [t, count.astype(np.int64), np.full(len(t), shard, np.int32)])

    return task


def _count(group: pa.Table) -> pa.Table:
    """How many of the sets left have each token, back to the shards; tokens of one set only go."""
    t, count, shard = unpack_all(group.column("data").to_pylist(), np.uint64, np.int64, np.int32)
    order = np.lexsort((shard, t))
    t, count, shard = t[order], count[order], shard[order]
    of = np.cumsum(first_of(t)) - 1
    total = np.bincount(of, weights=count).astype(np.int64)[of] if len(of) else count
    some = (total > 1) & first_of(t, shard)
    return pa.Table.from_batches(list(by_bucket(shard[some], TOKENS, [t[some], total[some]])), schema())


def asked(n: int, places: np.ndarray, counts: np.ndarray, bound: Bound) -> tuple[int, np.ndarray] | None:
    """The extension l of least cost, and which of a set's matched tokens it asks with: those of the l-prefix without the l - 1 most frequent. None if some l has too few."""
    best = None
    for l in bound.options(n).tolist():  # noqa: E741
        own = np.flatnonzero(places < bound.prefix(n, l))
        if len(own) < min(l, n):
            return None
        kept = own[np.argsort(counts[own], kind="stable")[: len(own) - min(l, n) + 1]]
        cost = int(counts[kept].sum())
        if best is None or cost < best[0]:
            best = cost, l, kept
    return best[1:]


_ENTRY = (np.uint64, np.uint32, np.uint64, np.uint64, np.uint8, np.uint8, np.int32)  # token, size, digest, asks, several, shard


def _ask(bound: Bound, buckets: int):
    """Questions and answers of a shard: one entry for each token and size goes out. Sets of one token and size that one of them asks with are tied here, others wait for questions from elsewhere."""

    def task(group: pa.Table) -> pa.Table:
        shard = int(group.column("bucket")[0].as_py())
        a, b, n, sets, places = _unpack_sets(_of(group, SETS))
        known, totals = unpack_all(_of(group, TOKENS), np.uint64, np.int64)
        order = np.argsort(known)
        known, totals = known[order], totals[order]
        tokens, owners, marks = [], [], []
        for i, (s, p) in enumerate(zip(sets, places, strict=True)):
            t = s[p]
            at = np.minimum(np.searchsorted(known, t), max(len(known) - 1, 0))
            there = np.flatnonzero(known[at] == t) if len(known) else np.zeros(0, np.int64)
            found = asked(int(n[i]), p[there], totals[at[there]], bound)
            if found is not None:
                mark = np.zeros(len(there), bool)
                mark[found[1]] = True
                tokens.append(t[there])
                owners.append(np.full(len(there), i))
                marks.append(mark)
        out: list[pa.RecordBatch] = []
        if tokens:
            t, o, m = np.concatenate(tokens), np.concatenate(owners), np.concatenate(marks)
            size = n[o]
            order = np.lexsort((~m, size, t))
            t, o, m, size = t[order], o[order], m[order], size[order]
            head = np.flatnonzero(first_of(t, size))
            length = np.diff(np.append(head, len(t)))
            lead = np.repeat(head, length)
            asks, several = m[head], length > 1
            out += by_bucket((t[head] % np.uint64(buckets)).astype(np.int32), TOKENS, [t[head], size[head], a[o[head]], b[o[head]], asks.astype(np.uint8), several.astype(np.uint8), np.full(len(head), shard, np.int32)])
            rest = np.flatnonzero(lead != np.arange(len(t)))
            tied = rest[m[lead[rest]]]
            out += _edges(shard, a[o[tied]], b[o[tied]], a[o[lead[tied]]], b[o[lead[tied]]])
            waits = np.flatnonzero((length > 1)[np.repeat(np.arange(len(head)), length)] & ~m[lead])
            out += by_bucket(np.full(len(waits), shard, np.int32), GROUPS, [t[waits], size[waits], a[o[waits]], b[o[waits]]])
        return pa.Table.from_batches(out, schema())

    return task


def _of(group: pa.Table, kind: int) -> list[bytes]:
    kinds = group.column("kind").to_numpy()
    return [group.column("data")[int(k)].as_py() for k in np.flatnonzero(kinds == kind)]


def _edges(bucket: int, a, b, c, d) -> list[pa.RecordBatch]:
    if not len(a):
        return []
    x = np.unique(np.stack([a, b, c, d], 1), axis=0)
    return [row(bucket, EDGES, pack(*(np.ascontiguousarray(x[:, k]) for k in range(4))))]


def _answer(bound: Bound):
    """Ties between the entries of a token that one question covers, and the groups of other shards that it covers."""

    def task(group: pa.Table) -> pa.Table:
        t, n, a, b, asks, several, shard = unpack_all(group.column("data").to_pylist(), *_ENTRY)
        n = n.astype(np.int64)
        order = np.lexsort((b, a, n, t))
        t, n, a, b, asks, several, shard = (x[order] for x in (t, n, a, b, asks, several, shard))
        if not len(t):
            return pa.Table.from_batches([], schema())
        place = (np.cumsum(first_of(t)) - 1) << 32 | n
        q = np.flatnonzero(asks)
        first = np.searchsorted(place, place[q] >> 32 << 32 | bound.overlap(n[q]))
        last = np.searchsorted(place, place[q], side="right") - 1
        cover, ties = np.zeros(len(t) + 1, np.int64), np.zeros(len(t) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, last + 1, -1)
        np.add.at(ties, first, 1)
        np.add.at(ties, last, -1)
        covered, tied = np.cumsum(cover)[:-1] > 0, np.cumsum(ties)[:-1] > 0  # tied: to the next entry
        start = np.ones(len(t), bool)
        start[1:] = ~tied[:-1]
        lead = np.maximum.accumulate(np.where(start, np.arange(len(t)), 0))
        some = np.flatnonzero(~start)
        out = _edges(int(group.column("bucket")[0].as_py()), a[some], b[some], a[lead[some]], b[lead[some]])
        need = np.flatnonzero(covered & (several == 1) & (asks == 0))
        out += by_bucket(shard[need], TOKENS, [t[need], n[need].astype(np.uint32)])
        return pa.Table.from_batches(out, schema())

    return task


def _groups(group: pa.Table) -> pa.Table:
    """Ties within the groups of a shard that a question from elsewhere covers."""
    t, n, a, b = unpack_all(_of(group, GROUPS), np.uint64, np.uint32, np.uint64, np.uint64)
    need_t, need_n = unpack_all(_of(group, TOKENS), np.uint64, np.uint32)
    if not len(need_t) or not len(t):
        return pa.Table.from_batches([], schema())
    x = np.concatenate([np.stack([t, n.astype(np.uint64), np.ones(len(t), np.uint64)], 1), np.stack([need_t, need_n.astype(np.uint64), np.zeros(len(need_t), np.uint64)], 1)])
    order = np.lexsort((x[:, 2], x[:, 1], x[:, 0]))  # what is needed comes before its group
    x = x[order]
    head = first_of(x[:, 0], x[:, 1])
    wanted = (x[head][:, 2] == 0)[np.cumsum(head) - 1]
    member = order[wanted & (x[:, 2] == 1)]
    lead = np.maximum.accumulate(np.where(first_of(t[member], n[member]), np.arange(len(member)), 0))
    lead = member[lead]
    rest = lead != member
    return pa.Table.from_batches(_edges(0, a[member[rest]], b[member[rest]], a[lead[rest]], b[lead[rest]]), schema())


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("data").to_pylist():
            a, b, c, d = unpack_all([blob], *(np.uint64,) * 4)
            yield pa.RecordBatch.from_arrays([pa.array(_key(a, b), pa.binary()), pa.array(_key(c, d), pa.binary())], ["a", "b"])


def spanning_links(keys: list[bytes], sets: list[np.ndarray], bound: Bound, known: list[bytes] | None = None, visits: list[bool] | None = None) -> list[tuple[bytes, bytes]]:
    """Edges (set, least set of its component) of the components of the sets, by adaptive prefix filtering and exact verification.

    known names the component that each set is in already, visits the sets that are compared with the others only: then
    the edges are the links found between components.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), keys[i]))
    keys, sets = [keys[i] for i in order], [sets[i] for i in order]
    side = None if visits is None else np.array([visits[i] for i in order])
    n = np.array([len(s) for s in sets])
    most = bound.most(n)
    ends = bound.prefix(n, most)
    parent = list(range(len(sets)))
    links: list[tuple[bytes, bytes]] = []
    if known is not None:
        firsts: dict[bytes, int] = {}
        parent = [firsts.setdefault(known[i], k) for k, i in enumerate(order)]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    prefix = np.concatenate([s[:e] for s, e in zip(sets, ends, strict=True)])
    owner = np.repeat(np.arange(len(sets)), ends)
    _, token, count = np.unique(prefix, return_inverse=True, return_counts=True)
    by = np.argsort(token, kind="stable")  # postings: by token, then by set
    postings, first = owner[by], np.concatenate([[0], np.cumsum(count)])
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))  # of a set's own entry: earlier sets stand before it
    begin = np.concatenate([[0], np.cumsum(ends)])
    least = np.searchsorted(n, bound.overlap(n))  # smaller sets cannot be partners
    whole: tuple | None = None
    for x in range(1, len(sets)):
        own = slice(begin[x], begin[x + 1])
        lists_from, lists_to = first[token[own]], place[own]
        sizes = lists_to - lists_from
        if not sizes.any():
            continue
        read = np.cumsum(sizes)
        options = np.arange(1, most[x] + 1)
        at = bound.prefix(n[x], options) - 1
        cost = read[at] + VERIFY * np.minimum(read[at] / options, x)
        l = int(options[np.argmin(cost)])  # noqa: E741
        used = int(bound.prefix(n[x], l))
        total = int(read[used - 1])
        if not total:
            continue
        starts = np.repeat(lists_from[:used] - (read[:used] - sizes[:used]), sizes[:used])
        found, shared = np.unique(postings[starts + np.arange(total)], return_counts=True)
        if side is not None:
            across = side[found] != side[x]
            found, shared = found[across], shared[across]
        good = (found >= least[x]) & (shared >= np.minimum(np.minimum(l, most[found]), n[found]))
        found, shared = found[good], shared[good]
        if not len(found):
            continue
        waiting = found[np.argsort(-shared, kind="stable")].tolist()
        exact = None
        root = find(x)
        for k, y in enumerate(waiting):
            other = find(y)
            if other == root:
                continue
            if k == 64 and exact is None and len(waiting) > 256:  # many to verify: count all overlaps of this set at once
                if whole is None:
                    flat = np.concatenate(sets)
                    rows_ = np.repeat(np.arange(len(sets)), n)
                    sorted_ = np.argsort(flat, kind="stable")
                    whole = flat[sorted_], rows_[sorted_]
                a, b = np.searchsorted(whole[0], sets[x]), np.searchsorted(whole[0], sets[x], side="right")
                lengths = b - a
                spots = np.repeat(a - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
                exact = np.bincount(whole[1][spots], minlength=len(sets))
            if exact is not None:
                common = int(exact[y])
            else:
                at_ = np.searchsorted(sets[y], sets[x])
                at_[at_ == len(sets[y])] = 0
                common = int((sets[y][at_] == sets[x]).sum())
            if bound.linked(common, int(n[x]), int(n[y])):
                parent[max(root, other)] = min(root, other)
                root = min(root, other)
                links.append((keys[x], keys[y]))
    if known is not None:
        return links
    out: dict[int, list[int]] = {}
    for x in range(len(sets)):
        out.setdefault(find(x), []).append(x)
    edges = []
    for members in out.values():
        if len(members) > 1:
            low = min(keys[m] for m in members)
            edges += [(keys[m], low) for m in members if keys[m] != low]
    return edges


def _verify(bound: Bound):
    """Links of a task; with columns known and visits, those between components."""

    def task(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_pylist()
        sets = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
        more = [group.column(c).to_pylist() for c in ("known", "visits") if c in group.column_names]
        edges = spanning_links(keys, sets, bound, *more) if len(keys) > 1 else []
        return pa.table({"a": pa.array([e[0] for e in edges], pa.binary()), "b": pa.array([e[1] for e in edges], pa.binary())})

    return task


_LINKS = "a binary, b binary"


def _families(left: DataFrame, bound: Bound, buckets: int) -> DataFrame:
    """(node, root): the families of the sets in the shards of left."""
    chosen = left.where(F.col("kind") == SETS)
    counted = group_arrow(map_arrow(chosen, _send_matched(buckets), BLOB), ("bucket",), _count, BLOB)
    said = stored(group_arrow(chosen.unionByName(counted), ("bucket",), _ask(bound, buckets), BLOB), "join-asked")
    answers = stored(group_arrow(said.where(F.col("kind") == TOKENS), ("bucket",), _answer(bound), BLOB), "join-answers")
    groups = group_arrow(said.where(F.col("kind") == GROUPS).unionByName(answers.where(F.col("kind") == TOKENS)), ("bucket",), _groups, BLOB)
    groups = stored(groups, "join-groups")
    # written before they are put together: a task that chains Python steps holds a worker for each
    ties = said.unionByName(answers).unionByName(groups).where(F.col("kind") == EDGES)
    edges = stored(map_arrow(ties, _edge_rows, _LINKS), "join-ties")
    found = components(edges)
    for used in (said, answers, groups, edges):
        discard(used)
    return found


def _large_families(large: DataFrame, bound: Bound, task_tokens: int) -> DataFrame:
    """Links of families beyond a task. large: root, words, sets (of the family), key, n, tokens.

    Blocks are ranges of sizes, those of one size split by hash. Every block is verified by itself together with some
    pivots of its family. Sets that are still outside their family's largest component visit the other blocks whose sizes
    allow links; others have nothing to gain from it, as all of them are linked to one another.
    """
    per_size = large.groupBy("root", "n").agg(F.sum("n").alias("w"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = per_size.select(F.col("root").alias("r"), F.col("n").alias("s"), F.floor(before / task_tokens).alias("range"), F.ceil(F.col("w") / task_tokens).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(5), "key"), "parts")
    block = F.concat_ws("/", F.col("range"), F.when(F.col("parts") > 1, F.concat_ws("/", F.col("n"), part)))
    big = stored(large.join(spans, (F.col("root") == F.col("r")) & (F.col("n") == F.col("s"))).select("root", "sets", "key", "n", "tokens", block.alias("block")), "join-large")
    blocks = big.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    blocks = stored(blocks.select(F.col("root").alias("r"), F.col("block").alias("to"), "low", "high"), "join-blocks")

    share = F.pmod(F.xxhash64(F.lit(9), "key"), F.lit(1_000_000)) < F.lit(4_000_000 * PIVOTS) / F.col("sets")
    turn = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64(F.lit(9), "key"), "key"))
    pivots = big.where(share).withColumn("turn", turn).where(F.col("turn") <= PIVOTS)
    pivots = pivots.join(blocks, (F.col("root") == F.col("r")) & (F.col("block") != F.col("to"))).select("root", F.col("to").alias("block"), "key", "tokens")
    first = stored(group_arrow(big.select("root", "block", "key", "tokens").unionByName(pivots), ("root", "block"), _verify(bound), _LINKS), "join-first")

    labels = components(first).withColumnRenamed("root", "label")
    named = big.join(labels, F.col("key") == F.col("node"), "left").select("root", "block", "key", "n", "tokens", F.coalesce("label", "key").alias("known"))
    main = named.groupBy("root", "known").agg(F.sum("n").alias("w")).groupBy("root").agg(F.max_by("known", F.struct("w", "known")).alias("main")).withColumnRenamed("root", "r")
    named = stored(named.join(main, F.col("root") == F.col("r")).drop("r"), "join-named")
    outside = named.where(F.col("known") != F.col("main"))
    smallest = F.floor((F.col("n") * bound.num + (bound.den - 1)) / bound.den)
    fits = (F.col("root") == F.col("r")) & (F.col("block") != F.col("to")) & (smallest <= F.col("high")) & (F.floor((F.col("low") * bound.num + (bound.den - 1)) / bound.den) <= F.col("n"))
    visits = outside.select("root", "block", "key", "n").join(blocks, fits).select("root", "to", "key", "n")
    loads = visits.groupBy("root", "to").agg(F.ceil(F.sum("n") / task_tokens).cast("int").alias("chunks"))
    loads = stored(loads.select(F.col("root").alias("r"), F.col("to").alias("t"), "chunks"), "join-loads")
    guests = visits.join(loads, (F.col("root") == F.col("r")) & (F.col("to") == F.col("t"))).select("root", F.col("to").alias("block"), F.pmod(F.xxhash64("key"), "chunks").cast("int").alias("chunk"), F.col("key").alias("k"))
    guests = guests.join(outside.select("key", "tokens", "known"), F.col("k") == F.col("key")).select("root", "block", "chunk", "key", "tokens", "known", F.lit(True).alias("visits"))
    hosts = named.join(loads, (F.col("root") == F.col("r")) & (F.col("block") == F.col("t")))
    hosts = hosts.select("root", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "key", "tokens", "known", F.lit(False).alias("visits"))
    second = stored(group_arrow(hosts.unionByName(guests), ("root", "block", "chunk"), _verify(bound), _LINKS), "join-second")
    for used in (big, named):
        discard(used)
    return first.unionByName(second)


def _linked(docs: DataFrame, size: int, num: int, den: int, task_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tag, n_shingles, key) of docs (doc_id, tag, text), and the components (node, root) of linked keys."""
    bound = Bound(num, den)
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, total // BUCKET)
    rarity = rarity_of(docs, size, total)
    met = group_arrow(map_arrow(docs, _send_tokens(size, bound, buckets, rarity), BLOB), ("bucket",), _meet_tokens(bound, buckets), BLOB)
    texts = map_arrow(docs, _send_texts(size, buckets, rarity), BLOB)
    left = stored(group_arrow(texts.unionByName(met), ("bucket",), _survive(size, bound, rarity), BLOB), "join-left")

    families = _families(left, bound, max(64, total // (16 * BUCKET)))
    sets = map_arrow(left.where(F.col("kind") == SETS), _set_rows, "key binary, n long, tokens binary")
    sizes = sets.select("key", "n").join(families, F.col("key") == F.col("node")).groupBy("root").agg(F.sum("n").alias("words"), F.count("*").alias("sets"))
    sizes = stored(sizes, "join-families")
    words = sizes.agg(F.sum("words")).first()[0] or 0
    bins = max(24, 2 * words // task_tokens)
    known = families.join(sizes.select(F.col("root").alias("r"), "words", "sets"), F.col("root") == F.col("r")).select("node", "root", "words", "sets")
    placed = sets.join(known, F.col("key") == F.col("node"))
    small = placed.where(F.col("words") <= task_tokens).select(F.pmod(F.xxhash64("root"), F.lit(bins)).alias("task"), "key", "tokens")
    links = stored(group_arrow(small, ("task",), _verify(bound), _LINKS), "join-small")
    if not sizes.where(F.col("words") > task_tokens).isEmpty():
        large = placed.where(F.col("words") > task_tokens).select("root", "words", "sets", "key", "n", "tokens")
        links = links.unionByName(_large_families(large, bound, task_tokens))
    roots = components(links)
    rows = stored(map_arrow(left.where(F.col("kind") == DOCS), _doc_rows, "doc_id long, tag long, n_shingles long, key binary"), "join-rows")
    discard(left)
    discard(families)
    return rows, roots


def join(docs: DataFrame, size: int = 3, num: int = 9, den: int = 10, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text): shingles of size words, similarity num / den or more."""
    rows, roots = _linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tag"), "text"), size, num, den, task_tokens)
    classes = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = classes.join(roots, F.col("key") == F.col("node"), "left").where(F.col("root").isNotNull() | (F.col("copies") > 1))
    of_root = classes.groupBy(F.coalesce("root", "key").alias("r")).agg(F.min("least").alias("component"))
    components_ = classes.select("key", F.coalesce("root", "key").alias("r2")).join(of_root, F.col("r2") == F.col("r")).select(F.col("key").alias("k"), "component")
    out = rows.join(components_, F.col("key") == F.col("k"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """docs without near copies: of each component one row of the least doc_id stays. Rows without words and rows with a null doc_id stay. Columns pass.

    Decided by row (two 64-bit hashes of doc_id and text name it): two texts of one doc_id are two rows, of which an
    unlinked one stays; of equal rows one stays. Clashing column names do no harm, an empty table gives none.
    """
    text, id_ = F.col("text"), F.col("doc_id").cast("long")
    docs = docs.withColumns({"__row": F.xxhash64(id_, text), "__tag": F.xxhash64(F.lit(1), text, id_)})
    rows, roots = _linked(docs.select(F.col("__row").alias("doc_id"), F.col("__tag").alias("tag"), "text"), size, num, den, task_tokens)
    named = rows.where("n_shingles > 0").select(F.col("doc_id").alias("__row"), F.col("tag").alias("__tag"), "key")
    named = named.join(roots, F.col("key") == F.col("node"), "left").select("__row", "__tag", F.coalesce("root", "key").alias("component"))
    named = named.groupBy("__row", "__tag").agg(F.first("component").alias("component"), F.count("*").alias("n"))
    ids = docs.where(F.col("doc_id").isNotNull()).select("__row", "__tag", id_.alias("id")).distinct()
    found = stored(named.join(ids, ["__row", "__tag"]), "join-found")
    first = found.groupBy("component").agg(F.min(F.struct("id", "__row", "__tag")).alias("first"))
    stays = (F.col("__row") == F.col("first.__row")) & (F.col("__tag") == F.col("first.__tag"))
    decided = stored(found.join(first, "component").select("__row", "__tag", stays.alias("stays"), "n").where("not stays or n > 1"), "join-gone")
    discard(found)
    # names of rows that go are sent to the texts up to a number that is checked; beyond it both are shuffled
    near = F.broadcast if decided.count() <= SENT_ROWS else lambda df: df
    kept = docs.join(near(decided.where("not stays").select("__row", "__tag")), ["__row", "__tag"], "left_anti")
    again = near(decided.where("stays").select("__row", "__tag"))
    if not again.isEmpty():
        single = kept.join(again, ["__row", "__tag"], "left_semi").dropDuplicates(["__row", "__tag"])
        kept = kept.join(again, ["__row", "__tag"], "left_anti").unionByName(single)
    return kept.drop("__row", "__tag")


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
