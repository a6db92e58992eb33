"""Suffix-array deduplication of repeated byte strings across a corpus, by deep-shallow sorting.

Every byte covered by a string of LENGTH bytes that also starts earlier in the corpus (smaller doc_id, or the same
document further left) is removed; matches never cross documents and are judged on the input.

1. Each window of LENGTH bytes picks an anchor: the leftmost of its GRAM-byte grams whose hash is least. Equal windows
   pick it at the same offset, so windows are compared anchor by anchor; the windows of one anchor form a context. Hashes
   only say which contexts can meet, bytes decide.
2. Grams meet, with the bucket of their document only. Those that stand more than once go back to these buckets; within a
   flush of a task they do so at once, and one entry meets those of other tasks. There anchors are picked once more.
3. Contexts are sorted twice by deep-shallow sorting: the suffixes that start at the anchors, and the reversed strings that
   end before them. A window at offset o before its anchor equals another if the two agree in o bytes on the left and
   LENGTH - o on the right; both are runs of the sorted orders by their common prefixes. This is done first in the
   documents' own bucket, which leaves one context of many equal ones, then among those left in all buckets.
4. There they meet by longer strings than the gram: windows that reach far to the left by half a window before the gram,
   others by half a window after it. So a gram that begins very many different contexts is dealt out.
5. Spans go back to their documents, which meet them by a hash of (doc_id, text hash).

Only packed arrays are shuffled, each bucket of bounded size at any corpus size (bucket counts follow the bytes).
Texts are shuffled compressed, once for the contexts and once for the result.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing; a null doc_id comes after all others; rows
that repeat both doc_id and text are one document, judged once, and each such row shows its result; documents with one
doc_id but different texts are ordered by a hash of the text. Other columns pass through in remove().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import deep_shallow
from quillstone.llm.common import group_arrow, map_arrow, slices, table, text_bytes
from quillstone.llm.hashing import mix
from quillstone.llm.packing import BLOB, by_bucket, first_of, pack, place, row, schema, unpack, unpack_all

LENGTH = 100
GRAM = 24
#: Bytes of text worked on at a time, held back before anchors are sent, and meant for one bucket.
CHUNK, FLUSH, BUCKET = 1 << 20, 16 << 20, 8 << 20
#: Contexts sorted at a time, where no key holds more.
RUN = 50_000
NO_ID = np.iinfo(np.int64).max


class _Hasher:
    """A polynomial hash, modulo 2**64 over random byte values, of all substrings of one size from prefix sums."""

    def __init__(self, most: int):
        self.values = np.random.default_rng(20240607).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x5851F42D4C957F2D
        powers = lambda f: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(most, f, np.uint64)]), dtype=np.uint64)
        self.powers, self.inverses = powers(base), powers(pow(base, -1, 1 << 64))

    def grams(self, data: np.ndarray, size: int) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * self.inverses[: len(data) - size + 1])


_HASHERS: dict[int, _Hasher] = {}


def hasher(most: int) -> _Hasher:
    size = 1 << max(21, (most + 1).bit_length())
    if size not in _HASHERS:
        _HASHERS.clear()
        _HASHERS[size] = _Hasher(size)
    return _HASHERS[size]


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    rows = -(-n // w)
    full = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(rows, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For the texts data[bounds[d]:bounds[d+1]]: document, place of anchor, first and last window start that pick it (places in data), gram hash."""
    none = (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    n = len(data)
    if n < length:
        return none
    starts = np.arange(n - gram + 1)
    grams = hasher(n).grams(data, gram)
    place_bits = np.uint64(24)
    keyed = (grams >> place_bits << place_bits) | starts.astype(np.uint64)
    picked = (_window_min(keyed, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)  # of window i
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(picked)]
    valid = bounds[doc + 1] - np.arange(len(picked)) >= length
    change = np.ones(len(picked), bool)
    change[1:] = (picked[1:] != picked[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:] != doc[:-1])
    lows = np.flatnonzero(change)
    highs = np.append(lows[1:], len(picked)) - 1
    good = valid[lows]
    lows, highs = lows[good], highs[good]
    at = picked[lows]
    return doc[lows], at, lows, highs, grams[at]


def _pieces(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of about CHUNK bytes: the first document, its bounds in data, and where in the text each begins. A text over CHUNK is cut into pieces that overlap by length - 1 bytes: each window lies in just one."""
    d, n = 0, len(bounds) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(bounds, bounds[d] + CHUNK, side="right")) - 1)
        if e > d + 1 or bounds[e] - bounds[d] <= 2 * CHUNK:
            yield d, bounds[d : e + 1], np.zeros(e - d, np.int64)
        else:
            for start in range(0, max(1, int(bounds[e] - bounds[d]) - length + 1), CHUNK):
                yield d, bounds[d] + np.array([start, min(int(bounds[e] - bounds[d]), start + CHUNK + length - 1)]), np.array([start])
        d = e


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)


_FLAG = (np.uint64, np.int64, np.int64, np.uint32, np.uint8, np.uint8)  # key, id, tag, place, least and greatest offset
_GRAM = (np.uint64, np.int32, np.uint8)  # gram, bucket of its document, whether it is known to stand more than once
_SPAN = (np.int64, np.int64, np.uint32, np.uint32)  # id, tag, first window start, last
LEFT, MET, TEXT, SPAN, RIGHT, GRAM_OF = range(6)


def _send_grams(length: int, gram: int, buckets: int):
    """Grams of anchors that stand more than once in a flush to their documents' buckets, and one entry for each gram to those of other tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            grams, own = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((own, grams))
            grams, own = grams[order], own[order]
            head = first_of(grams)
            known = ~head | np.append(~head[1:], False)
            once = known & first_of(grams, own)
            yield from by_bucket(own[once], MET, [grams[once]])
            yield from by_bucket((grams[head] % np.uint64(buckets)).astype(np.int32), GRAM_OF, [grams[head], own[head], known[head].astype(np.uint8)])

        for batch in slices(batches, "text", CHUNK):
            data, bounds = text_bytes(batch.column("text"))
            own = place(*_ids(batch), buckets)
            for d, cuts, _ in _pieces(data, bounds, length):
                doc, _, _, _, grams = anchors(data[cuts[0] : cuts[-1]], cuts - cuts[0], length, gram)
                held.append((grams, own[d + doc]))
            size += len(data)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return task


def _meet(buckets: int):
    """Grams that other tasks have too, back to their documents' buckets; what is known already passes."""

    def task(group: pa.Table) -> pa.Table:
        bucket = int(group.column("bucket")[0].as_py())
        grams, own, known = unpack_all(_blobs(group, GRAM_OF), *_GRAM)
        order = np.argsort(grams, kind="stable")
        grams, own, known = grams[order], own[order], known[order]
        head = first_of(grams)
        several = (~head | np.append(~head[1:], False)) & (known == 0) if len(head) else head
        out = [row(bucket, MET, blob) for blob in _blobs(group, MET)]
        return pa.Table.from_batches([*out, *by_bucket(own[several], MET, [grams[several]])], schema())

    return task


def _join_spans(ids, tags, first, last) -> tuple[np.ndarray, ...]:
    """Runs of window starts of one document that touch or overlap, joined (input sorted by document and start)."""
    if not len(ids):
        return tuple(np.zeros(0, t) for t in _SPAN)
    doc = np.cumsum(first_of(ids, tags)) - 1
    base = doc * np.int64(1 << 33)
    reach = np.maximum.accumulate(last + base)
    new = np.ones(len(ids), bool)
    new[1:] = first[1:] + base[1:] > reach[:-1] + 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(ids)) - 1
    return ids[starts], tags[starts], first[starts].astype(np.uint32), (reach[ends] - base[ends]).astype(np.uint32)


def _ipc(batch: pa.RecordBatch) -> np.ndarray:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return np.frombuffer(sink.getvalue(), np.uint8)


def _send_texts(buckets: int, others: tuple[str, ...] = ()):
    """Whole texts by document bucket, a zstandard frame for each flush and bucket: ids, tags, lengths, bytes, and other columns."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rest, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            data, ids, tags, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            table_ = pa.Table.from_batches(rest).combine_chunks() if others else None
            ends = np.cumsum(lengths)
            buckets_ = place(ids, tags, buckets)
            order = np.argsort(buckets_, kind="stable")
            sorted_ = buckets_[order]
            cuts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                some = order[a:b]
                extra = _ipc(table_.take(pa.array(some)).combine_chunks().to_batches()[0]) if others else np.zeros(0, np.uint8)
                yield row(int(sorted_[a]), TEXT, pack(ids[some], tags[some], lengths[some], np.concatenate([data[ends[k] - lengths[k] : ends[k]] for k in some]), extra))

        for batch in slices(batches, "text", CHUNK):
            data, bounds = text_bytes(batch.column("text"))
            held.append((data, *_ids(batch), np.diff(bounds)))
            if others:
                rest.append(batch.select(list(others)))
            size += len(data)
            if size >= FLUSH:
                yield from flush()
                held, rest, size = [], [], 0
        if held:
            yield from flush()

    return task


_TEXTS = (np.int64, np.int64, np.int64, np.uint8, np.uint8)


def _texts(group: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(unpack_all(_blobs(group, TEXT), *_TEXTS))[:4]


def _blobs(group: pa.Table, kind: int) -> list[bytes]:
    kinds = group.column("kind").to_numpy()
    return [group.column("data")[int(k)].as_py() for k in np.flatnonzero(kinds == kind)]


def _find(ids, tags, of_ids, of_tags) -> np.ndarray:
    """Index of the first document with each key; every key is there."""
    n = len(of_ids)
    a, b = np.concatenate([of_ids, ids]), np.concatenate([of_tags, tags])
    order = np.lexsort((b, a))  # stable: documents come before what looks for them
    new = first_of(a[order], b[order])
    out = np.empty(len(a), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out[n:]


def _spans_of(found: np.ndarray, ids, tags, places) -> tuple[np.ndarray, ...]:
    """Spans of window starts that a matrix (context, offset) marks."""
    edge = np.zeros((len(found), found.shape[1] + 2), np.int8)
    edge[:, 1:-1] = found
    steps = np.diff(edge, axis=1)
    which, first = np.nonzero(steps == 1)
    _, last = np.nonzero(steps == -1)
    at = places[which].astype(np.int64)
    start, stop = at - (last - 1), at - first
    order = np.lexsort((start, tags[which], ids[which]))
    return _join_spans(ids[which][order], tags[which][order], start[order], stop[order])


def _runs(keys: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of keys that stand more than once, key by key, in runs of about most; no key is parted."""
    order = np.argsort(keys, kind="stable")
    head = first_of(keys[order])
    order = order[~head | np.append(~head[1:], False)] if len(order) else order
    cuts = np.flatnonzero(first_of(keys[order]))
    start = 0
    while start < len(order):
        later = cuts[np.searchsorted(cuts, start + most) :]
        stop = int(later[0]) if len(later) else len(order)
        yield order[start:stop]
        start = stop


def _hash_rows(strings: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), np.uint8)
    padded[:, : strings.shape[1]] = strings
    out = np.zeros(len(strings), np.uint64)
    for word in padded.view(np.uint64).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out


class _Sides:
    """The two ways in which contexts meet: by half a window before the gram (offsets from half on), or after it (others)."""

    def __init__(self, length: int, gram: int):
        self.reach, self.half = length - gram, (length - gram) // 2
        self.length, self.gram = length, gram
        self.before = {LEFT: self.reach, RIGHT: self.half - 1}  # bytes before the anchor
        self.after = {LEFT: length - self.half, RIGHT: length}

    def offsets(self, kind: int, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (np.maximum(least, self.half), most) if kind == LEFT else (least, np.minimum(most, self.half - 1))

    def key(self, kind: int, strings: np.ndarray) -> np.ndarray:
        at = self.reach
        return _hash_rows(strings[:, at - self.half : at + self.gram] if kind == LEFT else strings[:, at : at + self.length - self.half + 1])

    def part(self, kind: int, strings: np.ndarray) -> np.ndarray:
        return strings[:, self.reach - self.before[kind] : self.reach + self.after[kind]]


def _contexts(length: int, gram: int, buckets: int):
    """Contexts of a bucket's own documents: repeats among them, and what is left for those of other buckets."""
    sides = _Sides(length, gram)

    def task(group: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        (met,) = unpack_all(_blobs(group, MET), np.uint64)
        met = np.unique(met)
        if len(met):
            of_ids, of_tags, lengths, data = _texts(group)
            bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            order = np.lexsort((of_tags, of_ids))
            once = np.zeros(len(order), bool)
            once[order[first_of(of_ids[order], of_tags[order])]] = True  # rows that repeat a document are one
            held: list[list[np.ndarray]] = [[x[:0] for x in (met, of_ids, of_tags, np.zeros(0, np.uint32), *(np.zeros(0, np.uint8),) * 2, bounds)]]
            for d, cuts, starts in _pieces(data, bounds, length):
                doc, at, lows, highs, grams = anchors(data[cuts[0] : cuts[-1]], cuts - cuts[0], length, gram)
                some = np.flatnonzero(once[d + doc] & (met[np.minimum(np.searchsorted(met, grams), len(met) - 1)] == grams))
                doc, at, lows, highs = doc[some], at[some], lows[some], highs[some]
                where = at + cuts[0] - cuts[doc] + starts[doc]
                held.append([grams[some], of_ids[d + doc], of_tags[d + doc], where.astype(np.uint32), (at - highs).astype(np.uint8), (at - lows).astype(np.uint8), at + cuts[0]])
            grams, ids, tags, places, least, most, at = (np.concatenate(x) for x in zip(*held, strict=True))
            at = at.astype(np.int64)
            padded = np.concatenate([np.zeros(sides.reach, np.uint8), data, np.zeros(length, np.uint8)])
            strings_of = lambda some: padded[at[some, None] + np.arange(sides.reach + length)]
            left = np.ones(len(grams), bool)
            for some in _runs(grams, RUN):
                s = strings_of(some)
                found = repeats(s[:, : sides.reach][:, ::-1], s[:, sides.reach :], *(x[some] for x in (ids, tags, places, least, most)), length)
                left[some] = found.sum(axis=1) < most[some].astype(np.int64) - least[some] + 1
                spans = _spans_of(found, ids[some], tags[some], places[some])
                out += by_bucket(np.full(len(spans[0]), int(group.column("bucket")[0].as_py()), np.int32), SPAN, list(spans))
            rest = np.flatnonzero(left)
            for a in range(0, len(rest), RUN):
                for kind in (LEFT, RIGHT):
                    some = rest[a : a + RUN]
                    low, high = sides.offsets(kind, least[some], most[some])
                    some, low, high = some[low <= high], low[low <= high], high[low <= high]
                    s = strings_of(some)
                    key = sides.key(kind, s)
                    out += by_bucket((key % np.uint64(buckets)).astype(np.int32), kind, [key, ids[some], tags[some], places[some], low.astype(np.uint8), high.astype(np.uint8), sides.part(kind, s)])
        return pa.Table.from_batches(out, schema())

    return task


def _heads(order: np.ndarray, common: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted order and its common prefixes, of chosen rows only; they are numbered anew."""
    number = np.cumsum(chosen) - 1
    at = np.flatnonzero(chosen[order])
    out = np.zeros(len(at), np.int64)
    if len(at) > 1:
        out[1:] = np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1)
    return number[order[at]], out


def repeats(left: np.ndarray, right: np.ndarray, ids, tags, places, least, most, length: int = LENGTH) -> np.ndarray:
    """Matrix: is the window of context c at offset o the same as an earlier one? left: reversed strings before the anchors.

    Of contexts that the sorted orders find equal from end to end, with the same offsets, the earliest goes on.
    """
    n, reach = left.shape
    offsets = np.arange(reach + 1)
    by_right, common_right = deep_shallow.sort(np.ascontiguousarray(right))
    by_left, common_left = deep_shallow.sort(np.ascontiguousarray(left))
    rank = np.empty(n, np.int64)
    rank[np.lexsort((places, tags, ids))] = np.arange(n)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    right_class[by_right] = np.cumsum(common_right < right.shape[1])
    left_class[by_left] = np.cumsum(common_left < reach)
    order = np.lexsort((rank, most, least, left_class, right_class))
    first = np.zeros(n, bool)
    first[order] = first_of(*(x[order] for x in (right_class, left_class, least, most)))
    out = ~first[:, None] & (least[:, None] <= offsets) & (offsets <= most[:, None])
    heads = np.flatnonzero(first)
    (by_right, common_right), (by_left, common_left) = _heads(by_right, common_right, first), _heads(by_left, common_left, first)
    rank, least, most = rank[heads], least[heads], most[heads]
    m = len(heads)
    right_class, left_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(int(least.min()), int(most.max()) + 1) if m > 1 else ():
        some = np.flatnonzero((least <= o) & (o <= most))
        if len(some) < 2:
            continue
        right_class[by_right] = np.cumsum(common_right < length - o)
        left_class[by_left] = np.cumsum(common_left < o)
        key = right_class[some] * (m + 1) + left_class[some]
        order = np.lexsort((rank[some], key))
        again = np.zeros(len(some), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        out[heads[some[again]], o] = True
    return out


def _compare(length: int, gram: int, buckets: int):
    """Repeats among contexts of all buckets; spans found before pass."""
    sides = _Sides(length, gram)

    def task(group: pa.Table) -> pa.Table:
        bucket = int(group.column("bucket")[0].as_py())
        out = [row(bucket, SPAN, blob) for blob in _blobs(group, SPAN)]
        for kind in (LEFT, RIGHT):
            before = sides.before[kind]
            keys, ids, tags, places, least, most, strings = unpack_all(_blobs(group, kind), *_FLAG, np.uint8)
            strings = strings.reshape(len(keys), before + sides.after[kind])
            for some in _runs(keys, RUN):
                s = strings[some]
                found = repeats(s[:, :before][:, ::-1], s[:, before:], *(x[some] for x in (ids, tags, places, least, most)), length)
                spans = _spans_of(found, ids[some], tags[some], places[some])
                out += by_bucket(place(spans[0], spans[1], buckets), SPAN, list(spans))
        return pa.Table.from_batches(out, schema())

    return task


def _covered(group: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """ids, tags, text bounds, bytes, and which bytes are to be removed."""
    ids, tags, lengths, data = _texts(group)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    of_ids, of_tags, first, last = unpack_all(_blobs(group, SPAN), *_SPAN)
    steps = np.zeros(len(data) + 1, np.int32)
    if len(of_ids):
        head = np.lexsort((tags, ids))
        copies = np.zeros(len(ids), np.int64)  # the document that stands for each row
        new = first_of(ids[head], tags[head])
        copies[head] = head[new][np.cumsum(new) - 1]
        doc = _find(of_ids, of_tags, ids[head[new]], tags[head[new]])
        base = bounds[head[new]][doc]
        np.add.at(steps, base + first, 1)
        np.add.at(steps, base + last + length, -1)
        np.cumsum(steps, out=steps)
        gone = steps[:-1] > 0
        for d in np.flatnonzero(copies != np.arange(len(ids))):
            gone[bounds[d] : bounds[d + 1]] = gone[bounds[copies[d]] : bounds[copies[d] + 1]]
    else:
        gone = np.zeros(len(data), bool)
    return ids, tags, bounds, data, gone


def _digest(length: int):
    def task(group: pa.Table) -> pa.Table:
        ids, _, bounds, data, gone = _covered(group, length)
        counts = np.zeros(len(gone) + 1, np.int32)
        np.cumsum(gone, out=counts[1:])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = bounds[:-1][np.diff(bounds) > 0]
        begins[inner] = gone[inner]  # spans never go on from one document to the next
        runs = np.zeros(len(gone) + 1, np.int32)
        np.cumsum(begins, out=runs[1:])
        kept = [hashlib.sha256(data[bounds[d] : bounds[d + 1]][~gone[bounds[d] : bounds[d + 1]]].tobytes()).hexdigest() for d in range(len(ids))]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
                "n_bytes": pa.array(np.diff(bounds)),
                "n_removed": pa.array((counts[bounds[1:]] - counts[bounds[:-1]]).astype(np.int64)),
                "n_spans": pa.array((runs[bounds[1:]] - runs[bounds[:-1]]).astype(np.int64)),
                "kept_sha256": pa.array(kept, pa.string()),
            }
        )

    return task


def _kept_rows(length: int, names: list[str]):
    """Rows with their other columns and what is left of the text."""

    def task(group: pa.Table) -> pa.Table:
        _, _, bounds, data, gone = _covered(group, length)
        parts = [pa.ipc.open_stream(unpack(b, *_TEXTS)[4].tobytes()).read_all() for b in _blobs(group, TEXT)]
        if not parts:
            return pa.table({n: pa.nulls(0) for n in [*names, "kept"]})
        others = pa.concat_tables(parts)
        nulls = others.column("no_text").to_pylist()
        kept = []
        for d, none in enumerate(nulls):
            text = data[bounds[d] : bounds[d + 1]]
            cut = gone[bounds[d] : bounds[d + 1]]
            kept.append(None if none else (text[~cut] if cut.any() else text).tobytes().decode("utf-8", "ignore"))
        return others.select(names).append_column("kept", pa.array(kept, pa.string()))

    return task


def _bytes_of(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _repeated(docs: DataFrame, texts: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """Packed spans of repeated windows by document bucket. docs: doc_id long, text string, tag long; texts: what _send_texts made of them."""
    met = group_arrow(map_arrow(docs, _send_grams(length, gram, buckets), BLOB), ("bucket",), _meet(buckets), BLOB)
    contexts = group_arrow(texts.unionByName(met), ("bucket",), _contexts(length, gram, buckets), BLOB)
    return group_arrow(contexts, ("bucket",), _compare(length, gram, buckets), BLOB)


def _key_columns() -> tuple:
    return F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag")


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    docs = docs.select(*_key_columns())
    buckets = max(64, _bytes_of(docs) // BUCKET)
    texts = map_arrow(docs, _send_texts(buckets), BLOB)
    found = _repeated(docs, texts, length, gram, buckets)
    return group_arrow(texts.unionByName(found), ("bucket",), _digest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated bytes taken out of text; a character cut at a span's edge goes whole. Other columns travel with the text."""
    others = [c for c in docs.columns if c != "text"]
    safe = [f"c{k}" for k in range(len(others))]
    full = docs.select(*_key_columns(), F.col("text").isNull().alias("no_text"), *(F.col(f"`{c}`").alias(s) for c, s in zip(others, safe, strict=True)))
    keyed = full.select("doc_id", "text", "tag")
    buckets = max(64, _bytes_of(keyed) // BUCKET)
    found = _repeated(keyed, map_arrow(keyed, _send_texts(buckets), BLOB), length, gram, buckets)
    texts = map_arrow(full, _send_texts(buckets, ("no_text", *safe)), BLOB)
    kinds = ", ".join(f"{s} {docs.schema[c].dataType.simpleString()}" for c, s in zip(others, safe, strict=True))
    rows = group_arrow(texts.unionByName(found), ("bucket",), _kept_rows(length, safe), f"{kinds}, kept string" if kinds else "kept string")
    back = dict(zip(others, safe, strict=True))
    return rows.select(*(F.col("kept" if c == "text" else back[c]).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
