"""Byte-level BPE encoding and decoding as a monoid: halves are encoded and joined at their boundary.

A piece (one match of the pattern) is cut in halves down to single bytes. Two encodings are joined by encoding again a
window of tokens around their boundary. A sequence of tokens is the encoding of its bytes if and only if every adjacent
pair is the encoding of its own bytes, so as soon as the window's first and last tokens come out as they were, the pairs
across its ends are pairs that already stood in a valid encoding, and nothing outside can change. Until then the window
doubles. Pieces do not act on each other: above them the same tree concatenates. Decoding concatenates bytes up a tree.

Memory: texts are cut into matches lazily and hashed in runs of RUN tokens; known pieces, subtrees and windows are kept in
two tables each of at most KNOWN or SUBTREES entries, the older of which is dropped when the younger is full. Ranks are read once by
each Python worker from the file given.

Defined cases: a null text counts as empty (no tokens, hash of nothing); special tokens are ordinary text; repeated rows
are coded each; an empty table gives none; null ids decode to null. An input column with the name of a new one, in any
case, is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import map_arrow, slices, table

#: Windows beyond so many bytes are merged with a heap.
LONG = 192
#: Subtrees of up to so many bytes are kept.
PART = 8
RUN = 65_536
KNOWN = 250_000
#: Subtrees and windows of a table, of which there are two each.
SUBTREES = 60_000
#: Neighbours that the lowest level of a concatenation tree puts together.
FAN = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = _Kept(lambda piece: self.encode_piece(piece.encode("utf-8", "surrogatepass")))
        self.windows: dict[bytes, tuple[int, ...]] = _Kept(lambda data: tuple(self.merge(data)), 64, SUBTREES)
        self.parts: dict[bytes, tuple[int, ...]] = _Kept(self._tree, PART, SUBTREES)  # subtrees
        self.joins = 0  # of two parts that both have tokens

    def forget(self) -> None:
        """Drop what is kept from texts: a worker lives on when its task has ended."""
        for kept in (self.known, self.windows, self.parts):
            kept.clear()
            kept.old = {}

    # ---- windows

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: merge the leftmost adjacent pair of lowest rank until none is left."""
        if len(data) > LONG:
            return self._merge_long(data)
        rank, none = self.ranks.get, len(self.ranks) + 1
        if (whole := rank(data)) is not None:  # every token is the encoding of its own bytes
            return [whole]
        cuts = list(range(len(data) + 1))  # bounds of the parts
        scores = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while scores:
            best = min(scores)
            if best == none:
                break
            i = scores.index(best)
            del cuts[i + 1], scores[i]
            if i < len(scores):
                scores[i] = rank(data[cuts[i] : cuts[i + 2]], none)
            if i:
                scores[i - 1] = rank(data[cuts[i - 1] : cuts[i + 1]], none)
        return [rank(data[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over linked parts, n log n: for windows that would not stabilise."""
        ranks, n = self.ranks, len(data)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], alive[j], after[i] = stop, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := ranks.get(data[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    # ---- the monoid

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left + right
        self.joins += 1
        of, width = self.bytes_of, 1
        window = self.windows[of[left[-1]] + of[right[0]]]
        if window == (left[-1], right[0]):
            return left + right
        while True:
            outside_left, outside_right = left[:-width], right[width:]
            if (not outside_left or window[0] == left[-width]) and (not outside_right or window[-1] == right[width - 1]):
                return outside_left + window + outside_right
            width *= 2
            window = self.windows[b"".join([of[x] for x in left[-width:] + right[:width]])]

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """One match of the pattern, by tree reduction; a match that is a token is that token."""
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self._tree(data)

    def _tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) < 2:
            return tuple(self.ranks[data[i : i + 1]] for i in range(len(data)))
        half = len(data) // 2
        below = self.parts.__getitem__ if len(data) <= 2 * PART - 1 else self._tree
        return self.join(below(data[:half]), below(data[half:]))

    # ---- texts

    def runs(self, text: str) -> Iterator[list[int]]:
        """The ids of a whole text, in lists of bounded length (a single long piece may exceed it)."""
        known, pattern = self.known, self.pattern
        if len(text) <= RUN:
            yield up(list(map(known.__getitem__, pattern.findall(text))), ())
            return
        pieces = (m.group() for m in pattern.finditer(text))
        while some := list(islice(pieces, RUN)):
            yield up(list(map(known.__getitem__, some)), ())

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.runs(text or "")))

    def decode(self, ids: Iterable[int]) -> bytes:
        return up(list(map(self.bytes_of.__getitem__, ids)))


def up(parts: list, none=b""):
    """Neighbours concatenated level by level to the root of their tree, FAN at the lowest level and two above; none for no parts."""
    if len(parts) > 2:
        together = b"".join if none == b"" else _flat
        parts = [together(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
    while len(parts) > 1:
        odd = parts[-1:] if len(parts) % 2 else []
        parts = list(map(add, parts[::2], parts[1::2])) + odd
    return parts[0] if parts else none


def _flat(parts: list[tuple[int, ...]]) -> tuple[int, ...]:
    return tuple(chain.from_iterable(parts))


class _Kept(dict):
    """Results by key, in two generations: when the young one is full it becomes the old one, so keys in use stay."""

    def __init__(self, of: Callable, longest: int = 64, most: int = KNOWN):
        self.of, self.longest, self.most = of, longest, most
        self.old: dict = {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.of(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _others(df: DataFrame, *new: str) -> tuple[list[str], str]:
    """Columns that stay beside new ones, and their part of a schema."""
    kept = [f for f in df.schema if f.name.lower() not in {n.lower() for n in new}]
    return [f.name for f in kept], "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>); other columns pass through."""
    names, others = _others(docs, ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in slices(batches, text, 4 << 20):
            lists = pa.array([coder.encode(t.as_py()) for t in batch.column(text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], [*names, ids])
        coder.forget()

    return map_arrow(docs, task, f"{others}`{ids}` array<int>")


def decode_column(coded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with a column of the bytes that its token ids stand for; null ids give null."""
    names, others = _others(coded, out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            data = pa.array([None if x is None else coder.decode(x) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), data], [*names, out])

    return map_arrow(coded, task, f"{others}`{out}` binary")


def encode_and_check(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs without its text, with ids (array<int>) and decoded_sha256, the hash of the bytes that the ids decode to. One worker does both, so one vocabulary is held for each task."""
    names, others = _others(docs, text, "ids", "decoded_sha256")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in slices(batches, text, 1 << 20):
            values, bounds, hashes = array("i"), [0], []
            for t in batch.column(text):
                of_bytes = hashlib.sha256()
                for ids in coder.runs(t.as_py() or ""):
                    values.extend(ids)
                    of_bytes.update(coder.decode(ids))
                bounds.append(len(values))
                hashes.append(of_bytes.hexdigest())
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(values)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids, pa.array(hashes, pa.string())], [*names, "ids", "decoded_sha256"])
        coder.forget()

    return map_arrow(docs, task, f"{others}ids array<int>, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text: encoded and decoded run by run in one pass, so no list of ids leaves the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        digits = [str(i) for i in range(max(coder.bytes_of) + 1)]
        for batch in slices(batches, "text", 4 << 20):
            counts, id_hashes, byte_hashes = [], [], []
            for text in batch.column("text"):
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for ids in coder.runs(text.as_py() or ""):
                    if ids:
                        of_ids.update((" " * (n > 0) + " ".join(map(digits.__getitem__, ids))).encode())
                        of_bytes.update(coder.decode(ids))
                        n += len(ids)
                counts.append(n)
                id_hashes.append(of_ids.hexdigest())
                byte_hashes.append(of_bytes.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hashes), pa.array(byte_hashes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.forget()

    return map_arrow(docs.select("doc_id", "text"), task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *public_vocabulary())
