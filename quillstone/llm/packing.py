"""Packed arrays as rows: (bucket, kind, data). One row holds many entries, so a shuffle moves few, compressed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from quillstone.llm.hashing import mix

BLOB = "bucket int, kind int, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
    out, at = [], 8 * (n + 1)
    for size, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at))
        at += size
    return out


def unpack_all(blobs: list[bytes], *types) -> list[np.ndarray]:
    parts = [unpack(b, *types) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(types)]


def row(bucket: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["bucket", "kind", "data"])


def place(ids: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tags.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def by_bucket(buckets: np.ndarray, kind: int, arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    sorted_ = buckets[order]
    cuts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        yield row(int(sorted_[a]), kind, pack(*(x[order[a:b]] for x in arrays)))


def first_of(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
