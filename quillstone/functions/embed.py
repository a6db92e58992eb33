"""A deterministic embedder: hashed words and word pairs with signs, at length 1 (feature hashing). Any function of a list of texts to a matrix can stand in its place.

Places and signs come from MD5, so that SQL engines can compute the same vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 128
#: Texts counted at once, features hashed at once, and the number from which that is faster than one by one.
_SLICE, _AT_ONCE, _FEW = 256, 4_096, 600
#: MD5: rotations and constants of its 64 steps. Messages of up to 55 bytes are one block.
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_ONE_BLOCK = 55
#: By length of a message: its bytes in the block, and what follows them there.
_MASKS = np.where(np.arange(64) < np.arange(_ONE_BLOCK + 1)[:, None], 255, 0).astype(np.uint8).view("<u4")
_ENDS = np.array([[*bytes(n), 0x80, *bytes(55 - n), n * 8 & 0xFF, n * 8 >> 8, *bytes(6)] for n in range(_ONE_BLOCK + 1)], np.uint8).view("<u4")


def words_of(text: str) -> list[str]:
    r"""The runs of \w in a text in lower case."""
    text = text.lower()
    for c in set(text):
        if not (c.isalnum() or c == "_"):
            text = text.replace(c, " ")
    return text.split()


def _blocks_hashed(blocks: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of padded one-block messages, given as 16 little-endian words by messages."""
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(blocks.shape[1], x) for x in first)
    for i, (turn, sine) in enumerate(zip(_TURNS, _SINES, strict=True)):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += sine
        f += blocks[g]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    return (a + first[0]).byteswap()


def _hashes(buffer: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of stretches of a buffer."""
    out = np.zeros(len(start), np.int64)
    short = np.flatnonzero(size <= _ONE_BLOCK) if len(start) >= _FEW else np.zeros(0, np.int64)
    windows = np.ndarray(len(buffer) + 1, "V64", buffer + bytes(64), strides=(1,))
    for at in range(0, len(short), _AT_ONCE):
        some = short[at : at + _AT_ONCE]
        block = windows[start[some]].view("<u4").reshape(-1, 16) & _MASKS[size[some]] | _ENDS[size[some]]
        out[some] = _blocks_hashed(np.ascontiguousarray(block.T))
    for i in np.flatnonzero(size > _ONE_BLOCK) if len(short) else range(len(start)):
        out[i] = int.from_bytes(hashlib.md5(buffer[start[i] : start[i] + size[i]]).digest()[:4])
    return out


def counts(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """Signed counts of each text's words and word pairs by place. width divides 65,536."""
    out = np.zeros((len(texts), width))
    for a in range(0, len(texts), _SLICE):
        words: list[str] = []
        numbers = []
        for text in texts[a : a + _SLICE]:
            own = words_of(text)
            words += own
            numbers.append(len(own))
        if not words:
            continue
        buffer = " ".join(words).encode()
        size = np.fromiter(map(len, words) if len(buffer) == sum(map(len, words)) + len(words) - 1 else map(len, map(str.encode, words)), np.int64, len(words))
        stop = np.cumsum(size + 1) - 1
        start, of = stop - size, np.repeat(np.arange(len(numbers)), numbers)
        pair = np.flatnonzero(of[1:] == of[:-1])  # a word pair stands in the buffer as it is hashed
        h = _hashes(buffer, np.append(start, start[pair]), np.append(size, stop[pair + 1] - start[pair]))
        at = np.append(of, of[pair]) * width + (h & 0xFFFF) % width
        out[a : a + _SLICE] = np.bincount(at, np.where(h & 0x80000000, 1.0, -1.0), len(numbers) * width).reshape(-1, width)
    return out


def embed(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """One row for each text; a text without words is a zero row. width divides 65,536."""
    out = counts(texts, width)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norms, 1e-10)


def packed(texts: list[str]) -> list[bytes]:
    """The counts of each text as bytes: two for each place, four where one does not fit."""
    all_ = counts(texts)
    wide = np.abs(all_).max(1, initial=0) >= 1 << 15
    return [x.tobytes() for x in all_.astype(np.int16)] if not wide.any() else [x.astype(np.int32 if w else np.int16).tobytes() for x, w in zip(all_, wide, strict=True)]
