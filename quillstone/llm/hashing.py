"""Word and shingle hashes of many texts at once, over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(20240511).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(most: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, most.bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        one = np.ones(1, np.uint64)
        _TABLES[size] = tuple(np.cumprod(np.concatenate([one, np.full(size, f, np.uint64)]), dtype=np.uint64) for f in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _TABLES[size]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word of the texts data[bounds[d]:bounds[d+1]], A-Z lower-cased."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    powers, inverses = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[_LOWER[data]] * powers[: len(data)], out=sums[1:])
    doc = np.searchsorted(bounds, a, side="right") - 1
    return mix((sums[b] - sums[a]) * inverses[a]), doc


class Rarity:
    """Sixteen classes of shingles, rare ones first, by how often words and shingles come in a sample.

    A shingle is expected as often as its words' shares say, or its own share where it is among the sample's frequent
    ones. Up to 1/64 expected occurrences are class 0, each doubling is one more. The class depends on the words alone.
    """

    SLOTS = 1 << 20
    SHIFT = np.uint64(4)

    def __init__(self, word_hashes, word_counts, chains, chain_counts, sample: int, total: float):
        """Hashes and counts of frequent words and shingles in a sample of so many words, of total words in all."""
        self.words = self._halves(word_hashes, word_counts, sample, np.uint8)
        self.words[self.words == 255] = int(self.words[self.words < 255].max(initial=0))  # any other word: like the rarest kept
        self.chains = self._halves(chains, chain_counts, sample, np.uint16)
        self.top = 2 * np.log2(max(total, 1)) + 12

    def _halves(self, hashes: np.ndarray, counts: np.ndarray, sample: int, kind) -> np.ndarray:
        """Half bits of information by slot of the hash; the most a type holds where nothing is known."""
        out = np.full(self.SLOTS, np.iinfo(kind).max, kind)
        np.minimum.at(out, self._slot(hashes), np.minimum(2 * np.log2(max(sample, 1) / counts), 120).astype(kind))
        return out

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def ranked(self, hashes: np.ndarray, chain: np.ndarray, size: int) -> np.ndarray:
        """Shingles beginning at each word with their class in the highest bits."""
        own = self.words[self._slot(hashes)].astype(np.uint16)
        halves = own.copy()
        for k in range(1, size):
            halves[: max(len(own) - k, 0)] += own[k:]
        halves = np.minimum(halves, self.chains[self._slot(chain)])
        level = np.clip((self.top - halves) / 2, 0, 15).astype(np.uint64)
        return chain >> self.SHIFT | level << np.uint64(60)


def shingles(data: np.ndarray, bounds: np.ndarray, size: int, rarity: Rarity | None = None) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of size words; with fewer words, of the whole sequence; none without words.

    With rarity, hashes have 60 bits below their class, so that they sort by it; whole sequences are of class 0.
    """
    hashes, doc = words(data, bounds)
    n = len(hashes)
    chain = hashes.copy()
    whole = np.searchsorted(doc, np.arange(len(bounds)))
    for k in range(1, size):
        if n > k:
            chain[: n - k] = mix(chain[: n - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    if rarity is not None:
        chain = rarity.ranked(hashes, chain, size)
    out = []
    for d in range(len(bounds) - 1):
        a, b = int(whole[d]), int(whole[d + 1])
        if b - a >= size:
            out.append(np.unique(chain[a : b - size + 1]))
        elif b > a:
            x = hashes[a : a + 1]
            for k in range(a + 1, b):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + 1])
            x = x ^ np.uint64(b - a)
            out.append(x if rarity is None else x >> Rarity.SHIFT)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
