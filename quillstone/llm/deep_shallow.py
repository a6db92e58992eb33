"""Deep-shallow sorting of strings of one length, with the longest common prefix of each neighbour.

Shallow: multikey quicksort that takes eight bytes as one character. All open groups are parted at once, each around the
median of three of its own characters at its own depth: less, equal, greater; only the equal part goes one character
deeper. Deep: each group that still agrees after SHALLOW characters goes through a blind trie (a Patricia trie that
compares only branching characters on its way down, and one whole string at the end).
"""

from __future__ import annotations

import numpy as np

SHALLOW = 4
WORD = 8


class BlindTrie:
    """Orders distinct strings of equal length; each node branches at one depth."""

    __slots__ = ("length", "root")

    def __init__(self, length: int):
        self.length = length
        self.root: object = None

    def common(self, a: bytes, b: bytes) -> int:
        return self.length - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8

    def insert(self, s: bytes) -> None:
        if self.root is None:
            self.root = s
            return
        node = self.root
        while type(node) is list:  # blind: only the branching characters are looked at
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        depth = self.common(s, node)
        if depth == self.length:
            return
        other = node[depth]
        above, node = None, self.root
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if type(node) is list and node[0] == depth:
            node[1][s[depth]] = s
            return
        split = [depth, {other: node, s[depth]: s}]
        if above is None:
            self.root = split
        else:
            above[1][s[above[0]]] = split

    def ordered(self) -> list[tuple[bytes, int]]:
        """Strings in order, each with its common prefix with the one before (0 for the first)."""
        out: list[tuple[bytes, int]] = []
        stack: list[tuple[object, int]] = [(self.root, 0)] if self.root is not None else []
        while stack:
            node, shared = stack.pop()
            if type(node) is list:
                first, *rest = sorted(node[1].items())
                stack.extend((child, node[0]) for _, child in reversed(rest))
                stack.append((first[1], shared))
            else:
                out.append((node, shared))
        return out


def _words(strings: np.ndarray) -> np.ndarray:
    n, length = strings.shape
    padded = np.zeros((n, -(-length // WORD) * WORD), np.uint8)
    padded[:, :length] = strings
    return padded.view(">u8").astype(np.uint64)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first byte, from the most significant, in which two words differ (8: equal)."""
    x = a ^ b
    out = np.full(len(x), WORD, np.int64)
    for k in range(WORD - 1, -1, -1):
        out[(x >> np.uint64(8 * (WORD - 1 - k))) & np.uint64(255) != 0] = k
    return out


def sort(strings: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and for each place the common prefix with the row before (0 at the first)."""
    n, length = strings.shape
    order = np.arange(n)
    if n < 2:
        return order, np.zeros(n, np.int64)
    words = _words(strings)
    for first, size in _multikey_quicksort(words, order, min(shallow, words.shape[1])):
        members = order[first : first + size]
        rows = strings[members].tobytes()
        by: dict[bytes, list[int]] = {}
        for k in range(size):
            by.setdefault(rows[k * length : (k + 1) * length], []).append(k)
        if len(by) > 1:
            trie = BlindTrie(length)
            for s in by:
                trie.insert(s)
            order[first : first + size] = members[[k for s, _ in trie.ordered() for k in by[s]]]
    return order, _common(words[order], length)


def _multikey_quicksort(words: np.ndarray, order: np.ndarray, depths: int) -> list[tuple[int, int]]:
    """Sort order in place by the first words; (first place, size) of the groups that agree in all of them."""
    deep: list[tuple[int, int]] = []
    start, size, depth = np.zeros(1, np.int64), np.array([len(order)]), np.zeros(1, np.int64)
    while len(start):
        group = np.arange(len(start))
        offset = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(start - offset, size)
        of = np.repeat(group, size)
        key = words[order[place], depth[of]]
        a, b, c = key[offset], key[offset + size // 2], key[offset + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[of]
        part = 3 * of + (key >= pivot) + (key > pivot)
        order[place] = order[place][np.argsort(part, kind="stable")]
        sizes = np.bincount(part, minlength=3 * len(start))
        start = np.cumsum(sizes) - sizes + np.repeat(start - offset, 3)
        depth = np.repeat(depth, 3)
        depth[1::3] += 1
        size = sizes
        ended = (depth == depths) & (size > 1)
        deep += zip(start[ended].tolist(), size[ended].tolist(), strict=True)
        open_ = (size > 1) & ~ended
        start, size, depth = start[open_], size[open_], depth[open_]
    return deep


def _common(words: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each row with the one before, in bytes."""
    out = np.zeros(len(words), np.int64)
    differs = words[1:] != words[:-1]
    first = differs.argmax(axis=1)
    rows = np.arange(len(first))
    out[1:] = np.where(differs[rows, first], first * WORD + _differ(words[1:][rows, first], words[:-1][rows, first]), length)
    return out
