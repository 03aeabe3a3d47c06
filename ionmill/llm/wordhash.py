"""64-bit hashes of all words of a batch of texts, by numpy over their UTF-8 bytes.

A word's hash is a polynomial of random byte values with an odd base, taken from prefix sums mod 2^64, brought to position 0 by the
inverse power, and mixed with the word's length. Two different words of up to a few hundred bytes agree with a chance near 2^-56.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_CHUNK = 1 << 19
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _CHUNK + 4096)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))]) for x in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


class Words:
    """Words of texts. hashes, starts and ends (bytes in ``raw``) are per word; first[k]:first[k + 1] are the words of text k.

    is_word: which bytes make words (a line feed must not). lower: bytes folded before hashing.
    """

    def __init__(self, texts: list[str], is_word: np.ndarray, fold):
        parts = [t.encode("utf-8", "replace") for t in texts]
        self.data = b"\n".join(parts) + b"\n"
        self.raw = np.frombuffer(self.data, np.uint8)
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        inside = is_word[self.raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(self.raw) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, bounds)
        self.hashes = self._hash(fold(self.raw))

    def _hash(self, raw: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        k = 0
        while k < len(self.starts):
            begin = int(self.starts[k])
            last = max(k + 1, int(np.searchsorted(self.ends, begin + _CHUNK, "right")))
            stop = int(self.ends[last - 1])
            power, inverse = _powers(stop - begin)
            total = np.zeros(stop - begin + 1, np.uint64)
            np.cumsum(values[raw[begin:stop]] * power[:stop - begin], out=total[1:])
            a, b = self.starts[k:last] - begin, self.ends[k:last] - begin
            out[k:last] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
            k = last
        return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries, ordered."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k:k + n]
    return mix(total)


_ASCII_FOLD = np.arange(256, dtype=np.uint8)
_ASCII_FOLD[65:91] += 32


def ascii_fold(raw: np.ndarray) -> np.ndarray:
    return _ASCII_FOLD[raw]
