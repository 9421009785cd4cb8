"""Word shingles as hashed sets, for whole batches of texts at once."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

from .common import release

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Most words whose hash a task keeps, and their most bytes; others are hashed anew.
KEPT_WORDS, KEPT_LENGTH = 50_000, 64


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, filled on demand up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS and len(word) <= KEPT_LENGTH:
            self[word] = value
        return value


_words = WordHashes()


def forget() -> None:
    """At the end of a task: kept words and freed memory go back."""
    _words.clear()
    release()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _STEP
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    A-Z are lower-cased, words are cut at ASCII white space (bytes.split and bytes.lower do
    exactly this). A text of fewer than k words has its whole sequence as its one shingle; no
    words or null gives an empty set.
    """
    split = [text.encode("utf-8", "surrogatepass").lower().split() if text else [] for text in texts]
    sizes = np.array([len(x) for x in split], dtype=np.int64)
    total = int(sizes.sum())
    words = np.fromiter(map(_words.__getitem__, chain.from_iterable(split)), dtype=np.uint64, count=total)
    ends = np.cumsum(sizes)
    out = []
    if total >= k:
        mixed = words[: total - k + 1].copy()
        for j in range(1, k):
            mixed = _scramble(mixed) * _ODD + words[j : total - k + 1 + j]
        mixed = _scramble(mixed)
    for end, n in zip(ends, sizes):
        start = end - n
        if n >= k:
            out.append(np.unique(mixed[start : end - k + 1]))
        elif n:
            short = words[start]
            for j in range(1, n):
                short = (_scramble(np.array([short], dtype=np.uint64)) * _ODD + words[start + j])[0]
            # one shingle that no full shingle equals: the length enters the hash
            out.append(_scramble(np.array([short], dtype=np.uint64) + np.array([n], dtype=np.uint64) * _STEP))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity bitmap: each token flips one bit. Its width follows the size of the set.

    The Hamming distance of two bitmaps of one width never exceeds the symmetric difference of
    the sets; a wide one is folded to a narrower width by XOR of its halves.
    """
    bits = 512
    while bits < min(len(tokens), 1 << 17):
        bits *= 2
    at = np.bincount(((tokens >> np.uint64(7)) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(at, bitorder="little").tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A bitmap as 64-bit words, folded to size bytes."""
    x = np.frombuffer(raw, dtype=np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance at the narrower width."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
