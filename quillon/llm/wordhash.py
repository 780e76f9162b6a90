"""64-bit hashes of all words of a batch of texts at once, in numpy.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A word's hash is a
polynomial over random byte values, taken from prefix sums over the whole batch, then mixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at once; a longer text is cut at white space.
BATCH_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ np.uint64(0xD6E8FEB86659FD93)))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _hash(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first byte of the words of a buffer that ends with white space."""
    a = np.frombuffer(buffer, np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(a))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[a] * up)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _parts(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > BATCH_BYTES and (m := _GAP.search(raw, at + BATCH_BYTES)):
        yield raw[at : m.start()]
        at = m.start()
    yield raw[at:]


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Of each text, the hashes of its words in order."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    total = 0

    def flush() -> None:
        nonlocal group, total
        if group:
            hashes, start = _hash(b" ".join(group) + b" ")
            ends = np.cumsum([len(g) + 1 for g in group])
            out.extend(np.split(hashes, np.searchsorted(start, ends[:-1])))
        group, total = [], 0

    for text in texts:
        raw = text.encode("utf-8", "replace").lower()
        if len(raw) > BATCH_BYTES:
            flush()
            out.append(np.concatenate([_hash(part + b" ")[0] for part in _parts(raw)]))
            continue
        group.append(raw)
        total += len(raw)
        if total > BATCH_BYTES:
            flush()
    flush()
    return out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` words; a shorter text is one shingle, no word gives none."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    made = np.full(n, np.uint64(min(size, len(words))))
    for k in range(min(size, len(words))):
        made = combine(made, words[k : k + n])
    return np.unique(made)
