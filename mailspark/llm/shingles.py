"""Word shingles of many texts at once, as 64-bit hashes, with NumPy over UTF-8 bytes.

Words are runs of bytes other than space and \\x09 to \\x0D; A-Z are lower-cased. A text with fewer
words than a shingle has one shingle, its whole sequence; a text without words has none.
"""

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text worked on at once.
AT_ONCE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.arange(256, dtype=np.uint64) + np.uint64(1)
_BYTE[65:91] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(batches, rows: int = 1000):
    """Arrow batches in pieces of few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def groups(sizes: list[int], at_once: int = AT_ONCE):
    """Slices of consecutive texts of about ``at_once`` bytes; a longer text is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > at_once:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the number of its text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = _SPACE[data]
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(gap & ~before)
    # A polynomial of a word's bytes: a difference of running sums, moved to the word's start.
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data) - 1), out=sums[1:])
    back = _powers(_BASE_INVERSE, len(data))
    h = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return h, np.searchsorted(limits, starts, "right")


def shingle_hashes(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, texts in order and repeats kept, and where each text's begin (one more
    entry than texts)."""
    h, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int64) if len(h) else np.zeros(len(texts), np.int64)
    first = np.cumsum(counts) - counts
    whole = len(h) - n + 1
    if whole > 0:
        joined = np.zeros(whole, np.uint64)
        for i in range(n):
            joined *= np.uint64(0x100000001B3)
            joined += h[i : i + whole]
        inside = owner[:whole] == owner[n - 1 :]
        shingles, of = mix(joined[inside]), owner[:whole][inside]
    else:
        shingles, of = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = counts[short] > i
            extra[has] = extra[has] * np.uint64(0x100000001B3) + h[first[short][has] + i]
        extra = mix(extra + counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        shingles, of = np.concatenate([shingles, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        shingles, of = shingles[order], of[order]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(of, minlength=len(texts)), out=starts[1:])
    return shingles, starts


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for a, b in groups([len(t) for t in texts]):
        shingles, starts = shingle_hashes(texts[a:b], n)
        out += [np.unique(shingles[i:j]) for i, j in zip(starts, starts[1:])]
    return out


def coordinate(shingles: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of every shingle, 32 bits."""
    a = np.uint64((0xA0761D6478BD642F + 2 * k * 0x9E3779B97F4A7C15) % (1 << 64) | 1)
    b = np.uint64((k * 0xE7037ED1A0B428DB + 0x8EBC6AF09C88C6E3) % (1 << 64))
    v = shingles * a
    v += b
    v ^= v >> np.uint64(29)
    v *= np.uint64(0x9FB21C651E98DF25)
    return (v >> np.uint64(32)).astype(np.uint32)
