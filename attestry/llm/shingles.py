"""Words and word shingles of many texts at once, hashed by array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i below n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        got = _powers[base] = (out[0], out[1])
    return got


def forget() -> None:
    _powers.clear()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each start and end."""
    up, down = powers(base, len(values) + 1)
    acc = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=acc[1:])
    return mixed((acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts, each text given as words joined by one space.

    starts, ends: each word's bytes in buffer; doc: each word's text; first: each text's first word (and one more).
    """

    def __init__(self, texts: list[bytes]):
        self.buffer = b" ".join(texts) + b" "
        b = np.frombuffer(self.buffer, np.uint8)
        space = b == 32
        before = np.empty(len(b), bool)
        before[0], before[1:] = True, space[:-1]
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(space & ~before)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.starts, at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = sums(b.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _P)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that don't fit in the last text are left out."""
        count = max(0, len(self.starts) - n + 1)
        at = np.arange(count)
        return sums(self.hashes, at, at + n, _Q)


def chunks(texts: list[bytes], most: int = 1 << 19):
    """(begin, end) of runs of texts of about `most` bytes."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def slices(batches, rows: int = 1_000):
    """Arrow batches in parts, so that few texts at a time are Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        pa.default_memory_pool().release_unused()
