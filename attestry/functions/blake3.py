"""BLAKE3 from its public specification, over many chunks at once.

The tree over 1 KiB chunks lets parts of a stream be hashed where they lie: a part gives chaining values of whole
subtrees, and these are joined later.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the specification.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
#: Chunks hashed at once: the state of so many stays in a core's cache.
LANES = 8192
MIXES = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
_orders = [list(range(16))]
for _ in range(6):
    _orders.append([_orders[-1][i] for i in PERMUTATION])


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray | int, flags: np.ndarray | int) -> np.ndarray:
    """cv (8, n), words (16, n), counter (n): the next chaining values (8, n)."""
    n = words.shape[1]
    s = np.empty((16, n), np.uint32)
    s[:8], s[8:12] = cv, IV[:4, None]
    counter = np.asarray(counter, np.uint64)
    s[12], s[13], s[14], s[15] = counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length, flags
    for order in _orders:
        for k, (a, b, c, d) in enumerate(MIXES):
            x, y = words[order[2 * k]], words[order[2 * k + 1]]
            s[a] += s[b] + x
            s[d] = _turn(s[d] ^ s[a], 16)
            s[c] += s[d]
            s[b] = _turn(s[b] ^ s[c], 12)
            s[a] += s[b] + y
            s[d] = _turn(s[d] ^ s[a], 8)
            s[c] += s[d]
            s[b] = _turn(s[b] ^ s[c], 7)
    return s[:8] ^ s[8:]


def chunk_values(data: bytes | np.ndarray, first: int) -> np.ndarray:
    """Chaining values (n, 8) of whole chunks; `first` is the number of the first one."""
    a = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    n = len(a) // CHUNK
    words = np.ascontiguousarray(a[:n * CHUNK].view("<u4").reshape(n, 16, 16).transpose(1, 2, 0))
    cv = np.repeat(IV[:, None], n, axis=1)
    counter = np.arange(first, first + n, dtype=np.uint64)
    for b in range(16):
        cv = compress(cv, words[b], counter, BLOCK, (CHUNK_START if b == 0 else 0) | (CHUNK_END if b == 15 else 0))
    return np.ascontiguousarray(cv.T)


def _last_chunk(data: bytes, number: int, root: bool) -> np.ndarray:
    blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
    cv = IV[:, None].copy()
    for i, b in enumerate(blocks):
        last = i == len(blocks) - 1
        flags = (CHUNK_START if i == 0 else 0) | (CHUNK_END if last else 0) | (ROOT if root and last else 0)
        words = np.frombuffer(b.ljust(BLOCK, b"\0"), "<u4").reshape(16, 1)
        cv = compress(cv, words, np.array([number]), len(b), flags)
    return cv[:, 0]


def parents(left: np.ndarray, right: np.ndarray, root: bool | np.ndarray = False) -> np.ndarray:
    """Parents (n, 8) of two rows of chaining values."""
    words = np.ascontiguousarray(np.concatenate([left, right], axis=1).T)
    cv = np.repeat(IV[:, None], len(left), axis=1)
    return np.ascontiguousarray(compress(cv, words, np.zeros(len(left)), BLOCK, PARENT | np.where(root, ROOT, 0)).T)


def subtrees(values: np.ndarray, first: int) -> list[tuple[int, int, bytes]]:
    """(level, first chunk, value) of the largest aligned subtrees over chunks first, first + 1, ..."""
    out, level, at = [], 0, first
    while len(values):
        step = 1 << level
        if at & step:  # a right child whose sibling lies before
            out.append((level, at, values[0].tobytes()))
            values, at = values[1:], at + step
        if len(values) & 1:
            out.append((level, at + (len(values) - 1) * step, values[-1].tobytes()))
            values = values[:-1]
        if len(values):
            values = parents(values[0::2], values[1::2])
        level += 1
    return sorted(out, key=lambda x: x[1])


class Tree:
    """Joins subtrees, in order, to the hash of the whole stream."""

    def __init__(self):
        self.stack: list[tuple[int, np.ndarray]] = []
        self.chunks = 0

    def add(self, level: int, value: bytes | np.ndarray) -> None:
        """The next aligned subtree of 2**level chunks; never the last chunk of the stream."""
        cv = np.frombuffer(value, np.uint32) if isinstance(value, bytes) else value
        self.chunks += 1 << level
        while self.stack and self.stack[-1][0] == level:
            cv = parents(self.stack.pop()[1][None], cv[None])[0]
            level += 1
        self.stack.append((level, cv))

    def finish(self, last: bytes) -> bytes:
        """The digest, given the last chunk (of 1 to 1024 bytes, or 0 if it is the only one)."""
        if not self.stack:
            return _last_chunk(last, 0, True).astype("<u4").tobytes()
        cv = _last_chunk(last, self.chunks, False)
        while self.stack:
            cv = parents(self.stack.pop()[1][None], cv[None], root=not self.stack)[0]
        return cv.astype("<u4").tobytes()


def blake3(data: bytes) -> bytes:
    tree = Tree()
    whole = max(0, (len(data) - 1) // CHUNK)
    for i in range(0, whole, 8192):
        n = min(8192, whole - i)
        for level, _, cv in subtrees(chunk_values(np.frombuffer(data, np.uint8, n * CHUNK, i * CHUNK), i), i):
            tree.add(level, cv)
    return tree.finish(data[whole * CHUNK:])


def digests(prefix: bytes, data: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The digests of messages that lie in data one after the other, each after the same prefix; ends: where each ends.

    Some thousand chunks are hashed at once, whatever message they are of; a message of more than that by itself.
    """
    ends = np.asarray(ends, np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - begins + len(prefix)
    counts = np.maximum(-(-sizes // CHUNK), 1)
    out, i = [], 0
    while i < len(ends):
        if counts[i] > LANES:
            out.append(blake3(prefix + data[begins[i]:ends[i]].tobytes()))
            i += 1
            continue
        j = i + int(np.searchsorted(np.cumsum(counts[i:i + LANES]), LANES, "right"))
        text = np.zeros(int(sizes[i:j].sum()) + BLOCK, np.uint8)
        at = np.cumsum(sizes[i:j]) - sizes[i:j]
        heads, rest = at[:, None] + np.arange(len(prefix)), np.ones(len(text) - BLOCK, bool)
        rest[heads] = False
        text[heads] = np.frombuffer(prefix, np.uint8)
        text[:-BLOCK][rest] = data[begins[i]:ends[j - 1]]
        values = _roots(_chunks(text, at, sizes[i:j], counts[i:j]), counts[i:j])
        out += [v.tobytes() for v in values.astype("<u4")]
        i = j
    return out


def _owners(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of so many items each: the run that an item is of, and its place there."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def _chunks(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Chaining values (n, 8) of all chunks of messages, or digests of those of one chunk; data has BLOCK bytes more."""
    owner, number = _owners(counts)
    at, length = begins[owner] + number * CHUNK, np.minimum(sizes[owner] - number * CHUNK, CHUNK)
    end = CHUNK_END | np.where(counts[owner] == 1, ROOT, 0)
    cv = np.repeat(IV[:, None], len(owner), axis=1)
    blocks = np.lib.stride_tricks.sliding_window_view(data, BLOCK)
    for b in range(0, max(int(length.max()), 1), BLOCK):
        on = np.flatnonzero((length > b) | (b == 0))
        part, left = blocks[at[on] + b], length[on] - b
        part[np.arange(BLOCK) >= left[:, None]] = 0
        words = np.ascontiguousarray(part.view("<u4").T)
        flags = (CHUNK_START if b == 0 else 0) | np.where(left <= BLOCK, end[on], 0)
        cv[:, on] = compress(cv[:, on], words, number[on], np.minimum(left, BLOCK), flags)
    return np.ascontiguousarray(cv.T)


def _roots(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The root (n, 8) of each message's chunks: neighbours are joined, one left over goes up as it is."""
    while counts.max() > 1:
        half = (counts + 1) // 2
        owner, place = _owners(half)
        left = (np.cumsum(counts) - counts)[owner] + 2 * place
        pair = np.flatnonzero(2 * place + 1 < counts[owner])
        joined = parents(values[left[pair]], values[left[pair] + 1], counts[owner[pair]] == 2)
        values, counts = values[left], half
        values[pair] = joined
    return values
