"""BLAKE3-256 from its published specification, for exact hashes in parity mode. SHA-256 inside Spark is the default.

All chunks of all inputs of a batch are worked off together in numpy, then all pairs of each level of their trees.
"""

from __future__ import annotations

import numpy as np

# Initial words, message permutation and domain flags of BLAKE3.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_BLOCK, _CHUNK = 64, 1024
#: Chunks that are worked off together: 4 MB of input.
LANES = 4096


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, m: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """(8, n) new chaining values of n blocks: cv (8, n), message words m (16, n)."""
    v = [*cv, *(np.full(cv.shape[1], x, np.uint32) for x in _IV[:4]), (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    order = tuple(range(16))
    for _ in range(7):
        for i, (a, b, c, d) in enumerate(_COLUMNS):
            for word, turn_d, turn_b in ((m[order[2 * i]], 16, 12), (m[order[2 * i + 1]], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = _turn(v[d] ^ v[a], turn_d)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], turn_b)
        order = tuple(order[i] for i in _ORDER)
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def _first() -> np.ndarray:
    return np.array(_IV, np.uint32)[:, None]


def _chunk_values(data: np.ndarray, sizes: np.ndarray, counter: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """(8, n) values of n chunks, rows of ``data`` (n, 1024) padded with zeros; ``alone``: the only chunk of its input."""
    words = data.view("<u4").astype(np.uint32).reshape(len(data), _CHUNK // _BLOCK, 16)
    blocks = np.maximum(1, -(-sizes // _BLOCK))
    cv = np.repeat(_first(), len(data), axis=1)
    for k in range(int(blocks.max(initial=0))):
        on = np.flatnonzero(blocks > k)
        last = blocks[on] == k + 1
        flags = np.where(last, _CHUNK_END | np.where(alone[on], _ROOT, 0), 0) | (_CHUNK_START if k == 0 else 0)
        cv[:, on] = _compress(cv[:, on], np.ascontiguousarray(words[on, k].T), counter[on], np.minimum(_BLOCK, sizes[on] - k * _BLOCK), flags)
    return cv


def blake3_many(inputs: list[bytes]) -> list[bytes]:
    """32-byte hashes of the inputs."""
    counts = np.array([max(1, -(-len(x) // _CHUNK)) for x in inputs], np.int64)
    if not len(counts):
        return []
    ends = np.cumsum(counts)
    values = np.empty((8, int(ends[-1])), np.uint32)
    at = 0
    while at < len(inputs):  # inputs of about LANES chunks at a time, a larger one in parts
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LANES, side="right")))
        _fill(values, inputs[at:upto], counts[at:upto], int(ends[at - 1]) if at else 0)
        at = upto
    # the tree is the same as pairing neighbours again and again, where an odd last one waits for the next level
    levels = values
    while int(counts.max()) > 1:
        starts = np.cumsum(counts) - counts
        pairs, odd = counts // 2, counts % 2
        total = int(pairs.sum())
        local = np.arange(total) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        left = np.repeat(starts, pairs) + 2 * local
        root = np.repeat(counts == 2, pairs)
        m = np.concatenate([levels[:, left], levels[:, left + 1]])
        zero = np.zeros(total, np.int64)
        made = _compress(np.repeat(_first(), total, axis=1), m, zero, zero + _BLOCK, np.where(root, _PARENT | _ROOT, _PARENT))
        following = pairs + odd
        nxt = np.empty((8, int(following.sum())), np.uint32)
        begin = np.cumsum(following) - following
        nxt[:, np.repeat(begin, pairs) + local] = made
        waits = np.flatnonzero(odd)
        nxt[:, begin[waits] + pairs[waits]] = levels[:, starts[waits] + 2 * pairs[waits]]
        levels, counts = nxt, following
    return [x.tobytes() for x in np.ascontiguousarray(levels.T).astype("<u4")]


def _fill(values: np.ndarray, inputs: list[bytes], counts: np.ndarray, base: int) -> None:
    """The values of the chunks of several inputs, or of a single large one in parts, from column ``base`` on."""
    counter = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    alone = np.repeat(counts == 1, counts)
    if len(inputs) > 1:
        values[:, base : base + len(counter)] = _chunk_values(*_laid_out(inputs), counter, alone)
        return
    for lo in range(0, len(counter), LANES):
        hi = min(lo + LANES, len(counter))
        values[:, base + lo : base + hi] = _chunk_values(*_laid_out([inputs[0][lo * _CHUNK : hi * _CHUNK]]), counter[lo:hi], alone[lo:hi])


def _laid_out(inputs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks as rows, padded with zeros, and their sizes."""
    padded = b"".join(x + bytes(-len(x) % _CHUNK if x else _CHUNK) for x in inputs)
    sizes = []
    for x in inputs:
        sizes += [_CHUNK] * (len(x) // _CHUNK) + ([len(x) % _CHUNK] if len(x) % _CHUNK or not x else [])
    return np.frombuffer(padded, np.uint8).reshape(-1, _CHUNK), np.array(sizes, np.int64)


def blake3(data: bytes) -> bytes:
    """32-byte hash."""
    return blake3_many([data])[0]
