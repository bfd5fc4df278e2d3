"""Vectorised word splitting and hashing over Arrow string buffers.

Every operator that works on words or shingles inside ``mapInArrow`` uses these
functions, so that a batch of texts is handled as one byte buffer by numpy and
no Python object is made per word.  Memory is bounded by ``CHUNK_BYTES`` (or by
one text, when that is longer), whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, xor, multiply) on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte, and the same with A-Z as a-z.
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODE_LOWER = BYTE_CODE[LOWER]


def _power(n: int, kind: str) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK_BYTES + 1), _BASE if kind == "up" else _BASE_INV, np.uint64)
        step[0] = 1
        have = np.cumprod(step)
        if n <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows; a null text is an empty one."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each text the index of its first word (one entry more than texts)."""
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = off[:-1][off[:-1] < len(data)]
    start[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > off[:-1]] - 1
    end[last] = inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum over the buffer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((BYTE_CODE_LOWER if lower else BYTE_CODE)[data] * _power(len(data), "up"), out=total[1:])
    return mix64((total[ends] - total[starts]) * _power(len(data) + 1, "down")[starts])


def gram_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that stay in one text, and the index of each run's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : j + n]
    text = np.searchsorted(first, np.arange(n), "right") - 1
    ok = np.flatnonzero(np.arange(n) + k <= first[text + 1])
    return mix64(acc[ok]), ok


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """For each i the index of the first minimum of x[i:i+w] (len(x)-w+1 results)."""
    n = len(x) - w + 1
    best = np.arange(n)
    val = x[:n].copy()
    step = 1
    idx = np.arange(len(x))
    cur_i, cur_v = idx, x
    done = 0
    size = w
    # doubling: cur covers runs of length `step`
    best, val, covered = None, None, 0
    while size:
        if size & 1:
            a_i, a_v = cur_i[covered : covered + n], cur_v[covered : covered + n]
            if best is None:
                best, val = a_i.copy(), a_v.copy()
            else:
                less = a_v < val
                best = np.where(less, a_i, best)
                val = np.where(less, a_v, val)
            covered += step
        size >>= 1
        if size:
            m = len(cur_v) - step
            less = cur_v[step:] < cur_v[:m]
            cur_i, cur_v = np.where(less, cur_i[step:], cur_i[:m]), np.where(less, cur_v[step:], cur_v[:m])
            step *= 2
    return best
