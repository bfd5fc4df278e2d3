"""UTF-8 runs of byte strings: valid text and what breaks it, as rows.

Bytes are judged all at once by numpy over an Arrow batch's buffer: for each byte, how many of the following ones it takes as a lead; a
byte that no lead takes begins something itself.  So the automaton's states are columns and no byte is looked at in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are judged at once, and bytes of rows that are worked on together.
BLOCK, SLICE = 1 << 20, 1 << 23

#: Bytes of a sequence by its lead (0: no lead), and the range of its second byte (fixed values of the encoding).
_LENGTH = np.zeros(256, np.int8)
_LENGTH[0x00:0x80], _LENGTH[0xC2:0xE0], _LENGTH[0xE0:0xF0], _LENGTH[0xF0:0xF5] = 1, 2, 3, 4
_LOW, _HIGH = np.full(256, 0x80, np.uint8), np.full(256, 0xBF, np.uint8)
_LOW[0xE0], _LOW[0xF0], _HIGH[0xED], _HIGH[0xF4] = 0xA0, 0x90, 0x9F, 0x8F


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the characters and broken pieces of consecutive byte strings begin, how many bytes each has, and which are characters."""
    n = len(data)
    want = _LENGTH[data]
    end = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # bytes up to the string's end
    took, going = np.ones(n, np.int8), want > 1
    for k in (1, 2, 3):
        ahead = np.zeros(n, np.uint8)
        ahead[: n - k] = data[k:] if n > k else 0
        fits = (ahead >= (_LOW[data] if k == 1 else 0x80)) & (ahead <= (_HIGH[data] if k == 1 else 0xBF))
        going &= fits & (want > k) & (end > k)
        took += going
    taken = np.zeros(n + 4, bool)
    for k in (1, 2, 3):
        taken[np.flatnonzero(took > k) + k] = True
    start = np.flatnonzero(~taken[:n])
    return start, took[start].astype(np.int64), took[start] == want[start]


def broken(data: np.ndarray, off: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Where the broken pieces of consecutive byte strings begin, and how many bytes each has.

    A block at a time: what a byte is follows from the three before and behind it, so a block that is seen with these is judged
    alone, and the columns of states take memory for a block only, however long a string is.
    """
    starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(data), block):
        lo, hi = max(0, i - 3), min(len(data), i + block + 3)
        some = off[np.searchsorted(off, lo, "right") - 1 : np.searchsorted(off, hi, "left") + 1]
        start, size, fine = runs(data[lo:hi], np.clip(some, lo, hi) - lo)
        start = start + lo
        mine = ~fine & (start >= i) & (start < i + block)
        starts.append(start[mine])
        sizes.append(size[mine])
    return np.concatenate(starts), np.concatenate(sizes)


def _slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with ``most`` bytes together, or one row with more."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
    end, at = np.cumsum(size), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(end, end[at] - size[at] + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in _slices(b)):
        column = batch.column(1).cast(pa.large_binary())
        column = pa.array(column.to_pylist(), pa.large_binary()) if column.null_count else column
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        bad, bad_size = broken(data, off)
        # a chunk ends behind a broken piece, and where its string ends if anything is left there
        last = np.zeros(len(off) - 1, np.int64)
        owner = np.searchsorted(off, bad, "right") - 1
        np.maximum.at(last, owner, bad + bad_size)
        left = np.flatnonzero((np.diff(off) > 0) & (off[1:] > last))
        row = np.concatenate([owner, left])
        stop, tail = np.concatenate([bad, off[1:][left]]), np.concatenate([bad_size, np.zeros(len(left), np.int64)])
        order = np.lexsort((stop, row))
        row, stop, tail = row[order], stop[order], tail[order]
        new = np.append(True, row[1:] != row[:-1])[: len(row)]
        number = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        begin = np.where(new, off[row], np.concatenate([[0], (stop + tail)[:-1]]))
        out = np.zeros(len(data), bool)  # bytes of broken pieces, which have three at most
        for k in range(3):
            out[bad[bad_size > k] + k] = True
        texts = pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(np.append(0, np.cumsum(stop - begin))), pa.py_buffer(np.ascontiguousarray(data[~out]))])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.append(0, np.cumsum(tail))), pa.py_buffer(np.ascontiguousarray(data[out]))])
        yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(number), texts.cast(pa.string()), pieces.cast(pa.binary())], names=["id", "chunk", "valid", "invalid"])


def chunks(rows: DataFrame, id_col: str, data: str) -> DataFrame:
    """``id, chunk, valid, invalid`` of byte strings: text as long as it is valid, and the bytes that end it (at most three; none at a string's end).

    The broken piece is the longest beginning of a character that could have gone on.  Null and empty strings have no chunk.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(data).cast("binary").alias("data")).filter("data is not null").mapInArrow(_chunked, f"id {kind}, chunk long, valid string, invalid binary")
