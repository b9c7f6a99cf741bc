"""Arrow string columns as flat numpy bytes, and words within them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at once in a task.
PIECE = 1 << 20


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: int, piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``piece`` bytes of text; a longer row is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(flat(batch.column(text))[1]))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + piece, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word ``[^\\x20\\x09-\\x0D]+``; words do not cross rows."""
    n = len(data)
    inside = np.empty(n + 1, bool)
    inside[:n] = (data != 32) & ((data < 9) | (data > 13))
    inside[n] = False
    starts = inside[:n].copy()
    starts[1:] &= ~inside[: n - 1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    starts[edges] = inside[edges]
    begin = np.flatnonzero(starts)
    # A word ends where white space, the next word or the data begins.
    stops = ~inside
    stops[edges] = True
    stop = np.flatnonzero(stops)
    end = stop[np.searchsorted(stop, begin, "right")]
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


# Odd multipliers of the hashes, and a table that scatters bytes.
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Runs of more bytes are hashed one by one.
LONG = 512
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


def run_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """64-bit hashes of the byte runs from ``begin`` to ``end``, in independent lanes; equal runs hash alike.

    Each step scatters all bits with the next eight bytes, so runs of whatever pattern and length are told
    apart; unlike ``span_hash``, whose sums suit short runs only.
    """
    size = end - begin
    out = [mix(size.astype(np.uint64) + np.array([2 * lane + 1], np.uint64) * BASE) for lane in range(lanes)]
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = begin[live], size[live]
    while len(live):
        chunk = eights[at].view(np.uint64)[:, 0]
        last = left < 8
        chunk[last] &= _TAILS[left[last]]
        for values in out:
            values[live] = mix(values[live] ^ chunk)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        run = data[begin[k] : end[k]].tobytes()
        for lane, values in enumerate(out):
            values[k] = int.from_bytes(hashlib.blake2b(run, digest_size=8, salt=bytes([lane])).digest(), "little")
    return out


def runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte runs as an Arrow array; they do not overlap and are in order."""
    size = end - begin
    ends = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    edges = np.zeros(len(data) + 1, np.int8)
    edges[begin] += 1
    edges[end] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(int(BASE), -1, 1 << 64)
_TABLES: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = 1 << n.bit_length()
        _TABLES["up"], _TABLES["down"] = powers(size, int(BASE)), powers(size, _INVERSE)
    return _TABLES["up"], _TABLES["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any run of bytes."""
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs from ``begin`` to ``end``; equal runs hash alike."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * BASE)
