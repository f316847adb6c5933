"""Words and their hashes for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd base, invertible modulo 2**64, of the polynomial hash over bytes.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


#: Bytes of text that batch-wise functions lay out at a time; a longer single text is taken whole.
SLICE = 4 << 20


def slices(batch: pa.RecordBatch, column: int):
    """The batch in runs of rows of about SLICE bytes of text, so that working arrays stay small."""
    sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null row has none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return flat, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def spans(flat: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes; no run goes past its row."""
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = member[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    starts = inside[1:] & (~inside[:-1] | edge)
    ends = inside[:-1] & (~inside[1:] | edge)
    return np.flatnonzero(starts), np.flatnonzero(ends)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the same wherever the run stands."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    alive = np.arange(len(starts))
    at = 0
    with np.errstate(over="ignore"):
        while len(alive):
            if at >= 64:  # what is left are few and very long runs
                for i in alive.tolist():
                    out[i] = np.uint64(_long_hash(int(out[i]), flat[starts[i] + at : ends[i]].tobytes()))
                break
            out[alive] = (out[alive] + flat[starts[alive] + at].astype(np.uint64) + np.uint64(1)) * BASE
            out[alive] ^= out[alive] >> np.uint64(29)
            at += 1
            alive = alive[size[alive] > at]
        return mix(out)


def _long_hash(seed: int, rest: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(rest, seed)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k consecutive words, by start."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, k):
            out = out * BASE + hashes[j : n + j]
    return mix(out)
