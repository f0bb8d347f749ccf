"""Vectorised byte kernels over Arrow text columns, shared by the text operators.

Everything here works on whole texts. A batch is walked in slices of whole rows of about CHUNK_BYTES, so memory follows
the slice (or the longest single text), not the batch. A null text is an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def blank_separated() -> np.ndarray:
    """Byte class of words [^\\x20\\x09-\\x0D]+ (UTF-8 bytes over 0x7F belong to words)."""
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Byte class of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, after lower-casing."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    """Lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= C1
    x ^= x >> np.uint64(27)
    x *= C2
    x ^= x >> np.uint64(31)
    return x


def chunks(column, limit: int = CHUNK_BYTES, sep: str = " "):
    """Yields (first row, last row + 1, bytes, offsets); each text is followed by sep, offsets[i] starts row i. Only one slice of
    the column is copied at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    kind = pa.large_string()
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + len(sep)
    ends = np.concatenate(([0], np.cumsum(size)))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        texts = pc.fill_null(column.slice(i, j - i).cast(kind), pa.scalar("", kind))
        if sep:
            texts = pc.binary_join_element_wise(texts, pa.scalar("", kind), pa.scalar(sep, kind))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + j - i + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        yield i, j, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        i = j


def word_spans(data: np.ndarray, wordy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; data ends with a byte outside words."""
    m = wordy[data]
    edges = np.flatnonzero(m[1:] != m[:-1]) + 1
    if len(m) and m[0]:
        edges = np.concatenate(([0], edges))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    view = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    n = ends - starts
    h = mix((view[starts] & LOW_BYTES[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * GOLD))
    live, k = np.flatnonzero(n > 8), 8
    while live.size:
        left = n[live] - k
        h[live] = mix(h[live] * STEP ^ (view[starts[live] + k] & LOW_BYTES[np.minimum(left, 8)]))
        live, k = live[left > 8], k + 8
    return h


def extend(grams: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """From hashes of (k-1)-grams those of k-grams at each start where one fits; h: the words' hashes."""
    n = max(0, len(h) - k + 1)
    out = grams[:n] * STEP
    out += h[k - 1 : k - 1 + n]
    return mix(out)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    out = h
    for j in range(2, k + 1):
        out = extend(out, h, j)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
