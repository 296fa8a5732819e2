"""Vectorised text helpers that run inside Arrow map tasks.

A task sees its rows as Arrow batches. ``blocks`` cuts a batch into runs of
whole documents of about ``max_bytes`` of UTF-8, so that memory follows the
block and not the batch; words and their 64-bit hashes come from numpy
passes over the bytes of a block. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_FOLD = 0xD1B54A32D192ED03

_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection of the 64-bit words)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a lane
_LANES = 32  # longer spans are hashed as trees


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each byte, as one number (blanks of zero behind the end)."""
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", room, strides=(1,))


def _tree(values: np.ndarray) -> np.uint64:
    """One number for a row of lanes; neighbours are folded in pairs."""
    while len(values) > 1:
        if len(values) % 2:
            values = np.append(values, np.uint64(0))
        values = mix(values[0::2] * np.uint64(_BASE) ^ mix(values[1::2] + np.uint64(_FOLD)))
    return values[0]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``max_bytes`` each (a longer row stands alone)."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, batch.num_rows
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per row, the first word.

    ``between`` tells for each byte whether it stands between words.
    """
    inside = ~between[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1]) if len(data) else None
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    runs = inside[cuts[:-1]] if len(data) else np.zeros(0, bool)
    starts, ends = cuts[:-1][runs], cuts[1:][runs]
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, widths: tuple[int, ...], fold: bool = True) -> np.ndarray:
    """Hashes of the first ``w`` bytes of each span, a row for each w (0: the whole span).

    A-Z folds to a-z (with ``fold``); equal bytes have equal hashes. Lanes of
    eight bytes are folded in one after the other, each step being a bijection of
    the state for a given lane. Words of one length up to eight bytes
    never collide, and no sum over positions is involved that regular words
    could cancel.
    """
    lane = lanes(LOWER[data] if fold else data)
    out = np.empty((len(widths), len(starts)), np.uint64)
    for row, w in enumerate(widths):
        size = np.minimum(ends - starts, w) if w else ends - starts
        h = size.astype(np.uint64) * np.uint64(_FOLD)
        at, left, h_all = starts, size, h
        which = None
        for _ in range(_LANES):
            h = (h ^ (lane[at] & _HEAD[np.minimum(left, 8)])) * np.uint64(_BASE)
            h ^= h >> np.uint64(32)
            if which is None:
                h_all = h
            else:
                h_all[which] = h
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            which = more if which is None else which[more]
            at, left, h = at[more] + 8, left[more] - 8, h[more]
        else:
            for i, a, n in zip(which, at, left):
                whole = lane[a : a + n : 8].copy()
                whole[-1] &= _HEAD[(n - 1) % 8 + 1]
                h_all[i] = (h_all[i : i + 1] * np.uint64(_BASE) ^ _tree(whole))[0]
        out[row] = mix(h_all)
    return out


def same_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether the i-th span of ``a`` has the bytes of the i-th span of ``b``."""
    left = a_ends - a_starts
    same = left == b_ends - b_starts
    la, lb, which = lanes(a), lanes(b), np.flatnonzero(same)
    left, x, y = left[which], a_starts[which], b_starts[which]
    for _ in range(_LANES):
        equal = (la[x] ^ lb[y]) & _HEAD[np.minimum(left, 8)] == 0
        same[which[~equal]] = False
        more = np.flatnonzero(equal & (left > 8))
        if not len(more):
            return same
        which, left, x, y = which[more], left[more] - 8, x[more] + 8, y[more] + 8
    for i, n, u, v in zip(which, left, x, y):
        same[i] = np.array_equal(a[u : u + n], b[v : v + n])
    return same


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each span, A-Z folded to a-z (with ``fold``); equal bytes have equal hashes."""
    return prefix_hashes(data, starts, ends, (0,), fold)[0]


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(_BASE) + hashes[k : n + k]
    return mix(out)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def window_slots(data: np.ndarray, width: int, bits: int) -> np.ndarray:
    """For each byte a slot of 2**bits for the ``width`` bytes that end there, A-Z folded; blanks stand before the first byte."""
    low = np.concatenate([np.full(width - 1, 32, np.uint8), LOWER[data]]).astype(np.uint64)
    low[low == 10] = 32
    key = np.zeros(len(data), np.uint64)
    for k in range(width):
        key = (key << np.uint64(8)) | low[k : k + len(data)]
    return ((key * np.uint64(_BASE)) >> np.uint64(64 - bits)).astype(np.int64)


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive positions of ``first`` (an empty run sums to 0)."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row holds a Unicode letter; only rows without an ASCII letter are decoded."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    found = per_row(ascii_letter, offsets) > 0
    for i in np.flatnonzero(~found & (per_row(data >= 128, offsets) > 0)):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found
