"""Canonical length-limited Huffman codes over integer ids, in numpy."""

from __future__ import annotations

import numpy as np

LIMIT = 18
STRIDE = 128  # ids between two checkpoints


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (0 for ids that never occur), by package-merge.

    Level by level the items are merged with the pairs of the level below; an
    item's length is the number of levels in which it is among the chosen.
    """
    used = np.flatnonzero(counts)
    n = len(used)
    lengths = np.zeros(len(counts), np.int64)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels, current = [], weights
    is_item = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_item)
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        rank = np.argsort(merged, kind="stable")
        current, is_item = merged[rank], rank < n
    levels.append(is_item)
    take, found = 2 * n - 2, np.zeros(n, np.int64)
    for is_item in reversed(levels):
        items = int(is_item[:take].sum())
        found[:items] += 1
        take = 2 * (take - items)
    lengths[order] = found
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        top = int(lengths[order].max())
        steps = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
        codes[order] = (np.cumsum(steps) - steps) >> (top - lengths[order]).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For every ``limit``-bit window the id at its head and the length of that id's code."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    ids, sizes = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    spread = 1 << (limit - lengths[order])
    total = int(spread.sum())
    ids[:total] = np.repeat(order, spread)
    sizes[:total] = np.repeat(lengths[order], spread)
    return ids, sizes


def encode(ids: np.ndarray, first: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of consecutive rows, each row from a byte boundary on.

    ``first`` holds the place of each row's first id, and the end. Returns the
    payload bytes, the byte at which each row starts (and the end), and the
    bit position of every id.
    """
    size = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    row_bits = ends[first[1:]] - ends[first[:-1]]
    row_bytes = np.concatenate([[0], np.cumsum((row_bits + 7) // 8)])
    at = ends[:-1] + np.repeat(8 * row_bytes[:-1] - ends[first[:-1]], np.diff(first))
    words = np.zeros(int(row_bytes[-1]) // 8 + 2, np.uint64)
    if len(ids):
        word, room = at >> 6, 64 - (at & 63)
        over = np.maximum(size - room, 0)
        code = codes[ids]
        value = (code >> over.astype(np.uint64)) << np.maximum(room - size, 0).astype(np.uint64)
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[heads]] = np.bitwise_or.reduceat(value, heads)
        tail = np.flatnonzero(over)
        words[word[tail] + 1] |= code[tail] << (64 - over[tail]).astype(np.uint64)
    return words.byteswap().view(np.uint8)[: int(row_bytes[-1])], row_bytes, at


def decode(payload: np.ndarray, at: np.ndarray, count: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """Ids of the runs that start at bit ``at`` and hold ``count`` ids, one run after the other.

    All runs advance together, one id a step: a window is looked up in the
    table and its code length moves the run on.
    """
    ids, sizes = table
    wide = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    start = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(start[-1]), np.uint32)
    order = np.argsort(-count, kind="stable")
    at, place, left = at[order].copy(), start[:-1][order], count[order]
    mask = np.uint32((1 << limit) - 1)
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -step, side="left"))
        p = at[:live]
        head = (window[p >> 3] >> (32 - limit - (p & 7)).astype(np.uint32)) & mask
        out[place[:live] + step] = ids[head]
        at[:live] += sizes[head]
    return out
