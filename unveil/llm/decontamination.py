"""Benchmark decontamination with suffix arrays over the training text.

A shard is a run of whole documents of about SHARD_BYTES (a longer document is
cut, with an overlap). Its words become numbers and its suffix array lists all word
positions in the order of the text that starts there. Every suffix of every
test item is searched in every shard: two binary searches a word narrow the
range of training suffixes that agree with it, until none is left. The range at
the window's width gives all places of the window, the last range the longest
verbatim match and its places.

Shards are built in the tasks that read the documents, so no training text is
shuffled. Tests come in slices of about SLICE_WORDS words, broadcast one after
the other; each slice is one more pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unveil.llm.shared import stored, text_of
from unveil.llm.textblocks import LOWER, blocks, same_spans, span_hashes, word_spans

WINDOW = 10
SHARD_BYTES = 1 << 22
SLICE_WORDS = 1 << 20
PIECE_WORDS = 4096  # longer items are cut into pieces that share all but one word of a window

BETWEEN = np.zeros(256, bool)
BETWEEN[0x00:0x30] = BETWEEN[0x3A:0x41] = BETWEEN[0x5B:0x61] = BETWEEN[0x7B:0x80] = True


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), and for each the range that it is of."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the symbols but 0, in the order of at least the next ``depth`` symbols (0 ends a text).

    Prefix doubling; from the second round on only positions still tied are sorted.
    """
    n = len(symbols)
    sa = np.flatnonzero(symbols)
    wide = np.append(symbols, 0)
    key = wide[sa] * (wide.max() + 1) + wide[sa + 1]
    order = np.argsort(key, kind="stable")
    sa, key = sa[order], key[order]
    head = np.append(True, key[1:] != key[:-1])[: len(sa)]
    first = np.maximum.accumulate(np.where(head, np.arange(len(sa)), 0)) if len(sa) else sa
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = first + 1
    width = 2
    while width < depth:
        at = np.flatnonzero(~head | ~np.append(head[1:], True)[: len(sa)])
        if not len(at):
            break
        key = first[at] * (n + 2) + rank[np.minimum(sa[at] + width, n)]
        order = np.argsort(key, kind="stable")
        sa[at], key = sa[at][order], key[order]
        head[at] = np.append(True, key[1:] != key[:-1])
        first[at] = np.maximum.accumulate(np.where(head[at], at, 0))
        rank[sa[at]] = first[at] + 1
        width *= 2
    return sa


@dataclass
class Tests:
    """A slice of the test items, as tasks need it."""

    data: np.ndarray  # the distinct words, one after the other
    ends: np.ndarray
    keys: np.ndarray  # their hashes, ascending
    symbols: np.ndarray  # 1 + number of the word at each position; 0 ends a piece
    piece: np.ndarray  # the piece at each position
    at: np.ndarray  # the first word of each piece in its item
    start: np.ndarray  # the first position of each piece
    width: np.ndarray  # the window of each piece
    item: np.ndarray  # the item of each piece, a place in names
    names: list[str | None]
    longest: int


def cut_items(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item, at (first word), width (of its windows), n, words (joined by blanks) of every piece of every item."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        step = max(1, PIECE_WORDS - window + 1)
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                starts, ends, first = word_spans(data, offsets, BETWEEN)
                raw, out = LOWER[data].tobytes(), []
                for i, name in enumerate(rows.column(0).to_pylist()):
                    n = int(first[i + 1] - first[i])
                    width = min(window, n)
                    for at in range(0, n - width + 1, step) if n else ():
                        span = range(first[i] + at, min(first[i + 1], first[i] + at + PIECE_WORDS))
                        out.append((name, at, width, len(span), b" ".join(raw[starts[k] : ends[k]] for k in span)))
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], ["item", "at", "width", "n", "words"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "item string, at long, width int, n long, words binary").distinct()


def gather(pieces: pa.Table) -> Tests:
    """The searchable form of a slice of pieces."""
    pieces = pieces.sort_by([("item", "ascending"), ("at", "ascending"), ("words", "ascending")])
    texts = [x.split(b" ") for x in pieces["words"].to_pylist()]
    number: dict[bytes, int] = {}
    rows = [[number.setdefault(w, len(number)) for w in words] for words in texts]
    ends = np.cumsum([len(w) for w in number]).astype(np.int64)
    data = np.frombuffer(b"".join(number), np.uint8)
    keys = span_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if number else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    words = list(number)
    words = [words[i] for i in order]
    size = np.array([len(r) for r in rows], np.int64)
    symbols = np.zeros(int(size.sum()) + len(rows), np.int64)
    start = np.cumsum(size + 1) - size - 1
    for s, r in zip(start, rows):
        symbols[s : s + len(r)] = place[r] + 1
    names: dict[str | None, int] = {}
    item = np.array([names.setdefault(x, len(names)) for x in pieces["item"].to_pylist()], np.int64)
    return Tests(
        np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]).astype(np.int64), keys[order], symbols, np.repeat(np.arange(len(rows)), size + 1),
        pieces["at"].to_numpy(), start, pieces["width"].to_numpy().astype(np.int64), item, list(names), int(size.max(initial=0)),
    )


class Shard:
    """Words of a run of documents and their suffix array.

    Words are told apart by a 64-bit hash; those that a test knows are compared byte by byte.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tests: Tests):
        self.starts, self.ends, self.first = word_spans(data, offsets, BETWEEN)
        keys = span_hashes(data, self.starts, self.ends)
        order = np.argsort(keys, kind="stable")
        new = np.append(True, keys[order][1:] != keys[order][:-1])[: len(keys)]
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new)
        distinct = keys[order][new]
        # the shard's number of each test word, 0 if it does not occur
        spot = np.searchsorted(distinct, tests.keys)
        known = spot < len(distinct)
        known[known] = distinct[spot[known]] == tests.keys[known]
        self.number_of = np.append(0, np.where(known, spot + 1, 0))
        word = np.full(len(distinct) + 1, -1)
        word[spot[known] + 1] = np.flatnonzero(known)
        alike = np.flatnonzero(word[number] >= 0)
        other, lowered = word[number[alike]], LOWER[data]
        begin = np.concatenate([[0], tests.ends[:-1]]).astype(np.int64)
        same = same_spans(lowered, self.starts[alike], self.ends[alike], tests.data, begin[other], tests.ends[other]) if len(alike) else np.zeros(0, bool)
        number[alike[~same]] = len(distinct) + 1
        n_words = np.diff(self.first)
        self.row = np.repeat(np.arange(len(n_words)), n_words + 1)
        self.symbols = np.zeros(len(keys) + len(n_words), np.int64)
        self.symbols[np.arange(len(keys)) + np.repeat(np.arange(len(n_words)), n_words)] = number
        self.row_start = self.first[:-1] + np.arange(len(n_words))
        self.sa = suffix_array(self.symbols, tests.longest)

    def _bound(self, lo, hi, depth: int, want, after: bool):
        """First place of [lo, hi) whose symbol at ``depth`` is at least ``want`` (greater than it, with ``after``)."""
        lo, hi = lo.copy(), hi.copy()
        wide = np.append(self.symbols, 0)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            found = wide[np.minimum(self.sa[mid] + depth, len(self.symbols))]
            up = found <= want[open_] if after else found < want[open_]
            lo[open_[up]], hi[open_[~up]] = mid[up] + 1, mid[~up]

    def search(self, tests: Tests):
        """Searches all suffixes of the tests.

        Returns for each position of the shard the length of the longest match that starts
        there (0 below the window) and the test position that it matches, whether the position is hit, and
        the (row, item) pairs.
        """
        n = len(self.symbols)
        longest, by, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        wanted = np.append(self.number_of[tests.symbols], 0)
        width = tests.width[tests.piece] if len(tests.piece) else tests.piece
        open_ = np.flatnonzero(wanted[:-1] > 0)
        lo, hi, depth = np.zeros(len(open_), np.int64), np.full(len(open_), len(self.sa)), 0
        while len(open_):
            want = wanted[open_ + depth]
            lo, hi = self._bound(lo, hi, depth, want, False), self._bound(lo, hi, depth, want, True)
            depth += 1
            left = (hi > lo) & (want > 0)
            open_, lo, hi = open_[left], lo[left], hi[left]
            full = np.flatnonzero(width[open_] <= depth)
            if len(full):
                _, one = np.unique(lo[full], return_index=True)  # equal texts have equal ranges
                place, which = ranges(lo[full][one], hi[full][one])
                longest[self.sa[place]], by[self.sa[place]] = depth, open_[full][one][which]
            window = np.flatnonzero(width[open_] == depth)
            if len(window):
                low, one, group = np.unique(lo[window], return_index=True, return_inverse=True)
                place, which = ranges(low, hi[window][one])
                at = self.sa[place]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + depth, -1)
                # items that share a window, then the rows that hold it
                item = np.unique(group * len(tests.names) + tests.item[tests.piece[open_[window]]])
                rows = np.unique(which * len(self.first) + self.row[at])
                begin = np.searchsorted(item // len(tests.names), rows // len(self.first), side="left")
                end = np.searchsorted(item // len(tests.names), rows // len(self.first), side="right")
                each, r = ranges(begin, end)
                pairs.append(np.unique((rows[r] % len(self.first)) * len(tests.names) + item[each] % len(tests.names)))
            on = wanted[open_ + depth] > 0 if len(open_) else np.zeros(0, bool)
            open_, lo, hi = open_[on], lo[on], hi[on]
        return longest, by, np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(pairs))


@dataclass
class Found:
    """What a document holds of the tests."""

    n_words: int
    hits: np.ndarray  # for each word
    items: set
    best: tuple  # length, first word, item


def _long_cuts(data: np.ndarray, tests: Tests) -> Iterator[tuple[np.ndarray, int, bool]]:
    """Parts of one long text, the number of leading words that the part before holds too, and whether it is the last."""
    lo, hi, shared = 0, 0, 0
    while hi < len(data):
        hi = min(len(data), hi + SHARD_BYTES)
        while hi < len(data) and not BETWEEN[data[hi]]:
            step = np.flatnonzero(BETWEEN[data[hi : hi + SHARD_BYTES]])
            hi = hi + int(step[0]) if len(step) else min(len(data), hi + SHARD_BYTES)
        yield data[lo:hi], shared, hi == len(data)
        starts = word_spans(data[lo:hi], np.array([0, hi - lo]), BETWEEN)[0]
        shared = min(tests.longest, len(starts))
        lo = lo + int(starts[-shared]) if shared else hi


def _rows_of(shard: Shard, tests: Tests, longest, by, hit, pairs, upto: int | None = None) -> list[Found]:
    out = []
    items: dict[int, set] = {}
    for pair in pairs.tolist():
        items.setdefault(pair // len(tests.names), set()).add(tests.names[pair % len(tests.names)])
    size = np.diff(shard.first)
    for i, (start, n) in enumerate(zip(shard.row_start.tolist(), size.tolist())):
        best = (0, -1, None)
        if i in items:
            own = longest[start : start + (n if upto is None else upto)]
            at = int(np.argmax(own)) if len(own) else 0
            if len(own) and own[at]:
                best = (int(own[at]), at, tests.names[tests.item[tests.piece[by[start + at]]]])
        out.append(Found(n, hit[start : start + n] if i in items else np.zeros(0, bool), items.get(i, set()), best))
    return out


def _better(a: tuple, b: tuple) -> tuple:
    """The longer match; of equals the earlier, then the smaller item."""
    return min(a, b, key=lambda x: (-x[0], x[1], x[2] or ""))


def scan(data: np.ndarray, offsets: np.ndarray, tests: Tests) -> list[Found]:
    """What each row of a block holds."""
    if len(offsets) > 2 or len(data) <= 2 * SHARD_BYTES:
        shard = Shard(data, offsets, tests)
        return _rows_of(shard, tests, *shard.search(tests))
    total, held, hits, items, best = 0, np.zeros(0, bool), [], set(), (0, -1, None)
    for part, shared, last in _long_cuts(data, tests):
        shard = Shard(part, np.array([0, len(part)]), tests)
        n = len(shard.starts)
        own = n if last else n - min(tests.longest, n)  # matches that start later are searched again
        (found,) = _rows_of(shard, tests, *shard.search(tests), upto=own)
        flags = found.hits if len(found.hits) else np.zeros(n, bool)
        flags = flags.copy()
        flags[:shared] |= held
        best = _better(best, (found.best[0], found.best[1] + total, found.best[2])) if found.best[0] else best
        items |= found.items
        hits.append(flags[:own])
        held = flags[own:]
        total += own
    hits = np.concatenate(hits)
    return [Found(total, hits if hits.any() else np.zeros(0, bool), items, best)]


STATE = "__words long, __hits binary, __items array<string>, __len int, __at long, __by string"


def _slices(benchmark: DataFrame, item_id: str, text: str, window: int) -> list[Tests]:
    """The tests, a slice of bounded size at a time."""
    pieces = stored(cut_items(benchmark, item_id, text, window), "test-pieces")
    n = pieces.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-n // SLICE_WORDS))
    mine = F.pmod(F.xxhash64("item", "at", "words"), F.lit(parts))
    for k in range(parts):
        yield gather(pieces.where(mine == k).toArrow())


def annotate(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and the STATE columns."""
    names = docs.columns
    empty = [F.lit(None).cast(c.dataType).alias(c.name) for c in T.StructType.fromDDL(STATE).fields]
    now = docs.select(*names, text_of(text).alias("__text"), *empty)
    state = [c.name for c in T.StructType.fromDDL(STATE).fields]
    slices = list(_slices(benchmark, item_id, item_text, window))
    for k, tests in enumerate(slices):
        shared = docs.sparkSession.sparkContext.broadcast(tests)
        through = [*names, "__text"] if k + 1 < len(slices) else keep

        def run(batches, shared=shared, through=through):
            tests = shared.value
            for batch in batches:
                for rows, data, offsets in blocks(batch, "__text", SHARD_BYTES):
                    was = [rows.column(rows.schema.get_field_index(c)).to_pylist() for c in state]
                    out = [merge(f, *old) for f, old in zip(scan(data, offsets, tests), zip(*was))]
                    kinds = (pa.int64(), pa.binary(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.string())
                    added = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in through), *added], [*through, *state])

        schema = T.StructType([*(now.schema[c] for c in through), *T.StructType.fromDDL(STATE).fields])
        now = now.mapInArrow(run, schema)
    return now


def merge(found: Found, words, hits, items, length, at, by) -> tuple:
    """The state of a row after one more slice."""
    own = found.hits
    if hits:
        old = np.unpackbits(np.frombuffer(hits, np.uint8), count=found.n_words).astype(bool)
        own = own | old if len(own) else old
    best = _better(found.best, (length, at, by)) if length else found.best
    named = found.items | set(items or ())
    return found.n_words, np.packbits(own).tobytes() if len(own) else None, sorted(x for x in named if x is not None), *best


def n_hit() -> Column:
    """The number of set bits of ``__hits``."""
    digits = F.translate(F.hex("__hits"), "0", "")
    each = [F.length(digits) - F.length(F.translate(digits, chars, "")) for chars in ("1248", "3569AC", "7BDE", "F")]
    return F.coalesce(sum((k + 1) * c for k, c in enumerate(each)), F.lit(0)).cast("bigint")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; longest, longest_at, longest_item.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one; a word of a document inside any occurrence of a window is
    hit. ``items_sha256`` is of the ids of all items with occurring windows. The longest
    match (at least a window) starts at word ``longest_at``; ties go to the
    earlier place, then to the smaller item id.

    Null and empty texts have no words; items without words have no windows.
    Every row has a row, rows that repeat an id and null ids too. Items that repeat an id
    count as one item; items with a null id hit words but are not
    listed. Empty tables give no rows or no hits. Other columns are not read.
    Items of more than PIECE_WORDS words are searched in pieces: all their
    windows are found, and a longest match ends with its piece.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = annotate(rows, benchmark, ["doc_id"], window, "text", item_id, item_text)
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        F.col("__hits").isNotNull().alias("contaminated"),
        F.col("__len").alias("longest"),
        F.when(F.col("__len") > 0, F.col("__at")).alias("longest_at"),
        F.col("__by").alias("longest_item"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with their columns as they were."""
    found = annotate(docs, benchmark, docs.columns, window, text, item_id, item_text)
    return found.where("__hits is null").select(docs.columns)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, doc_at, n_words, item_id, item_at: where the documents hold verbatim matches of at least a window.

    At each word the longest match that starts there (of equals, the item that
    sorts first); matches that only continue the one a word before are left out. Tests in more than one slice give a
    row for the longest match of each slice.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("__text"))
    out = None
    for tests in _slices(benchmark, item_id, item_text, window):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches, shared=shared):
            tests = shared.value
            for batch in batches:
                for own, data, offsets in blocks(batch, "__text", SHARD_BYTES):
                    parts = [(data, 0, True)] if len(offsets) > 2 or len(data) <= 2 * SHARD_BYTES else _long_cuts(data, tests)
                    before, last = 0, 0
                    for part, _, final in parts:
                        shard = Shard(part, offsets if len(offsets) > 2 else np.array([0, len(part)]), tests)
                        longest, by, _, _ = shard.search(tests)
                        n = len(shard.starts)
                        upto = len(longest) if final else n - min(tests.longest, n)
                        ahead = np.append(last, longest[:-1])
                        at = np.flatnonzero((longest > 0) & (ahead != longest + 1))
                        at = at[at < upto]
                        last = longest[upto - 1] if upto else last
                        piece, row = tests.piece[by[at]], shard.row[at]
                        yield pa.RecordBatch.from_arrays(
                            [
                                own.column(0).take(pa.array(row)), pa.array(at - shard.row_start[row] + before), pa.array(longest[at]),
                                pa.array([tests.names[i] for i in tests.item[piece]], pa.string()), pa.array(by[at] - tests.start[piece] + tests.at[piece]),
                            ],
                            ["doc_id", "doc_at", "n_words", "item_id", "item_at"],
                        )
                        before += upto

        found = rows.mapInArrow(run, "doc_id long, doc_at long, n_words long, item_id string, item_at long")
        out = found if out is None else out.unionByName(found)
    return out
