"""Alignment of two tokenizations by whitespace-token anchors.

A text is tokenized whole by both tokenizers, and the bytes of either side's tokens are
compared with the text. Where a token of each side begins with a space at one and
the same byte, the end before it is shared: an anchor. Anchors split a document into windows of token ids
(mostly single words), and a window's alignment depends on its ids alone, so
it is worked out once for each pair of id tuples and looked up from then on. Its
groups are cut at the byte offsets where tokens of both sides end;
the two tokens that end there are linked.

Link counts of the corpus are sums over tasks. The HELD most frequent pairs
travel to the tasks as a table; links of all other pairs get their counts by a join.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unveil.llm.shared import stored, text_of
from unveil.llm.textblocks import blocks, per_row, same_spans, span_hashes
from unveil.llm.token_files import WordwiseTokenizer, _binaries, _Grown, _Numbers

WINDOWS_HELD = 150_000
UNITS_HELD = 400_000
HELD = 1 << 20
PAIRS_HELD = 1 << 19
TEXT_BYTES = 1 << 18
LINK_BYTES = 1 << 20
GAP = 0xFFFFFFFF  # between the ids of both sides in a window's key; no id
LONG_TEXT = 1 << 18  # characters; longer texts reach the piece tokenizer in parts, cut where no piece can cross


def byte_of() -> dict[str, int]:
    """The character of each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Entries:
    """The bytes of every id of a vocabulary."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(x) for x in raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.spaced = np.array([x[:1] == b" " for x in raw])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        n = self.size[ids]
        at = np.repeat(self.first[ids] - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        return self.data[at]


def give_back() -> None:
    """Returns freed memory of Arrow and, where it can be asked to, of the C library to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # not glibc


class Windows:
    """Windows met so far by their id tuples, with their groups as text and their links."""

    def __init__(self):
        self.numbers = _Numbers()
        self.raw, self.text, self.links = _Grown(np.uint8), _Grown(np.uint8), _Grown(np.uint32)
        self.raw_end, self.text_end, self.link_end = (_Grown(np.int64) for _ in range(3))
        for ends in (self.raw_end, self.text_end, self.link_end):
            ends.add(np.zeros(1, np.int64))

    def get(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of windows given by hash and bytes; -1 for those that are not known."""
        numbers = self.numbers.get(keys)
        met = np.flatnonzero(numbers >= 0)
        at = numbers[met]
        same = same_spans(raw, starts[met], ends[met], self.raw.room[: self.raw.n], self.raw_end.room[at], self.raw_end.room[at + 1])
        numbers[met[~same]] = -1
        return numbers.astype(np.int64)

    def add(self, keys: np.ndarray, raw, raw_size, text, text_size, links, n_links) -> None:
        """Stores windows that are new and whose hashes differ from each other and from all known ones."""
        self.numbers.add(keys, np.arange(self.raw_end.n - 1, self.raw_end.n - 1 + len(keys), dtype=np.int32))
        for held, ends, values, size in ((self.raw, self.raw_end, raw, raw_size), (self.text, self.text_end, text, text_size), (self.links, self.link_end, links.ravel(), 2 * n_links)):
            ends.add(held.n + np.cumsum(size))
            held.add(values)


def spans(held: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The given spans of an array, one after the other."""
    n = hi - lo
    return held[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]


class Pair:
    """Both tokenizers with their entries, and the windows met so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = WordwiseTokenizer(path_a)
        chars = byte_of()
        entries = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.vocabulary)]
        self.of_a = Entries([bytes(chars[c] for c in e) if all(c in chars for c in e) else e.encode() for e in entries])
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.of_b = Entries([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.digits = Entries([str(i).encode() for i in range(max(len(entries), len(pieces)))])
        # pieces never hold a space behind another character, so a text may be cut before such a space
        self.cuttable = not any(" " in p.replace("▁", " ").lstrip(" ") for p in pieces)
        self._clear()

    def _clear(self) -> None:
        self.windows = Windows()

    def forget(self) -> None:
        """Frees what has been looked up so far."""
        self._clear()
        self.a._clear()
        give_back()

    def pieces(self, text: str) -> list[int]:
        """Ids of a whole text by the piece tokenizer."""
        if len(text) <= LONG_TEXT or not self.cuttable:
            return self.b.encode(text, num_threads=1) if text else []
        out, lo = [], 0
        while lo < len(text):
            hi = lo + LONG_TEXT
            while 0 < hi < len(text) and not (text[hi] == " " and text[hi - 1] not in " ▁"):
                step = text.find(" ", hi + 1)
                hi = step if step > 0 else len(text)
            out += self.b.encode(text[lo:hi], num_threads=1)
            lo = min(hi, len(text)) + 1  # the tokenizer puts the space back
            if lo == len(text):
                out.append(self.b.piece_to_id("▁"))
        return out

    def _tokens(self, rows: pa.Array, lead: np.ndarray, offsets: np.ndarray):
        """Flat ids and numbers of ids of both sides; texts whose token bytes differ from the text have none."""
        ids_a, n_a = self.a.encode(rows, lead, offsets)
        found = [np.array(self.pieces(t[1:]), np.uint32) for t in rows.to_pylist()]
        n_b = np.array([len(x) for x in found], np.int64)
        ids_b = np.concatenate([*found, np.zeros(0, np.uint32)])
        right = np.diff(offsets) > 1
        for ids, n, entries in ((ids_a, n_a, self.of_a), (ids_b, n_b, self.of_b)):
            size = per_row(entries.size[ids], np.concatenate([[0], np.cumsum(n)])).astype(np.int64)
            right &= size == np.diff(offsets)
        for ids, n, entries in ((ids_a, n_a, self.of_a), (ids_b, n_b, self.of_b)):
            same = entries.joined(ids[np.repeat(right, n)]) == lead[np.repeat(right, np.diff(offsets))]
            kept = np.concatenate([[0], np.cumsum(np.diff(offsets)[right])])
            right[np.flatnonzero(right)[per_row(~same, kept) > 0]] = False
        return ids_a[np.repeat(right, n_a)], np.where(right, n_a, 0), ids_b[np.repeat(right, n_b)], np.where(right, n_b, 0)

    def _aligned(self, a, ends_a, of_a, b, ends_b, of_b, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Groups of n windows as text (each group ends in ';') and links, with their numbers in each window.

        ``a`` and ``b`` are the ids of the windows' tokens, ``ends`` their byte ends, ``of`` their windows.
        """
        shared, x, y = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        ids, of = np.concatenate([a, b]), np.concatenate([of_a, of_b])
        side = np.concatenate([2 * np.searchsorted(shared, ends_a), 2 * np.searchsorted(shared, ends_b) + 1])
        order = np.argsort(side, kind="stable")
        ids, of, side = ids[order], of[order], side[order]
        size = self.digits.size[ids]
        ends = np.cumsum(size + 1)
        text = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        mark = np.ones(len(text), bool)
        mark[ends - 1] = False
        text[mark] = self.digits.joined(ids)
        last = np.append(side[1:] != side[:-1], True)[: len(side)]
        text[ends - 1] = np.where(~last, ord(","), np.where(side % 2 == 0, ord("|"), ord(";")))
        links = np.stack([a[x], b[y]], axis=1).astype(np.uint32)
        return text, np.bincount(of, size + 1, n).astype(np.int64), links, np.bincount(of_a[x], minlength=n)

    def align(self, rows: pa.Array, lead: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[memoryview], np.ndarray, np.ndarray]:
        """n_a, n_b and groups of each row of a block, all links (a and b of each) and the first link of each row.

        Texts come with a space in front.
        """
        if self.windows.numbers.n > WINDOWS_HELD:
            self._clear()
        if self.a.numbers.n > UNITS_HELD:
            self.a._clear()
        ids_a, n_a, ids_b, n_b = self._tokens(rows, lead, offsets)
        size_a, size_b = self.of_a.size[ids_a], self.of_b.size[ids_b]
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        row_a, row_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        marked_a, marked_b = self.of_a.spaced[ids_a], self.of_b.spaced[ids_b]
        marked_a[row_a[:-1][n_a > 0]] = marked_b[row_b[:-1][n_b > 0]] = True  # texts begin with a space
        at_a, at_b = np.flatnonzero(marked_a), np.flatnonzero(marked_b)
        _, x, y = np.intersect1d((ends_a - size_a)[at_a], (ends_b - size_b)[at_b], assume_unique=True, return_indices=True)
        cut_a, cut_b = np.append(at_a[x], len(ids_a)), np.append(at_b[y], len(ids_b))
        # a window's key: the ids of both sides with a gap between them
        m, many_a, many_b = len(x), np.diff(cut_a), np.diff(cut_b)
        of_a, of_b = np.repeat(np.arange(m), many_a), np.repeat(np.arange(m), many_b)
        ends = np.cumsum(many_a + many_b + 1)
        starts = ends - (many_a + many_b + 1)
        key = np.full(int(ends[-1]) if m else 0, GAP, np.uint32)
        key[np.arange(len(ids_a)) + (starts - cut_a[:-1])[of_a]] = ids_a
        key[np.arange(len(ids_b)) + (ends - many_b - cut_b[:-1])[of_b]] = ids_b
        raw, starts, ends = key.view(np.uint8), 4 * starts, 4 * ends
        keys = span_hashes(raw, starts, ends, fold=False)
        known = self.windows
        found = known.get(keys, raw, starts, ends)
        new = np.flatnonzero(found < 0)
        if len(new):
            unique, one = np.unique(keys[new], return_index=True)
            one = np.sort(new[one[known.numbers.get(unique) < 0]])  # in order of the text
            pick = np.full(m, -1)
            pick[one] = np.arange(len(one))
            mine_a, mine_b = pick[of_a] >= 0, pick[of_b] >= 0
            made = self._aligned(ids_a[mine_a], ends_a[mine_a], pick[of_a[mine_a]], ids_b[mine_b], ends_b[mine_b], pick[of_b[mine_b]], len(one))
            known.add(keys[one], spans(raw, starts[one], ends[one]), (ends - starts)[one], *made)
            found = known.get(keys, raw, starts, ends)
            if (found < 0).any():  # windows that share a hash with others: once more, without the table
                self._clear()
                return self._apart(rows, lead, offsets)
        text = spans(known.text.room, known.text_end.room[found], known.text_end.room[found + 1])
        pairs = spans(known.links.room, known.link_end.room[found], known.link_end.room[found + 1]).reshape(-1, 2)
        row_window = np.searchsorted(cut_a[:-1], row_a)
        text_at = np.concatenate([[0], np.cumsum(known.text_end.room[found + 1] - known.text_end.room[found])])[row_window]
        link_at = np.concatenate([[0], np.cumsum(known.link_end.room[found + 1] - known.link_end.room[found])])[row_window] // 2
        view = memoryview(text)
        groups = [view[lo : max(hi - 1, lo)] for lo, hi in zip(text_at.tolist(), text_at[1:].tolist())]
        return n_a, n_b, groups, pairs, link_at

    def _apart(self, rows: pa.Array, lead: np.ndarray, offsets: np.ndarray):
        """As ``align``, each window worked out where it stands."""
        ids_a, n_a, ids_b, n_b = self._tokens(rows, lead, offsets)
        ends_a, ends_b = np.cumsum(self.of_a.size[ids_a]), np.cumsum(self.of_b.size[ids_b])
        of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        text, size, links, n = self._aligned(ids_a, ends_a, of_a, ids_b, ends_b, of_b, len(n_a))
        ends, view = np.cumsum(size), memoryview(text)
        return n_a, n_b, [view[e - k : max(e - 1, e - k)] for e, k in zip(ends.tolist(), size.tolist())], links, np.concatenate([[0], np.cumsum(n)])


_open: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers for each Python worker."""
    if (path_a, path_b) not in _open:
        _open[path_a, path_b] = Pair(path_a, path_b)
    return _open[path_a, path_b]


ALIGNED = "uid long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """ALIGNED for rows (uid, doc_id, text with a space in front); links are pairs of unsigned 32-bit ids (a, b)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text", TEXT_BYTES):
                n_a, n_b, groups, links, first = pair.align(rows.column(2), data, offsets)
                sha = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(groups, n_a.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(n_a), pa.array(n_b), pa.array(np.diff(first)), pa.array(sha, pa.string()), _binaries(links.astype("<u4").view(np.uint8).ravel(), 8 * first)],
                    ["uid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
                )
        pair.forget()  # the worker lives on and serves other stages

    return docs.mapInArrow(run, ALIGNED)


def _keys(data: np.ndarray) -> np.ndarray:
    """b << 32 | a of each link."""
    return data.view("<i8")


def counted(batches) -> Iterator[pa.RecordBatch]:
    """a, b, n of the links of a task; a pair may come more than once."""
    keys, n, held = [], [], 0

    def total():
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return [key], [np.bincount(inverse, np.concatenate(n)).astype(np.int64)]

    def out():
        (key,), (count,) = total()
        return pa.RecordBatch.from_arrays([pa.array(key & 0xFFFFFFFF), pa.array(key >> 32), pa.array(count)], ["a", "b", "n"])

    for batch in batches:
        for _, data, _ in blocks(batch, "links", LINK_BYTES):
            key, count = np.unique(_keys(data), return_counts=True)
            keys.append(key)
            n.append(count)
            held += len(key)
            if held > PAIRS_HELD:
                keys, n = total()
                held = len(keys[0])
                if held > PAIRS_HELD // 2:
                    yield out()
                    keys, n, held = [], [], 0
    if keys:
        yield out()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (links of the pair), best (the count is the highest of its b) over all documents."""
    counts = aligned.select("links").mapInArrow(counted, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = stored(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def summed(batches, keys: np.ndarray, count: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The columns before ``links``, n_best and count_sum over links whose keys are in the table."""
    for batch in batches:
        for rows, data, offsets in blocks(batch, "links", LINK_BYTES):
            unique, inverse = np.unique(_keys(data), return_inverse=True)
            at = np.minimum(np.searchsorted(keys, unique), max(len(keys) - 1, 0))
            hit = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
            c = np.where(hit, count[at], 0) if len(keys) else np.zeros(len(unique), np.int64)
            b = np.where(hit, best[at], 0) if len(keys) else np.zeros(len(unique), np.int64)
            first = offsets // 8
            sums = [np.concatenate([[0], np.cumsum(x[inverse])]) for x in (b, c)]
            names = [f for f in rows.schema.names if f != "links"]
            yield pa.RecordBatch.from_arrays([*(rows.column(f) for f in names), *(pa.array(s[first[1:]] - s[first[:-1]]) for s in sums)], [*names, "n_best", "count_sum"])


def beyond(batches, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """uid, a, b of each link whose key is not in the table."""
    for batch in batches:
        for rows, data, offsets in blocks(batch, "links", LINK_BYTES):
            key = _keys(data)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            rare = np.flatnonzero(keys[at] != key) if len(keys) else np.arange(len(key))
            row = np.searchsorted(offsets // 8, rare, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [rows.column("uid").take(pa.array(row)), pa.array(key[rare] & 0xFFFFFFFF), pa.array(key[rare] >> 32)], ["uid", "a", "b"]
            )


def with_counts(aligned: DataFrame, pairs: DataFrame, held: int = HELD) -> DataFrame:
    """The rows of ``aligned`` with n_best and count_sum in place of the links."""
    top = pairs.orderBy(F.desc("count"), "b", "a").limit(held).select((F.col("b") * (1 << 32) + F.col("a")).alias("key"), "count", "best").toArrow().sort_by("key")
    all_held = top.num_rows < held or pairs.count() == held
    table = aligned.sparkSession.sparkContext.broadcast((top["key"].to_numpy(), top["count"].to_numpy(), top["best"].to_numpy(zero_copy_only=False).astype(np.int64)))
    sums = aligned.mapInArrow(lambda batches: summed(batches, *table.value), ALIGNED.removesuffix("links binary") + "n_best long, count_sum long")
    if all_held:
        return sums
    # pairs beyond the table are rarer than all in it, so none of them is hot
    rare = aligned.select("uid", "links").mapInArrow(lambda batches: beyond(batches, table.value[0]), "uid long, a long, b long")
    found = rare.groupBy("uid", "a", "b").agg(F.count("*").alias("n")).join(pairs.hint("merge"), ["a", "b"]).groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum")
    )
    more = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return sums.join(found.hint("merge"), "uid", "left").withColumns(more).drop("more_best", "more_sum")


def report(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` names a byte-level vocabulary of the tokenizers library (it reads
    a space and the text; strings of special tokens are ordinary text), ``path_b`` a
    sentencepiece model (it reads the text and puts a space in front). Null and empty
    texts, and those that a tokenizer does not give back byte for byte, have no tokens:
    zeros, and '' for the hash. Each row has a row; repeated ids and repeated
    texts count as often as they stand there, null ids too. An empty
    table gives none. Other columns are not read. Texts of more than LONG_TEXT characters are
    cut for the piece tokenizer before spaces that none of its pieces can cross.
    """
    lead = F.concat(F.lit(" "), text_of(text)).alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("bigint").alias("doc_id"), lead)
    aligned = stored(align(rows, path_a, path_b), "aligned", compression="zstd")
    pairs = stored(pair_counts(aligned), "pairs")
    out = with_counts(aligned, pairs, held)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
