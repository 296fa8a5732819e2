"""Token ids in Huffman-coded block files, written and read in id order.

The file format is a table of independent blocks (Parquet as the container, so
that any store Spark writes to will do): bucket, block, start (ids before the
block), doc_ids and n_tokens of its documents, payload, and marks, the bit
offset of every STRIDE-th id of each document within the payload. The codebook
(id, length) is a table of its own; canonical order gives the codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unveil.llm import huffman
from unveil.llm.ordered import bucket_of, buckets_for, id_cuts
from unveil.llm.shared import stored, text_of
from unveil.llm.textblocks import blocks, same_spans, span_hashes

END = 0
BLOCK_TOKENS = 1 << 17
UNITS_HELD = 1_500_000
NEWLINE = 198  # the byte-level vocabulary's id of a line feed
JOINED = 2000  # new units that the tokenizer gets in one string
_BLANK, _LINE, _RARE, _LETTER, _TAIL, _MARK = 1, 2, 4, 8, 16, 32
_KIND = np.zeros(256, np.uint8)
_KIND[32], _KIND[10] = _BLANK, _LINE
_KIND[[0, 9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = _RARE  # a text without them has no white space but blanks and line feeds, and no NUL
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = _TAIL  # behind 0xC3 the end of a letter
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(max(len(self.room), len(values)), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


class _Numbers:
    """64-bit hash -> number, in open addressing; half full at most."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.number = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; -1 for new ones."""
        mask = (1 << self.bits) - 1
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.number[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found[open_] = self.number[at[open_]]
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & (found[open_] >= 0)]
        return found

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Stores keys that are new and differ."""
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            old = self.number >= 0
            keys, numbers = np.concatenate([self.keys[old], keys]), np.concatenate([self.number[old], numbers])
            self.__init__(int(np.ceil(np.log2(4 * len(keys)))))
        self.n += len(keys)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.number[at[left]] < 0]
            self.number[at[free]] = numbers[free]  # of several at one place the last stays
            won = free[self.number[at[free]] == numbers[free]]
            self.keys[at[won]] = keys[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)


def _rows_of(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows in which the bytes at ``at`` stand."""
    return np.searchsorted(offsets, at, side="right") - 1


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after the other, and where each begins (and the end)."""
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])
    return data[np.arange(cuts[-1]) + np.repeat(starts - cuts[:-1], ends - starts)], cuts


def _lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The spans as lines, a line feed between two."""
    raw, cuts = _spans(data, starts, ends)
    return np.insert(raw, cuts[1:-1], np.uint8(10)).tobytes().decode()


class WordwiseTokenizer:
    """The ids that the tokenizer gives to whole texts, found unit by unit.

    A byte-level pre-tokenizer always cuts before a single blank that is
    followed by a non-blank, around a single line feed, and between a letter
    and an ASCII mark behind it. Texts whose blanks are all of that kind are
    cut there into units (" word", "word" at the start of a line, "," behind a
    word, a line feed); a unit is looked up by the 64-bit hash of
    its bytes and encoded when it is new. Its bytes are kept and compared, and
    a text with a unit that only shares the hash of a known one goes to the
    tokenizer whole. Other texts go to the tokenizer whole, as do
    texts with the string of an added token, which the library finds before it
    cuts; with ``literal`` such a string is ordinary text. The
    table of units is emptied when it has grown large.
    """

    def __init__(self, path: str, literal: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.added = [] if literal else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.encode("\n", add_special_tokens=False).ids != [NEWLINE]:
            raise ValueError("not the byte-level vocabulary that this reader knows")
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.first, self.size = _Grown(np.uint32), _Grown(np.int64), _Grown(np.int32)
        self.raw, self.raw_end = _Grown(np.uint8), _Grown(np.int64)
        self.raw_end.add(np.zeros(1, np.int64))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of numbered units, one after the other."""
        n = self.size.room[numbers]
        ends = np.cumsum(n)
        at = np.repeat(self.first.room[numbers] - ends + n, n)
        at += np.arange(len(at))
        return self.flat.room[at]

    def _clashes(self, numbers: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Units that are not the known ones whose hash they share.

        Units of one length up to eight bytes never share a hash, so only longer ones are compared.
        """
        lo, hi, size = self.raw_end.room[numbers], self.raw_end.room[numbers + 1], ends - starts
        other = size != hi - lo
        long = np.flatnonzero(~other & (size > 8))
        other[long] = ~same_spans(data, starts[long], ends[long], self.raw.room[: self.raw.n], lo[long], hi[long])
        return np.flatnonzero(other)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Finds the ids of new units. Those without a line feed are encoded in strings of many, a line feed between them."""
        raw, cuts = _spans(data, starts, ends)
        whole = np.zeros(len(keys), bool)
        whole[np.searchsorted(cuts, np.flatnonzero(raw == 10), side="right") - 1] = True
        first, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)

        def put(at, ids, sizes):
            size[at] = sizes
            first[at] = self.flat.n + np.cumsum(sizes) - sizes
            self.flat.add(ids)

        plain = np.flatnonzero(~whole)
        for lo in range(0, len(plain), JOINED):
            at = plain[lo : lo + JOINED]
            ids = self._whole([_lines(raw, cuts[at], cuts[at + 1])])[0]
            breaks = np.flatnonzero(ids == NEWLINE)
            put(at, ids[ids != NEWLINE], np.diff(breaks, prepend=-1, append=len(ids)) - 1)
        at = np.flatnonzero(whole)
        if len(at):
            found = self._whole([raw[cuts[i] : cuts[i + 1]].tobytes().decode() for i in at])
            put(at, np.concatenate(found), np.array([len(x) for x in found]))
        self.raw_end.add(self.raw.n + cuts[1:])
        self.raw.add(raw)
        self.numbers.add(keys, np.arange(self.first.n, self.first.n + len(keys), dtype=np.int32))
        self.first.add(first)
        self.size.add(size)

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rows that may hold the string of an added token."""
        raw, at = data.tobytes() if self.added else b"", []
        for token in self.added:
            found = raw.find(token)
            while found >= 0:
                at.append(found)
                found = raw.find(token, found + 1)
        return _rows_of(at, offsets)

    def encode(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a block one after the other, and each text's number of ids."""
        if self.numbers.n > UNITS_HELD:
            self._clear()
        kind = np.concatenate([_KIND[data], np.array([_BLANK], np.uint8)])
        blank, line = kind[:-1] == _BLANK, kind[:-1] == _LINE
        closed = kind[1:] & (_BLANK | _LINE) > 0  # whether a blank or a line feed follows; the end of a text counts as a blank
        closed[offsets[1:][offsets[1:] > 0] - 1] = True
        odd = np.zeros(len(offsets) - 1, bool)
        odd[_rows_of(np.flatnonzero(blank & closed | (kind[:-1] == _RARE)), offsets)] = True
        odd[self._with_added(data, offsets)] = True
        heads = offsets[:-1][np.diff(offsets) > 0]
        cut = blank.copy()
        at = np.flatnonzero(line)
        if len(at):
            fresh = np.zeros(len(data) + 1, bool)
            fresh[heads] = True
            beside = (fresh[at] | (data[at - 1] != 10)) & (fresh[at + 1] | (kind[at + 1] != _LINE))  # a line feed alone
            cut[at[beside]] = True
            behind = at[beside] + 1
            cut[behind[behind < len(data)]] = True
        at = np.flatnonzero((kind[1:-1] == _MARK) & (kind[:-2] & (_LETTER | _TAIL) > 0)) + 1
        letter = (kind[at - 1] == _LETTER) | (at > 1) & (data[at - 2] == 0xC3)
        cut[at[letter]] = True
        cut[heads] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        row_first = np.searchsorted(starts, offsets)
        if odd.any():
            use = ~np.repeat(odd, np.diff(row_first))
            starts, ends = starts[use], ends[use]
            row_first = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(row_first)))])
        keys = span_hashes(data, starts, ends, fold=False)
        numbers = self.numbers.get(keys)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            unique, at = np.unique(keys[new], return_index=True)
            self._learn(unique, data, starts[new[at]], ends[new[at]])
            numbers[new] = self.numbers.get(keys[new])
        odd[np.searchsorted(row_first, self._clashes(numbers, data, starts, ends), side="right") - 1] = True
        ids = self._joined(numbers)
        sizes = np.concatenate([[0], np.cumsum(self.size.room[numbers])])
        counts = sizes[row_first[1:]] - sizes[row_first[:-1]]
        if odd.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            at = np.flatnonzero(odd)
            for i, found in zip(at, self._whole([column[int(i)].as_py() for i in at])):
                parts[i], counts[i] = found, len(found)
            ids = np.concatenate(parts)
        return ids, counts.astype(np.int64)


_open: dict[str, WordwiseTokenizer] = {}


def tokenizer_for(path: str) -> WordwiseTokenizer:
    """One tokenizer for each Python worker."""
    if path not in _open:
        _open[path] = WordwiseTokenizer(path, literal=False)  # the library's default
    return _open[path]


def _binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n, ids (unsigned 16-bit, or 32-bit for larger vocabularies) with the end id, for rows (doc_id, text)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_for(path)
        kind = np.uint16 if tok.vocabulary <= 1 << 16 else np.uint32
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                ids, n = tok.encode(rows.column(1), data, offsets)
                ids = np.insert(ids.astype(kind), np.cumsum(n), END)
                cuts = np.concatenate([[0], np.cumsum(n + 1)]) * np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n + 1), _binaries(ids.view(np.uint8), cuts)], ["doc_id", "n", "ids"])

    return docs.mapInArrow(run, "doc_id long, n long, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int, kind: type) -> np.ndarray:
    """Occurrences of every id in the corpus; the driver sees one row for each id of the vocabulary at most."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for _, data, _ in blocks(batch, "ids"):
                total += np.bincount(data.view(kind), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    table = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[table["id"].to_numpy()] = table["n"].to_numpy()
    return counts


def write_blocks(tokens: DataFrame, lengths: np.ndarray, kind: type) -> DataFrame:
    """The block table, in ascending (bucket, block); rows of ``tokens`` are coded first and move as bits."""
    spark = tokens.sparkSession
    parts = buckets_for(tokens)
    cuts = id_cuts(tokens.select("doc_id"), "doc_id", parts)
    placed = tokens.withColumn("bucket", bucket_of(F.col("doc_id"), cuts, parts))
    totals = sorted((r.bucket, r.n) for r in placed.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    before, starts = 0, {}
    for bucket, n in totals:
        starts[bucket], before = before, before + n
    book = spark.sparkContext.broadcast((lengths, huffman.canonical(lengths)))

    def code(batches):
        size, codes = book.value
        for batch in batches:
            for rows, data, offsets in blocks(batch, "ids"):
                first = offsets // np.dtype(kind).itemsize
                payload, at_byte, at_bit = huffman.encode(data.view(kind), first, size, codes)
                n = np.diff(first)
                marked = (n + huffman.STRIDE - 1) // huffman.STRIDE
                pick = np.repeat(first[:-1], marked) + huffman.STRIDE * (np.arange(marked.sum()) - np.repeat(np.concatenate([[0], np.cumsum(marked)[:-1]]), marked))
                marks = (at_bit[pick] - np.repeat(8 * at_byte[:-1], marked)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(2), _binaries(payload, at_byte), _binaries(marks.view(np.uint8), 4 * np.concatenate([[0], np.cumsum(marked)]))],
                    ["bucket", "doc_id", "n", "bits", "marks"],
                )

    coded = placed.select("bucket", "doc_id", "n", "ids").mapInArrow(code, "bucket int, doc_id long, n long, bits binary, marks binary")
    dealt = coded.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "n", F.crc32("bits"))

    def assemble(batches):
        bucket, block, start, held, tokens_held = None, 0, 0, [], 0

        def close():
            at, marks, parts = 0, [], []
            for _, _, bits, own in held:
                marks.append(np.frombuffer(own, "<u4").astype("<u8") + 8 * at)
                parts.append(bits)
                at += len(bits)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                    pa.array([[d for d, *_ in held]], pa.list_(pa.int64())), pa.array([[n for _, n, *_ in held]], pa.list_(pa.int64())),
                    pa.array([b"".join(parts)], pa.binary()), pa.array([np.concatenate(marks).tobytes()], pa.binary()),
                ],
                ["bucket", "block", "start", "doc_ids", "n_tokens", "payload", "marks"],
            )

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and (row[0] != bucket or tokens_held >= BLOCK_TOKENS):
                    yield close()
                    block, start, held, tokens_held = block + 1, start + tokens_held, [], 0
                if row[0] != bucket:
                    bucket, block, start = row[0], 0, starts[row[0]]
                held.append(row[1:])
                tokens_held += row[2]
        if held:
            yield close()

    return dealt.mapInArrow(assemble, "bucket int, block int, start long, doc_ids array<long>, n_tokens array<long>, payload binary, marks binary")


def read_blocks(files: DataFrame, lengths: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids (unsigned 32-bit little-endian) of every document in the block table."""
    book = files.sparkSession.sparkContext.broadcast(lengths)

    def run(batches):
        table = huffman.decode_table(book.value)
        for batch in batches:
            for _, start, docs, n, payload, marks in zip(*(batch.column(i).to_pylist() for i in range(1, 7))):
                n = np.array(n, np.int64)
                marked = (n + huffman.STRIDE - 1) // huffman.STRIDE
                order = np.arange(marked.sum()) - np.repeat(np.cumsum(marked) - marked, marked)
                count = np.minimum(np.repeat(n, marked) - order * huffman.STRIDE, huffman.STRIDE)
                ids = huffman.decode(np.frombuffer(payload, np.uint8), np.frombuffer(marks, "<u8").astype(np.int64), count, table)
                cuts = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start + cuts[:-1]), pa.array(n), _binaries(ids.astype("<u4").view(np.uint8), 4 * cuts)],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return files.select("bucket", "block", "start", "doc_ids", "n_tokens", "payload", "marks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Encodes whole texts and writes them: (block table, codebook), both in the shared folder.

    Documents stand in ascending id order (null ids first; rows that repeat an
    id by length, then code). Null texts are empty and have the end id alone.
    An empty table gives an empty file. Columns beyond the two are not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    vocabulary = tokenizer_for(path).vocabulary
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    tokens = stored(tokenize(rows, path), "token-ids", compression="zstd")
    lengths = huffman.code_lengths(id_counts(tokens, vocabulary, kind))
    files = stored(write_blocks(tokens, lengths, kind), "token-blocks", compression="none")
    used = np.flatnonzero(lengths)
    book = docs.sparkSession.createDataFrame(pa.table([pa.array(used), pa.array(lengths[used])], names=["id", "length"]))
    return files, stored(book, "token-codebook")


def read_tokens(files: DataFrame, book: DataFrame) -> DataFrame:
    table = book.toArrow()
    lengths = np.zeros(int(max(table["id"].to_pylist(), default=0)) + 1, np.int64)
    lengths[table["id"].to_numpy()] = table["length"].to_numpy()
    return read_blocks(files, lengths)


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the written files."""
    back = read_tokens(*write_tokens(docs, path))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
