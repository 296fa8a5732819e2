"""Language-model scoring by context-tree weighting over bytes.

A text is read as its lower-cased words, one blank between them, and an end
mark. Each byte is decomposed into eight binary decisions; each of the 255
decision nodes has its own context tree over the preceding ``DEPTH`` bytes. A
tree node holds the counts of its decisions, a Krichevsky-Trofimov estimate,
and the weighted probability

    Pw(s) = 1/2 KT(s) + 1/2 * product of Pw over the seen longer contexts,

from which the share of the mixture that stops at s follows. The probability
of a decision mixes the estimates of all depths along its context with these
shares; a context that training never met passes its share to the longest one
it did meet. Counts, trees and scores are distributed: the n-gram counts of
the corpus are grouped by their last two context bytes, each group finishes
its part of every tree, and the two top levels, 256 * 255 nodes at most, close
on the driver.

Scores are looked up rather than walked: every n-gram of the corpus gets its
log probability once. The most frequent ones go to the tasks in a hash table
of fixed size, the rest meet the texts in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unveil.llm.shared import stored, text_of
from unveil.llm.textblocks import LOWER, blocks, mix, per_row, span_hashes, word_spans

DEPTH = 5
END_BYTE = 10
END_WORD = 0x7E57AB1E0E4D  # stands for the end token among the word hashes
HEAD_GRAMS = 1 << 20
HEAD_WORDS = 1 << 19
GRAM, WORD = 0, 1
SMOOTH = 0.1


def byte_stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that are scored, with DEPTH end marks before each row; which of them count; where each row starts."""
    words = np.diff(first)
    size = ends - starts + 1
    row_size = np.add.reduceat(np.append(size, 0), np.minimum(first[:-1], len(size))) if len(size) else np.zeros(len(words), np.int64)
    row_size = np.where(words > 0, row_size, 1) + DEPTH
    row_at = np.concatenate([[0], np.cumsum(row_size)])
    out = np.full(int(row_at[-1]), END_BYTE, np.uint8)
    if len(size):
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(words)), words)
        place = row_at[row] + DEPTH + begin - begin[first[:-1][row]]
        source = np.arange(int(size.sum())) + np.repeat(starts - begin, size)
        target = np.arange(int(size.sum())) + np.repeat(place - begin, size)
        out[target] = LOWER[data[np.minimum(source, len(data) - 1)]]
        out[place + size - 1] = 32
        out[row_at[1:] - 1] = END_BYTE
    counted = np.ones(len(out), bool)
    counted[(row_at[:-1, None] + np.arange(DEPTH)).ravel()] = False
    return out, counted, row_at


def gram_keys(stream: np.ndarray) -> np.ndarray:
    """For each byte: the bytes before it, nearest first, then the byte, packed into one number."""
    wide = np.concatenate([np.full(DEPTH, END_BYTE, np.uint8), stream]).astype(np.int64)
    key = np.zeros(len(stream), np.int64)
    for back in range(1, DEPTH + 1):
        key = (key << 8) | wide[DEPTH - back : len(wide) - back]
    return (key << 8) | wide[DEPTH:]


def items(data: np.ndarray, offsets: np.ndarray):
    """n-gram keys and word keys of a block, with the first of each row (the end token is each row's last word)."""
    starts, ends, first = word_spans(data, offsets)
    stream, counted, row_at = byte_stream(data, starts, ends, first)
    grams = gram_keys(stream)[counted]
    gram_first = row_at - DEPTH * np.arange(len(row_at))
    words = np.insert(span_hashes(data, starts, ends).view(np.int64), first[1:], END_WORD)
    return grams, gram_first, words, first + np.arange(len(first))


def corpus_counts(rows: DataFrame) -> DataFrame:
    """kind, key, train, total: how often each n-gram and word stands in training texts and in all. Rows: text, is_train."""

    def run(batches):
        held: dict[int, list] = {GRAM: [], WORD: []}
        kept = {GRAM: 0, WORD: 0}

        def merged(kind):
            parts = held[kind]
            keys = np.concatenate([p[0] for p in parts])
            unique, inverse = np.unique(keys, return_inverse=True)
            sums = [np.bincount(inverse, np.concatenate([p[i] for p in parts]), len(unique)).astype(np.int64) for i in (1, 2)]
            held[kind], kept[kind] = [(unique, *sums)], len(unique)

        for batch in batches:
            for block, data, offsets in blocks(batch, "text"):
                train = np.array(block.column(1).to_pylist(), bool)
                grams, gram_first, words, word_first = items(data, offsets)
                for kind, keys, first in ((GRAM, grams, gram_first), (WORD, words, word_first)):
                    of_row = np.repeat(train, np.diff(first))
                    for flag in (True, False):
                        unique, n = np.unique(keys[of_row == flag], return_counts=True)
                        held[kind].append((unique, n if flag else np.zeros_like(n), n))
                    if sum(len(p[0]) for p in held[kind]) > 2 * kept[kind] + 500_000:
                        merged(kind)
        for kind in (GRAM, WORD):
            if held[kind]:
                merged(kind)
                keys, train, total = held[kind][0]
                for lo in range(0, len(keys), 100_000):
                    part = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys[part]), pa.int32()), pa.array(keys[part]), pa.array(train[part]), pa.array(total[part])], ["kind", "key", "train", "total"])

    found = rows.select("text", "is_train").mapInArrow(run, "kind int, key long, train long, total long")
    return found.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - np.log(np.pi) - _lgamma(zeros + ones + 1.0)


@dataclass
class Level:
    """Nodes of one depth: which node each (row, bit) meets, one-probability, share that stops here, log Pw."""

    node: np.ndarray
    one: np.ndarray
    stop: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    example: np.ndarray


def _nodes(context: np.ndarray, byte: np.ndarray, count: np.ndarray) -> tuple:
    """Numbers of the (context, decision node) that each row and bit meets, with their counts."""
    bit = np.arange(8)
    decision = (1 << bit) | (byte[:, None] >> (8 - bit))
    value = (byte[:, None] >> (7 - bit)) & 1
    unique, example, inverse = np.unique((context[:, None] << 8) | decision, return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    weight = np.repeat(count.astype(np.float64), 8)
    ones = np.bincount(inverse, weight * value.ravel(), len(unique))
    zeros = np.bincount(inverse, weight * (1 - value.ravel()), len(unique))
    return unique, example, inverse, zeros, ones


def levels(keys: np.ndarray, count: np.ndarray, top: int = 2) -> list[Level]:
    """Tree levels ``top`` to DEPTH over the n-grams of one group, bottom up."""
    byte = keys & 255
    out: list[Level] = []
    for depth in range(DEPTH, top - 1, -1):
        unique, example, inverse, zeros, ones = _nodes(keys >> (8 * (DEPTH + 1 - depth)), byte, count)
        own = kt_log(zeros, ones)
        if depth == DEPTH:
            weighted, stop = own, np.ones(len(unique))
        else:
            below = out[-1]
            parent = inverse[below.example]
            longer = np.bincount(parent, np.where(below.zeros + below.ones > 0, below.weighted, 0.0), len(unique))
            weighted = np.logaddexp(own, longer) + np.log(0.5)
            stop = np.exp(own + np.log(0.5) - weighted)
        out.append(Level(inverse, (ones + 0.5) / (zeros + ones + 1), stop, zeros, ones, weighted, example))
    return out


def log10_probabilities(keys: np.ndarray, count: np.ndarray, upper: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 P(byte | context) of every n-gram of a group.

    ``upper`` has (one-probability, stop share, seen) per (row, bit) for the
    depths above the group, shallowest first.
    """
    bit = np.arange(8)
    value = (((keys & 255)[:, None] >> (7 - bit)) & 1).ravel()
    q, open_ = np.full(len(value), 0.5), np.zeros(len(value), bool)

    def fold(one, stop, seen):
        nonlocal q, open_
        q = np.where(seen, np.where(open_, stop * one + (1 - stop) * q, one), q)
        open_ |= seen

    for level in levels(keys, count):
        seen = (level.zeros + level.ones > 0)[level.node]
        fold(level.one[level.node], level.stop[level.node], seen)
    for one, stop, seen in reversed(upper):
        fold(one, stop, seen)
    return np.log10(np.where(value == 1, q, 1 - q)).reshape(-1, 8).sum(axis=1)


def gram_scores(counts: DataFrame) -> DataFrame:
    """key, value (log10 probability) of every n-gram in ``counts`` (key, train, total)."""
    group = F.shiftright("key", 8 * (DEPTH - 1)).cast("int")
    grouped = counts.withColumn("ctx", group)

    def summary(table: pa.Table) -> pa.Table:
        keys, count = table["key"].to_numpy(), table["train"].to_numpy()
        level = levels(keys, count)[-1]
        decision = ((1 << (level.example % 8)) | ((keys & 255)[level.example // 8] >> (8 - level.example % 8))).astype(np.int32)
        seen = level.zeros + level.ones > 0
        last = np.full(int(seen.sum()), int(table["ctx"][0].as_py()) >> 8, np.int32)
        return pa.table([pa.array(last), pa.array(decision[seen]), *(pa.array(x[seen]) for x in (level.zeros, level.ones, level.weighted))], names=["last", "decision", "zeros", "ones", "weighted"])

    tops = (
        grouped.groupBy("ctx").applyInArrow(summary, "last int, decision int, zeros double, ones double, weighted double")
        .groupBy("last", "decision").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted"))
        .toArrow()
    )
    last, decision, zeros, ones, longer = (tops[c].to_numpy() for c in ("last", "decision", "zeros", "ones", "weighted"))

    def close(zeros, ones, longer):
        own = kt_log(zeros, ones)
        weighted = np.logaddexp(own, longer) + np.log(0.5)
        return (ones + 0.5) / (zeros + ones + 1), np.exp(own + np.log(0.5) - weighted), weighted

    one1, stop1, seen1 = np.full((256, 256), 0.5), np.zeros((256, 256)), np.zeros((256, 256), bool)
    one, stop, weighted = close(zeros, ones, longer)
    one1[last, decision], stop1[last, decision], seen1[last, decision] = one, stop, True
    sums = [np.bincount(decision, x, 256) for x in (zeros, ones, weighted)]
    one0, stop0, _ = close(*sums)
    seen0 = sums[0] + sums[1] > 0
    shared = counts.sparkSession.sparkContext.broadcast(((one0, stop0, seen0), (one1, stop1, seen1)))

    def score(table: pa.Table) -> pa.Table:
        keys, count = table["key"].to_numpy(), table["train"].to_numpy()
        root, first = shared.value
        bit = np.arange(8)
        node = ((1 << bit) | ((keys & 255)[:, None] >> (8 - bit))).ravel()
        near = np.repeat((keys >> (8 * DEPTH)) & 255, 8)
        upper = [tuple(x[node] for x in root), tuple(x[near, node] for x in first)]
        return pa.table([table["key"], pa.array(log10_probabilities(keys, count, upper)), table["total"]], names=["key", "value", "total"])

    return grouped.groupBy("ctx").applyInArrow(score, "key long, value double, total long")


class HashTable:
    """Open addressing over 64-bit keys, half full at most; values are rows of doubles."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(2 * len(keys), 1)))))
        self.keys = np.zeros(1 << self.bits, np.int64)
        self.values = np.full(1 << self.bits, np.nan)
        place, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = place[left]
            free = np.isnan(self.values[at])
            winner = np.full(1 << self.bits, -1, np.int64) if len(left) > 1 << (self.bits - 4) else None
            if winner is not None:
                winner[at[free]] = left[free]
                placed = free & (winner[at] == left)
            else:
                _, one = np.unique(at, return_index=True)
                placed = np.zeros(len(left), bool)
                placed[one] = free[one]
            self.keys[at[placed]], self.values[at[placed]] = keys[left[placed]], values[left[placed]]
            left = left[~placed]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; NaN where there is none."""
        at = self._slot(keys)
        found = self.values[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & ~np.isnan(found))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.values[at[open_]]
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & ~np.isnan(found[open_])]
        return found


def head(values: DataFrame, kind: int, most: int) -> HashTable:
    """The most frequent entries of ``values`` (kind, key, value, total), ``most`` of them at most."""
    level = F.floor(F.log2("total") * 16).cast("int")
    sizes = values.where(f"kind = {kind}").groupBy(level.alias("level")).count().collect()
    cut, n = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if n + r["count"] > most:
            break
        cut, n = r["level"], n + r["count"]
    if cut is None:
        return HashTable(np.zeros(0, np.int64), np.zeros(0))
    table = values.where((F.col("kind") == kind) & (level >= cut)).select("key", "value").toArrow()
    return HashTable(table["key"].to_numpy(), table["value"].to_numpy())


def score_texts(docs: DataFrame, is_train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, is_train, n_tokens, n_known, train_tokens, base_score, score for every row.

    score is the model's log10 probability of the text as lower-cased words
    with one blank between them and an end mark; base_score is that of a
    smoothed unigram model over the same words and the end token. Null and
    empty texts are the end alone. Rows that repeat a doc_id are scored each.
    Without training texts every decision has probability 1/2, and a token
    of the base has 1 / (V + 1) with V = 0.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(is_train, F.lit(False)).alias("is_train"), text_of(text).alias("text"))
    counts = stored(corpus_counts(rows), "corpus-counts")
    words = counts.where(f"kind = {WORD}")
    n_train, v = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.coalesce(F.sum((F.col("train") > 0).cast("long")), F.lit(0))).first()
    word_value = F.log10((F.col("train") + F.lit(SMOOTH)) / F.lit(n_train + SMOOTH * (v + 1)))
    # a word that training never met is told apart by an offset no score reaches
    known = F.when(F.col("train") > 0, word_value).otherwise(word_value - F.lit(1000.0))
    values = stored(
        gram_scores(counts.where(f"kind = {GRAM}").select("key", "train", "total")).select(F.lit(GRAM).alias("kind"), "key", "value", "total")
        .unionByName(words.select(F.lit(WORD).alias("kind"), "key", known.alias("value"), "total")),
        "token-values",
    )
    shared = docs.sparkSession.sparkContext.broadcast((head(values, GRAM, HEAD_GRAMS), head(values, WORD, HEAD_WORDS)))

    def run(batches):
        gram_table, word_table = shared.value
        for batch in batches:
            for block, data, offsets in blocks(batch, "text"):
                grams, gram_first, word_keys, word_first = items(data, offsets)
                g, w = gram_table.get(grams), word_table.get(word_keys)
                new = w < -500
                rare_g, rare_w = np.isnan(g), np.isnan(w)
                lists = []
                for rare, keys, first in ((rare_g, grams, gram_first), (rare_w, word_keys, word_first)):
                    at = np.flatnonzero(rare)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first), pa.int32()), pa.array(keys[at])))
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column(0), block.column(1), pa.array(np.diff(word_first)),
                        pa.array(per_row(~new & ~rare_w, word_first).astype(np.int64)),
                        pa.array(per_row(np.where(rare_w, 0, w + 1000.0 * new), word_first)), pa.array(per_row(np.where(rare_g, 0, g), gram_first)), *lists,
                    ],
                    ["doc_id", "is_train", "n_tokens", "known", "base", "model", "grams", "words"],
                )

    first = rows.mapInArrow(run, "doc_id long, is_train boolean, n_tokens long, known long, base double, model double, grams array<long>, words array<long>")
    scored = stored(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.lit(GRAM).alias("kind"), F.explode("grams").alias("key")).unionByName(scored.select("row", F.lit(WORD).alias("kind"), F.explode("words").alias("key")))
    met = rare.join(values, ["kind", "key"])
    is_new = F.col("value") < -500
    rest = met.groupBy("row").agg(
        F.sum(F.when(F.col("kind") == WORD, (~is_new).cast("long")).otherwise(0)).alias("more_known"),
        F.sum(F.when(F.col("kind") == WORD, F.when(is_new, F.col("value") + 1000.0).otherwise(F.col("value"))).otherwise(0.0)).alias("more_base"),
        F.sum(F.when(F.col("kind") == GRAM, F.col("value")).otherwise(0.0)).alias("more_model"),
    )
    whole = scored.drop("grams", "words").join(rest, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select(
        "doc_id", "is_train", "n_tokens", plus("known", "more_known").alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("model", "more_model").alias("score"),
    )
