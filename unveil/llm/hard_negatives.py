"""Hard-negative mining over rotated one-bit codes with exact residual intervals.

Every vector o is rotated and keeps the signs x (a unit vector), its alignment
a = <o, x> and its residual length r = sqrt(|o|^2 - a^2). An anchor q is rotated too and
rounded to PLANES bits a component, so that <x, q> comes from
popcounts of the code and each bit plane; the rounding error e has a known
length. As o - a x is orthogonal to x, Cauchy-Schwarz gives

    |<o, q> - a <x, q>| <= r sqrt(|q|^2 - <x, q>^2)

whatever the vectors are, so the interval around the estimate holds the true inner
product without fail. Candidates whose interval cannot matter are left out,
all others are scored in integers: the result is exact.

Vectors stay where they are. Anchors are a stated query set and come in
blocks of at most about ANCHOR_BLOCK, broadcast one after the other; a task
returns a few rows for each anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unveil.llm.shared import stored
from unveil.llm.vectors import rotation
from unveil.session import work_path

PLANES = 6
ANCHOR_BLOCK = 16_384
ROWS, ANCHORS = 2048, 128  # a cell of the estimates
WITHIN = 80  # percent of the positive's score
MOST = float(1 << 62)  # squared length from which inner products may leave the long range
INDEX = "vec_id long, label long, vec binary, code binary, align double, residual double"


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * 256.0))


def usable(vector: Column) -> Column:
    """True for vectors of finite, non-null components whose inner products are longs."""
    doubles = vector.cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    length = F.aggregate(doubles, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * 256.0).cast("double"), 2))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & (length < MOST)


def codes_of(m: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs in 64-bit words, alignment and residual length of each row."""
    turned = m @ turn
    d = m.shape[1]
    room = np.zeros((len(m), -(-d // 64) * 64), np.uint8)
    room[:, :d] = turned > 0
    align = np.abs(turned).sum(axis=1) / np.sqrt(d)
    residual = np.sqrt(np.maximum((m**2).sum(axis=1) - align**2, 0))
    return np.packbits(room, axis=1).view(np.uint64), align, residual


def build_index(rows: DataFrame, d: int) -> DataFrame:
    """INDEX for rows (vec_id, label, vec array<long>)."""
    turn = rotation(d)

    def run(batches):
        for batch in batches:
            vec = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            codes, align, residual = codes_of(vec.astype(np.float64), turn)
            raw = [x.tobytes() for x in vec.astype("<i8")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(align), pa.array(residual)],
                ["vec_id", "label", "vec", "code", "align", "residual"],
            )

    return rows.mapInArrow(run, INDEX)


@dataclass
class Rows:
    """A run of the index in arrays."""

    ids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray
    codes: np.ndarray
    align: np.ndarray
    residual: np.ndarray

    @staticmethod
    def of(batch, d: int) -> Rows:
        n = batch.num_rows
        raw = [np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(n, -1) for k, kind in ((2, "<i8"), (3, np.uint64))]
        return Rows(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)), raw[0], raw[1], *(batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5)))

    def take(self, at) -> Rows:
        return Rows(*(getattr(self, k)[at] for k in ("ids", "labels", "vecs", "codes", "align", "residual")))


class Anchors:
    """A block of anchors with their bit planes."""

    def __init__(self, rows: Rows, d: int):
        self.ids, self.labels, self.vecs, self.d = rows.ids, rows.labels, rows.vecs, d
        turned = rows.vecs.astype(np.float64) @ rotation(d)
        self.low = turned.min(axis=1, initial=0)
        self.step = np.maximum((turned.max(axis=1, initial=0) - self.low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.error = np.sqrt(((turned - (self.low[:, None] + level * self.step[:, None])) ** 2).sum(axis=1))
        self.norm = np.sqrt((turned**2).sum(axis=1))
        self.total = level.sum(axis=1)
        room = np.zeros((PLANES, len(level), -(-d // 64) * 64), np.uint8)
        for k in range(PLANES):
            room[k, :, :d] = level >> k & 1
        self.planes = np.packbits(room, axis=2).view(np.uint64)

    def interval(self, some: slice, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of the anchors ``some`` with all ``rows``."""
        plus = np.zeros((len(self.ids[some]), len(rows.ids)), np.int64)  # levels where the code has a one
        for k in range(PLANES):
            for w in range(rows.codes.shape[1]):
                plus += np.bitwise_count(self.planes[k, some, w][:, None] & rows.codes[None, :, w]).astype(np.int64) << k
        ones = np.bitwise_count(rows.codes).sum(axis=1, dtype=np.int64)
        signed = self.low[some, None] * (2 * ones - self.d) + self.step[some, None] * (2 * plus - self.total[some, None])
        x_q = signed / np.sqrt(self.d)
        error, norm = self.error[some, None], self.norm[some, None]
        across = np.sqrt(np.maximum(norm**2 - np.maximum(np.abs(x_q) - error, 0) ** 2, 0))
        size = np.sqrt(rows.align**2 + rows.residual**2) * norm
        slack = rows.align * error + rows.residual * across + 1e-9 * size + 1e-9  # the last two: rounding of doubles
        middle = rows.align * x_q
        return middle - slack, middle + slack


def _kept(anchor: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each anchor: highest score, then smallest id."""
    order = np.lexsort((ids, -score, anchor))
    a = anchor[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return order[rank < k]


class Best:
    """The k best candidates of each key so far."""

    def __init__(self, keys: int, k: int):
        self.k, self.keys = k, keys
        self.key = self.ids = self.score = np.zeros(0, np.int64)

    def add(self, key, ids, score) -> None:
        key, ids, score = np.concatenate([self.key, key]), np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        keep = _kept(key, ids, score, self.k)
        self.key, self.ids, self.score = key[keep], ids[keep], score[keep]

    def floor(self) -> np.ndarray:
        """The score that a candidate of each key must reach (minus infinity while there are fewer than k)."""
        out = np.full(self.keys, -np.inf)
        n = np.bincount(self.key, minlength=self.keys)
        full = n[self.key] == self.k
        np.minimum.at(low := np.full(self.keys, np.inf), self.key[full], self.score[full].astype(np.float64))
        return np.where(np.isfinite(low), low, out)


def _cells(n_anchors: int, n_rows: int):
    for lo in range(0, n_rows, ROWS):
        for a in range(0, n_anchors, ANCHORS):
            yield slice(a, min(a + ANCHORS, n_anchors)), slice(lo, lo + ROWS)


def positives_in(anchors: Anchors, rows: Rows, best: Best, k: int) -> None:
    """Adds the rows of the anchors' own labels that may be among their k nearest."""
    for label in np.unique(anchors.labels):
        mine, own = np.flatnonzero(anchors.labels == label), rows.take(rows.labels == label)
        sub = Anchors.__new__(Anchors)
        sub.d = anchors.d
        for name in ("ids", "labels", "vecs", "low", "step", "error", "norm", "total"):
            setattr(sub, name, getattr(anchors, name)[mine])
        sub.planes = anchors.planes[:, mine]
        for some, part in _cells(len(mine), len(own.ids)):
            cell = own.take(part)
            low, high = sub.interval(some, cell)
            itself = sub.ids[some, None] == cell.ids
            low[itself] = high[itself] = -np.inf
            need = best.floor()[mine[some]]
            if low.shape[1] > k:
                need = np.maximum(need, np.partition(low, -k, axis=1)[:, -k])
            a, r = np.nonzero((high >= need[:, None]) & (high > -np.inf))
            score = np.einsum("ij,ij->i", sub.vecs[some][a], cell.vecs[r])
            best.add(mine[some][a], cell.ids[r], score)


def negatives_in(anchors: Anchors, owner: np.ndarray, target: np.ndarray, rows: Rows, best: Best, within: int) -> None:
    """Adds for each (anchor, positive) the rows of other labels that score in its window.

    ``owner`` and ``target`` are the anchor and the score of each positive.
    """
    n = len(anchors.ids)
    for some, part in _cells(n, len(rows.ids)):
        cell = rows.take(part)
        low, high = anchors.interval(some, cell)
        need = np.maximum(-((-within * target) // 100), best.floor())  # the window's lower end, or the k-th best so far
        least, most = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(least, owner, need)
        np.maximum.at(most, owner, target)
        a, r = np.nonzero((high >= least[some, None]) & (low <= most[some, None]) & (anchors.labels[some, None] != cell.labels))
        score = np.einsum("ij,ij->i", anchors.vecs[some][a], cell.vecs[r])
        a += some.start
        begin, end = np.searchsorted(owner, a, side="left"), np.searchsorted(owner, a, side="right")
        each = np.arange((end - begin).sum()) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)
        which = np.repeat(np.arange(len(a)), end - begin)
        fits = (within * target[each] <= 100 * score[which]) & (score[which] <= target[each])
        best.add(each[fits], cell.ids[r[which[fits]]], score[which[fits]])


def once_each(good: DataFrame) -> DataFrame:
    """Of rows that repeat a vec_id the one with the least label, then the least vector."""
    again = stored(good.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-vectors")
    if not again.head(1):
        return good
    rows = good.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("one"))
    return rows.select("vec_id", "one.label", "one.vec")


def mine(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, within: int = WITHIN, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of the vectors with components floor(256 * x).
    An anchor's positives are the ``n_positives`` other rows of its label that score
    highest; the negatives of a positive are the ``n_negatives`` rows of
    other labels that score highest among those with
    within * positive_score <= 100 * negative_score <= 100 * positive_score. Ties
    go to the smaller vec_id. ``is_anchor`` is a condition on ``vec_id``.

    Null ids, labels and vectors, empty vectors, those with a null or non-finite component, those so
    long that inner products leave the long range (squared length of 2**62 or more) and those of another
    length than the most common take no part. Zero vectors score 0. Of rows that repeat an id one takes
    part: the one with the least label, then the least vector. An anchor without a positive,
    and a positive without a negative, give no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    own = F.col(label) if isinstance(label, str) else label
    given = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), own.cast("bigint").alias("label"), F.col(vector).alias("vec"))
    given = given.where("vec_id is not null and label is not null").where(usable(F.col("vec")))
    lengths = given.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths.d if lengths else 1
    good = once_each(given.where(F.size("vec") == d).select("vec_id", "label", integers(F.col("vec")).alias("vec")))
    index = stored(build_index(good, d), "negative-codes", compression="none")
    anchors = index.where(is_anchor)
    parts = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    path = work_path(spark, "hard-negatives")
    for k in range(parts):
        block = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k)
        _mine_block(index, block, d, n_positives, n_negatives, within).write.mode("append").parquet(path)
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(path)


def _mine_block(index: DataFrame, block: DataFrame, d: int, n_positives: int, n_negatives: int, within: int) -> DataFrame:
    context = index.sparkSession.sparkContext
    table = block.orderBy("vec_id").toArrow().combine_chunks()
    held = context.broadcast(Anchors(Rows.of(table.to_batches()[0], d), d) if table.num_rows else None)

    def nearest(batches):
        anchors = held.value
        best = Best(len(anchors.ids), n_positives) if anchors else Best(0, n_positives)
        for batch in batches:
            if anchors and batch.num_rows:
                positives_in(anchors, Rows.of(batch, d), best, n_positives)
        ids = anchors.ids[best.key] if anchors else best.key
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best.ids), pa.array(best.score)], ["anchor_id", "positive_id", "positive_score"])

    near = index.mapInArrow(nearest, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = stored(near.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n_positives).drop("__n"), "positives")
    found = near.orderBy("anchor_id", "positive_id").toArrow()  # n_positives rows for each anchor of the block
    targets = context.broadcast(tuple(found[c].to_numpy() for c in ("anchor_id", "positive_id", "positive_score")))

    def negatives(batches):
        anchors, (anchor_id, positive_id, target) = held.value, targets.value
        owner = np.searchsorted(anchors.ids, anchor_id) if anchors else anchor_id
        best = Best(len(owner), n_negatives)
        for batch in batches:
            if len(owner) and batch.num_rows:
                negatives_in(anchors, owner, target, Rows.of(batch, d), best, within)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor_id[best.key]), pa.array(positive_id[best.key]), pa.array(best.ids), pa.array(target[best.key]), pa.array(best.score)],
            ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
        )

    some = index.mapInArrow(negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
