"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are centred on the corpus mean, scaled to unit length and rotated; a
code keeps the signs. With x the unit vector of a code's signs and o the
rotated unit vector, <o, q> is estimated by <x, q> / <x, o>, and the error is
at most EPS / sqrt(d - 1) * sqrt(1 - <x, o>**2) / <x, o> * |q| but for a small
probability. In a cell of queries and codes the best estimates are computed
exactly first; every other vector is reranked only if its upper bound reaches
the k-th best exact value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unveil.llm.shared import stored

EPS = 3.0
QUERY_BLOCK = 1024
CODE_BLOCK = 32_768


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vector: Column, d: int) -> Column:
    """True for vectors of d finite, non-null components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == d) & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def mean_vector(rows: DataFrame, d: int) -> np.ndarray:
    """Component means over all rows (vec_id, vec); d sums per task meet in a small aggregate."""

    def run(batches):
        total, n = np.zeros(d), 0
        for batch in batches:
            m = _matrix(batch.column(0), d)
            total, n = total + m.sum(axis=0), n + len(m)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total), pa.array([n] * d, pa.int64())], ["at", "s", "n"])

    sums = rows.select("vec").mapInArrow(run, "at int, s double, n long").groupBy("at").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1))).alias("m")).collect()
    return np.array([m for _, m in sorted((r.at, r.m) for r in sums)] or [0.0] * d)


def encode(rows: DataFrame, d: int, mean: np.ndarray, turn: np.ndarray) -> DataFrame:
    """The index, a row for each vector: vec_id, vec, code (packed signs), norm, align (<x, o>)."""

    def run(batches):
        for batch in batches:
            m = (_matrix(batch.column(1), d) - mean) @ turn
            norm = np.linalg.norm(m, axis=1)
            signs = m > 0
            align = np.abs(m).sum(axis=1) / np.sqrt(d) / np.where(norm > 0, norm, 1)
            codes = [c.tobytes() for c in np.packbits(signs, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.binary()), pa.array(norm), pa.array(np.where(norm > 0, align, 1.0))],
                ["vec_id", "vec", "code", "norm", "align"],
            )

    return rows.mapInArrow(run, "vec_id long, vec array<double>, code binary, norm double, align double")


def exact(candidates: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last."""
    return np.cumsum(candidates * query, axis=1)[:, -1]


def search_cell(q_ids, q, ids, vecs, codes, norm, align, mean, turn, k: int):
    """Per query the k best of the cell, its own id left out: (query index, candidate index, score)."""
    d = q.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.sqrt(d)
    turned = (q @ turn).astype(np.float32)
    base = q @ mean
    slack = EPS / np.sqrt(max(d - 1, 1)) * np.sqrt(np.maximum(1 - align**2, 0)) / align * norm
    scale = (norm / align).astype(np.float32)
    out = []
    for lo in range(0, len(q), 64):
        guess = (turned[lo : lo + 64] @ signs.T) * scale
        for i in range(lo, min(lo + 64, len(q))):
            estimate = guess[i - lo] + base[i]
            estimate[ids == q_ids[i]] = -np.inf
            open_ = np.flatnonzero(estimate > -np.inf)
            if not len(open_):
                continue
            first = open_[np.argpartition(-estimate[open_], min(4 * k, len(open_)) - 1)[: 4 * k]]
            scores = exact(vecs[first], q[i])
            if len(open_) > 4 * k:
                floor = np.partition(scores, len(scores) - k)[len(scores) - k]
                rest = np.ones(len(ids), bool)
                rest[first] = False
                rest &= (estimate + slack * np.linalg.norm(q[i]) >= floor) & (estimate > -np.inf)
                more = np.flatnonzero(rest)
                first = np.concatenate([first, more])
                scores = np.concatenate([scores, exact(vecs[more], q[i])])
            best = np.lexsort((ids[first], -scores))[:k]
            out.append((np.full(len(best), i), first[best], scores[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]


def nearest(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query by inner product.

    Vectors that are null, all zero, of a length other than the most common
    one, or that hold a null or non-finite component take no part, nor do null
    ids. Rows that repeat a vec_id count once, with their best score. Ties go
    to the smaller id. Other columns are not read.

    Queries and codes are dealt into blocks of bounded size, and every block
    of queries meets every block of codes in one cell; a cell returns k rows
    a query.
    """
    given = rows.where(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"), is_query.alias("is_query")
    )
    lengths = given.where("vec is not null and size(vec) > 0").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths.d if lengths else 1
    good = given.where(usable(F.col("vec"), d))
    mean, turn = mean_vector(good, d), rotation(d)
    index = stored(encode(good.select("vec_id", "vec"), d, mean, turn), "codes")
    n = index.count()
    queries = good.where("is_query").select("vec_id", "vec")
    q_blocks, c_blocks = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-n // CODE_BLOCK))

    def dealt(df, own: str, own_blocks: int, other: str, other_blocks: int):
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))

    left = dealt(queries, "qb", q_blocks, "cb", c_blocks)
    right = dealt(index, "cb", c_blocks, "qb", q_blocks)

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        codes = np.frombuffer(b"".join(c["code"].to_pylist()), np.uint8).reshape(c.num_rows, -1)
        q_ids, ids = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
        a, b, s = search_cell(q_ids, _matrix(q["vec"], d), ids, _matrix(c["vec"], d), codes, c["norm"].to_numpy(), c["align"].to_numpy(), mean, turn, k)
        return pa.table([pa.array(q_ids[a]), pa.array(ids[b]), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(cell, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
