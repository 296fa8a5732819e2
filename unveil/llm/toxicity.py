"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all training text, whatever its
label, is the unlabelled set. Hashed word and word-prefix features are counted
over every training document; the features that separate positives from the
rest best are kept, and a logistic classifier is trained in numpy on the
class-prior-corrected risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

When the second term turns negative, its gradient is climbed instead, which
keeps the classifier from memorising the positives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unveil.llm.shared import stored, text_of
from unveil.llm.textblocks import blocks, prefix_hashes, word_spans

BITS = 20
PREFIXES = (0, 4, 5, 6)
POSITIVES = 20_000
UNLABELLED = 40_000
FEATURES = 4_000


@dataclass(frozen=True)
class Model:
    """slots: sorted feature slots; weights: one each, then length and bias; prior: the class prior used."""

    slots: np.ndarray
    weights: np.ndarray
    prior: float


def doc_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row << BITS | slot) of each row's distinct features in order, their counts, and the words of each row."""
    starts, ends, first = word_spans(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(first))
    slots = (prefix_hashes(data, starts, ends, PREFIXES) >> np.uint64(64 - BITS)).astype(np.int64)
    keys, n = np.unique(((row << BITS) | slots).ravel(), return_counts=True)
    return keys, n, np.diff(first)


def feature_counts(docs: DataFrame) -> DataFrame:
    """slot, in_positive, in_all: documents that hold each feature. Rows: positive (true or null), text."""

    def run(batches):
        both = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                keys, _, _ = doc_slots(data, offsets)
                toxic = rows.column(0).fill_null(False).to_numpy(zero_copy_only=False)
                slot = keys & ((1 << BITS) - 1)
                both[1] += np.bincount(slot, minlength=1 << BITS)
                both[0] += np.bincount(slot[toxic[keys >> BITS]], minlength=1 << BITS)
        at = np.flatnonzero(both[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])], ["slot", "in_positive", "in_all"])

    return docs.mapInArrow(run, "slot long, in_positive long, in_all long").groupBy("slot").agg(F.sum("in_positive").alias("in_positive"), F.sum("in_all").alias("in_all"))


def _vectors(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """at (indexes into ``slots``), n (their counts), words."""
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                at, n, row, words = _selected(data, offsets, shared.value)
                cut = pa.array(np.searchsorted(row, np.arange(rows.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(cut, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int32))), pa.array(words)],
                    ["at", "n", "words"],
                )

    return docs.mapInArrow(run, "at array<int>, n array<int>, words long")


def _selected(data, offsets, slots):
    keys, n, words = doc_slots(data, offsets)
    slot = keys & ((1 << BITS) - 1)
    at = np.minimum(np.searchsorted(slots, slot), max(len(slots) - 1, 0))
    hit = slots[at] == slot if len(slots) else np.zeros(len(slot), bool)
    return at[hit], n[hit], keys[hit] >> BITS, words


def fit_nnpu(positive, unlabelled, n_features: int, prior: float, rounds: int = 300, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Weights of the features, of log length and of the bias.

    Each side is (row, at, value, log_length, rows). Full-batch Adam on the
    non-negative risk with the logistic loss.
    """

    def margin(side, w):
        row, at, value, length, rows = side
        return np.bincount(row, w[at] * value, minlength=rows) + w[-2] * length + w[-1]

    def gradient(side, per_doc):
        row, at, value, length, rows = side
        g = np.zeros(n_features + 2)
        g[:n_features] = np.bincount(at, per_doc[row] * value, minlength=n_features)
        g[-2], g[-1] = per_doc @ length, per_doc.sum()
        return g / max(rows, 1)

    w = np.zeros(n_features + 2)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        zp, zu = margin(positive, w), margin(unlabelled, w)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -40, 40))), 1 / (1 + np.exp(-np.clip(zu, -40, 40)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_neg = gradient(unlabelled, su) - prior * gradient(positive, sp)
        g = prior * gradient(positive, sp - 1) + g_neg if negative >= 0 else -g_neg
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def learn(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    """Fits the classifier on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Feature counts cover all of ``docs`` and all of its toxic documents; the
    ``features`` that separate best are kept. The fit itself uses a bounded
    sample, the documented limit of this operator: the ``positives`` toxic ids
    that hash lowest and about ``unlabelled`` documents chosen by the hash of
    their id. ``prior`` is the share of toxic text; when it is not given, the share
    among the labelled rows is used. Null ids and labels teach nothing;
    repeated label rows count once. Without a positive the model scores 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    share, n_known = known.agg(F.avg("toxic"), F.count("*")).first()
    every_toxic = stored(known.where("toxic = 1").select("doc_id"), "toxic-ids")
    toxic = every_toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    ids = np.array(toxic.toArrow()["doc_id"].to_numpy(), np.int64)
    if not len(ids):
        return Model(np.zeros(0, np.int64), np.zeros(2), 0.0)
    prior = min(max(share if prior is None else prior, 1e-4), 0.9)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text"))
    # by its stored size the planner broadcasts the list of ids or shuffles it
    flagged = rows.join(every_toxic.withColumn("positive", F.lit(True)), "doc_id", "left")
    n_docs, n_positive = flagged.agg(F.count("*"), F.count("positive")).first()
    seen, total = float(n_positive), float(n_docs)
    counts = feature_counts(flagged.select("positive", "text")).where("in_positive >= 3")
    a = F.log((F.col("in_positive") + 0.5) / (seen - F.col("in_positive") + 0.5))
    b = F.log((F.col("in_all") + 0.5) / (total - F.col("in_all") + 0.5))
    lift = (a - b) / F.sqrt(1 / (F.col("in_positive") + 0.5) + 1 / (F.col("in_all") + 0.5))
    best = counts.withColumn("lift", lift).where("lift > 2").orderBy(F.desc("lift"), "slot").limit(features).select("slot").toArrow()
    slots = np.sort(best["slot"].to_numpy())
    every = max(1, -(-n_docs // unlabelled))
    drawn = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(every)) == 0)
    # two filters on the scan; the ids of the positives are a bounded list
    chosen = rows.where(F.array_contains(F.lit(ids.tolist()), F.col("doc_id"))) if len(ids) <= 200 else rows.join(F.broadcast(toxic), "doc_id", "left_semi")

    def side(df):
        t = _vectors(df, slots).toArrow().combine_chunks()
        at, n = (t[c].combine_chunks() for c in ("at", "n"))
        sizes = at.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        return row, at.flatten().to_numpy(), np.log1p(n.flatten().to_numpy()), np.log1p(t["words"].to_numpy()) / 10, len(sizes)

    weights = fit_nnpu(side(chosen), side(drawn), len(slots), prior)
    return Model(slots, weights, prior)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", flag: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Every text is scored whole; null and empty texts have no feature and get
    the bias. Columns with the names of the new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in (name, flag)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = len(kept)
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, T.DoubleType()), T.StructField(flag, T.IntegerType())])
    out = [f.name for f in schema.fields]

    def run(batches):
        m = shared.value
        for batch in batches:
            for rows, data, offsets in blocks(batch, "__text"):
                at, n, row, words = _selected(data, offsets, m.slots)
                z = np.bincount(row, m.weights[at] * np.log1p(n), minlength=rows.num_rows)
                z = z + m.weights[-2] * np.log1p(words) / 10 + m.weights[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40))) if m.prior else np.zeros(rows.num_rows)
                yield pa.RecordBatch.from_arrays([*rows.columns[:place], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], out)

    return docs.select(*kept, text_of(text).alias("__text")).mapInArrow(run, schema)
