"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate: its target share of the mixture's
characters over the characters that it has. A uniform number in [0, 1), read
from a hash of seed and document id, is put through the inverse Poisson
distribution with that mean, which gives the document's number of copies. The
copies are exploded and sorted by a second hash, a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unveil.llm.shared import stored

SEED = "mix-1"
SMALL = 10_000  # sources whose thresholds are broadcast (about 0.5 KB each)
MOST_MEAN = 500
UNIFORM_DIGITS = 13  # hex digits, 52 bits


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by '|'; a null part counts as ''."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, UNIFORM_DIGITS), 16, 10).cast("double") / F.lit(float(1 << (4 * UNIFORM_DIGITS)))


def cumulative(rate: Column) -> Column:
    """P(X <= k) of a Poisson number for k = 0, 1, ... up to where the rest is below 2**-52 or so.

    The terms follow by p(k) = p(k - 1) * rate / k. The first term underflows
    beyond a mean of 700, so callers split larger means.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, weights: DataFrame | None = None, size: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """source, rate, parts, cdf: one row for each source of ``docs``.

    ``weights`` (source, weight) gives the target shares, in any scale; a
    source that it leaves out has weight 0 and rate 0. Without it the weight
    of a source is the square root of its characters. ``size`` is the length of the
    mixture as a multiple of the input. Null is a source of its own. A source
    without characters has rate 0. ``parts`` and ``cdf`` describe the draw: a
    mean above MOST_MEAN is split into equal parts that are drawn one by one
    and added, which is again a Poisson number; cdf is that of one part.
    """
    per = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).cast("bigint").alias("chars"))
    if weights is None:
        weighed = per.withColumn("weight", F.sqrt(F.col("chars").cast("double")))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        weighed = per.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").select("source", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = stored(weighed, "source-sizes")
    weights_sum, total = weighed.agg(F.sum("weight"), F.sum("chars").cast("double")).first()
    rate = F.when((F.col("chars") > 0) & F.lit((weights_sum or 0) > 0), F.col("weight") / F.lit(weights_sum) * F.lit(total) * F.lit(size) / F.col("chars")).otherwise(F.lit(0.0))
    parts = F.greatest(F.ceil(F.col("rate") / MOST_MEAN), F.lit(1)).cast("int")
    split = weighed.select("source", rate.alias("rate")).withColumn("parts", parts)
    return stored(split.withColumn("cdf", cumulative(F.col("rate") / F.col("parts"))), "source-rates")


def mix(
    docs: DataFrame, weights: DataFrame | None = None, size: float = 1.0, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """The mixture: columns of ``docs``, copy_no (from 1), n_copies, shuffle_key, in shuffled order.

    The copies of a document depend on seed, id and its source's rate alone;
    rows that repeat an id get equal counts. Documents of count 0 are left
    out, which is what a rate below 1 means. A null id counts as ''; empty
    texts take part. Columns of ``docs`` with the new names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("copy_no", "n_copies", "shuffle_key")]
    table = rates(docs, weights, size, source, text).select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    # checked size: up to SMALL sources go to every task and texts stay where they are; more take a shuffled join
    table = F.broadcast(table) if table.count() <= SMALL else table
    met = docs.select(*kept).join(table, F.col(source).eqNullSafe(F.col("__source")), "inner")
    drawn = lambda u: F.size(F.filter("__cdf", lambda c: c <= u))
    more = F.aggregate(F.sequence(F.lit(1), F.col("__parts") - 1), F.lit(0), lambda n, j: n + drawn(uniform(F.lit(seed), F.col(doc_id), j)))
    count = drawn(F.col("__u")) + F.when(F.col("__parts") > 1, more).otherwise(0)
    counted = met.withColumn("__u", uniform(F.lit(seed), F.col(doc_id))).withColumn("n_copies", count).where("n_copies > 0")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("copy_no").cast("string")))
    return copies.select(*kept, "copy_no", "n_copies", key.alias("shuffle_key")).orderBy("shuffle_key")
