"""Ascending-id layout: buckets of the id that follow each other and are about even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = 1000  # quantiles asked of Spark's sketch


def buckets_for(df: DataFrame, per_partition: int = 3) -> int:
    """Bucket count: a few per shuffle partition, so that hashing spreads them evenly."""
    return per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_cuts(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most min(parts, CUTS) - 1 ascending cut points that deal the ids evenly.

    From Spark's quantile sketch; the driver sees the cut points alone. All
    lie above the least id, so bucket 0 is never without one.
    """
    parts = min(parts, CUTS)
    if parts < 2:
        return []
    found = df.where(F.col(column).isNotNull()).approxQuantile(column, [i / parts for i in range(parts)], 0.2 / parts)
    return sorted({int(x) for x in found if x > found[0]})


def bucket_of(column: Column, cuts: list[int], parts: int) -> Column:
    """The bucket of an id, ascending with it (nulls: bucket 0).

    The cut points give the coarse bucket by a nested comparison of
    logarithmic depth; where more than CUTS buckets are wanted, each gap
    between two cut points is divided evenly.
    """

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(cuts[mid]), between(mid + 1, hi)).otherwise(between(lo, mid))

    coarse = between(0, len(cuts))
    fine = -(-parts // CUTS)
    if fine > 1 and len(cuts) > 1:
        # the open gaps at both ends stay whole; their ids are as many as in any other gap
        low = F.element_at(F.lit([0, *cuts]), coarse + 1)
        high = F.element_at(F.lit([*cuts, 0]), coarse + 1)
        inner = F.floor((column - low).cast("double") / (high - low).cast("double") * fine)
        part = F.when((coarse == 0) | (coarse == len(cuts)), F.lit(0)).otherwise(F.least(inner, F.lit(fine - 1)))
        coarse = coarse * fine + part
    return F.when(column.isNull(), F.lit(0)).otherwise(coarse).cast("int")
