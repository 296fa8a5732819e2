"""Tables in the cluster's shared folder, and id helpers used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.session import ship_package, work_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` under ``spark.checkpoint.dir`` and reads it back.

    Cuts the lineage in a way that outlives a lost executor, and runs the
    plan above it once however often the result is read.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    ship_package(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def with_group(rows: DataFrame, groups: DataFrame, key: str, *more: str) -> DataFrame:
    """``rows`` joined with an aggregate of them on the long ``key`` and ``more`` columns.

    An aggregate by the key is already dealt by it, and a join that reuses
    that layout cannot be split. Joining on the complement of the key gives both sides
    an exchange of their own, so the skew join may split a hot key.
    """
    k = F.bitwise_not(F.col(key)).alias("__k")
    return rows.select("*", k).join(groups.select(k, *[c for c in groups.columns if c != key]), ["__k", *more]).drop("__k")
