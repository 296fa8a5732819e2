"""Shared plan fragments for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.functions.cleaner import clean
from unveil.operators.layout import spread  # noqa: F401  (re-exported)
from unveil.operators.planting import planted
from unveil.session import work_path

SEP = chr(1)  # joins payload lists before hashing; never occurs in the data


def planted_cleaned(spark: SparkSession, sf_dir: str, keep_stages: bool = False, render: bool = True) -> DataFrame:
    return clean(spread(planted(spark, sf_dir), "evidence_id"), "text", keep_stages=keep_stages, render=render)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what stands above it runs once."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sha(col: Column) -> Column:
    return F.sha2(col, 256)


def joined_hash(arr: Column) -> Column:
    return F.sha2(F.array_join(arr, SEP), 256)


def blen(col: Column) -> Column:
    return F.length(col).cast("bigint")


def bsize(col: Column) -> Column:
    return F.size(col).cast("bigint")
