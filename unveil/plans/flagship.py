"""Flagship query for ``entry()``: planted documents -> P4 -> verdicts per category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.plans.pipeline_queries import planted_verdicts


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = planted_verdicts(spark, sf_dir)
    return v.groupBy("category").agg(
        F.count(F.lit(1)).cast("bigint").alias("docs"),
        F.count_if("injection_detected").cast("bigint").alias("flagged"),
        F.count_if("conclusive_tampering").cast("bigint").alias("conclusive"),
        F.count_if(~F.col("judge_reliable")).cast("bigint").alias("unreliable_judge"),
    )
