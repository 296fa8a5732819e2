"""Judge-panel consensus.

panel(evidence_id, judge_id, mode, status, injection_detected, category,
canary_leaked): one leader row and any number of validator rows per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unveil.functions.judge import category_is_wellformed


def validator_votes(panel: DataFrame) -> DataFrame:
    """P5: each validator's vote on its leader.

    Leaders (one row per id) are joined to validators on evidence_id; AQE
    decides broadcast vs shuffle from runtime sizes and splits a skewed id.
    A validator agrees only if the leader returned, both load-bearing bits
    match (null-safe), and the leader's category has a valid shape.
    """
    leaders = panel.where(F.col("mode") == "leader").select(
        "evidence_id",
        F.col("status").alias("l_status"),
        F.col("injection_detected").alias("l_detected"),
        F.col("category").alias("l_category"),
        F.col("canary_leaked").alias("l_leaked"),
    )
    validators = panel.where(F.col("mode") == "validator")
    j = validators.join(leaders, "evidence_id", "left")
    agree: Column = (
        (F.col("l_status") == "success")
        & (F.col("status") == "success")
        & F.col("injection_detected").eqNullSafe(F.col("l_detected"))
        & F.col("canary_leaked").eqNullSafe(F.col("l_leaked"))
        & category_is_wellformed(F.col("l_category"), F.col("l_detected"))
    )
    return j.select("evidence_id", "judge_id", F.coalesce(agree, F.lit(False)).alias("agree"))


def panel_acceptance(panel: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accepted when agreeing validators exceed ``threshold`` of the panel.

    The threshold is not fixed by the screened system (its runtime decides);
    the default is a strict majority. An id without a validator stays, with
    no votes and not accepted. Partial aggregation per task first.
    """
    votes = validator_votes(panel).select("evidence_id", "agree")
    every = votes.unionByName(panel.where(F.col("mode") != "validator").select("evidence_id", F.lit(None).cast("boolean").alias("agree")))
    g = every.groupBy("evidence_id").agg(
        F.count("agree").cast("bigint").alias("n_validators"),
        F.count_if("agree").cast("bigint").alias("n_agree"),
    )
    return g.select("*", (F.col("n_agree") > F.col("n_validators") * F.lit(threshold)).alias("accepted"))
