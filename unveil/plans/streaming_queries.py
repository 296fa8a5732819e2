"""Driver queries for the streams (ST1, ST2): file sources, restarted once, against the batch SQL."""

from __future__ import annotations

import os
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.operators import ledger as L
from unveil.operators.planting import planted
from unveil.plans.common import stored
from unveil.plans.pipeline_queries import _VERDICT5, P4_SQL_COLS, W, p4_columns, reply_table
from unveil.plans.registry import register
from unveil.plans.ledger_queries import scenario_submissions
from unveil.plans.sqltext import pipeline_with
from unveil.plans.standins import stub_scorer
from unveil.session import work_path
from unveil.streaming import late_replies as LR
from unveil.streaming.screening import screen_stream, start_ledger_stream

HALVES = 2


def _arrivals(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


@register("st1_screen_stream", W + f"SELECT {P4_SQL_COLS} FROM verdict")
def st1_screen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted documents arrive in two halves; the stream stops between them and goes on from its checkpoint."""
    root = work_path(spark, "st1")
    source, sink = os.path.join(root, "in"), os.path.join(root, "out")
    docs = planted(spark, sf_dir)
    for k in range(HALVES):
        docs.where(F.col("doc_id") % HALVES == k).write.mode("append").parquet(source)
        verdicts = screen_stream(_arrivals(spark, source, docs.schema), stub_scorer())
        verdicts.writeStream.option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start(sink, "parquet").awaitTermination()
    return p4_columns(spark.read.parquet(sink))


@register(
    "st2_ledger_stream",
    pipeline_with(
        """
subs AS (SELECT CASE WHEN doc_id % 11 = 4 THEN 'solo-' || CAST(doc_id AS VARCHAR)
                     ELSE 'ev-' || CAST(doc_id // 5 AS VARCHAR) END AS ev,
                doc_id AS sub_id, doc_id % 2 AS half, * FROM verdict),
outcome AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY half, sub_id) = 1 AS won FROM subs)"""
    )
    + """SELECT CAST(half AS BIGINT) AS batch_id, ev AS evidence_id, sub_id, CASE WHEN won THEN 'recorded' ELSE 'rejected' END AS status,
       CASE WHEN won THEN category END AS category, CASE WHEN won THEN evidence_hash END AS evidence_hash, won AS in_ledger
FROM outcome""",
)
def st2_ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions arrive in two halves; the ledger stream stops between them and goes on from its checkpoint."""
    root = work_path(spark, "st2")
    source, ledger, outcome = (os.path.join(root, x) for x in ("in", "ledger", "outcome"))
    subs = scenario_submissions(spark, sf_dir).drop("batch_id")
    for k in range(HALVES):
        subs.where(F.col("doc_id") % HALVES == k).write.mode("append").parquet(source)
        stream = _arrivals(spark, source, subs.schema)
        start_ledger_stream(stream, ledger, outcome, stub_scorer(), checkpoint=os.path.join(root, "checkpoint")).awaitTermination()
    held = L.read_ledger(spark, ledger).select("evidence_id", "evidence_hash").withColumn("in_ledger", F.lit(True))
    out = spark.read.schema(L.OUTCOME_SCHEMA).parquet(outcome).join(held, ["evidence_id", "evidence_hash"], "left")
    flag = F.coalesce("in_ledger", F.lit(False)) & (F.col("status") == "recorded")
    return out.select("batch_id", "evidence_id", "sub_id", "status", "category", "evidence_hash", flag.alias("in_ledger"))


ROUNDS = 3
IDS_A_BUCKET = 64
START = "TIMESTAMP '2024-01-01 00:00:00'"


@register(
    "st1_late_replies",
    W
    + f"""SELECT evidence_id, {_VERDICT5.replace("injection_detected, category, judge_reliable, canary_tripped", '''
       CASE WHEN state = 'complete' THEN injection_detected WHEN conclusive THEN TRUE END AS injection_detected,
       CASE WHEN state = 'complete' OR conclusive THEN category END AS category,
       CASE WHEN state = 'complete' THEN judge_reliable END AS judge_reliable,
       CASE WHEN state = 'complete' THEN canary_tripped END AS canary_tripped''')}, evidence_hash, state AS reply_state
FROM (SELECT *, CASE WHEN doc_id % 17 = 3 THEN 'missing_canary' WHEN doc_id % 19 = 5 THEN 'missing_detection' ELSE 'complete' END AS state FROM verdict)""",
)
def st1_late_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies arrive a day apart in ROUNDS rounds, the two of a document mostly in different ones; some never do.

    A round is written by all tasks, and as many files as it may have are one trigger. Where it has fewer, a
    trigger goes on into the next round, which is no more than a day ahead, so nothing is late.
    A last file with a later time and nothing else lets the wait of the others run out.
    """
    root = work_path(spark, "late-replies")
    docs_in, replies_in, sink = (os.path.join(root, x) for x in ("docs", "replies", "out"))
    docs = planted(spark, sf_dir).withColumn("at", F.expr(START))
    docs.write.parquet(docs_in)
    replies = reply_table(spark, sf_dir).join(docs.select("evidence_id", "doc_id"), "evidence_id")
    k, canary = F.col("doc_id"), F.col("kind") == "canary"
    never = (canary & (k % 17 == 3)) | (~canary & (k % 19 == 5) & (k % 17 != 3))
    due = (k + F.when(canary, 1).otherwise(0)) % ROUNDS
    timed = stored(replies.where(~never).select("evidence_id", "kind", "response", due.alias("round")), "timed-replies")
    files = spark.sparkContext.defaultParallelism
    clock = spark.createDataFrame([("clock", "clock", None, ROUNDS + 9)], "evidence_id string, kind string, response string, round int")
    for part in [timed.where(F.col("round") == r).repartition(files) for r in range(ROUNDS)] + [clock.coalesce(1)]:
        part.select("evidence_id", "kind", "response", F.expr(f"{START} + make_interval(0, 0, 0, round)").alias("at")).write.mode("append").parquet(replies_in)
    schema = "evidence_id string, kind string, response string, at timestamp"
    was = spark.conf.get(LR.PROVIDER)
    spark.conf.set(LR.PROVIDER, LR.ROCKSDB)
    try:
        late = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(replies_in)
        buckets = 1 + spark.read.parquet(docs_in).count() // IDS_A_BUCKET
        out = LR.screen_with_late_replies(_arrivals(spark, docs_in, docs.schema), late, timedelta(days=ROUNDS + 1), timedelta(days=1), buckets=buckets)
        out.writeStream.option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start(sink, "parquet").awaitTermination()
    finally:
        spark.conf.set(LR.PROVIDER, was)
    return spark.read.parquet(sink).select("evidence_id", *[c.strip() for c in _VERDICT5.split(",")], "evidence_hash", "reply_state")
