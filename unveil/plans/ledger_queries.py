"""Driver queries for panel consensus (P5, P6) and the ledger."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.operators import consensus as K
from unveil.operators import ledger as L
from unveil.operators import segments as S
from unveil.operators.planting import planted
from unveil.plans import standins as X
from unveil.plans.common import SEP, bsize, sha, stored
from unveil.plans.pipeline_queries import planted_verdicts
from unveil.plans.registry import register
from unveil.plans.standins import stub_scorer
from unveil.plans.sqltext import pipeline_with, wellformed_sql
from unveil.session import work_path

# ------------------------------------------------------------------ panel

PANEL_SQL = f"""
panel0 AS (SELECT evidence_id, doc_id, det, det_category, leaked, unnest(range({X.PANEL_SIZE})) AS j FROM verdict),
panel AS (SELECT evidence_id, CAST(j AS INTEGER) AS judge_id,
                 CASE WHEN j = 0 THEN 'leader' ELSE 'validator' END AS mode,
                 CASE WHEN j = 0 AND doc_id % {X.LEADER_MISSING_EVERY} = 0 THEN 'error' ELSE 'success' END AS status,
                 CASE WHEN j = 0 AND doc_id % {X.LEADER_MISSING_EVERY} = 0 THEN NULL
                      WHEN (doc_id + j) % {X.FLIP_DETECT_EVERY} = 0 THEN NOT det ELSE det END AS injection_detected,
                 CASE WHEN j = 0 AND doc_id % {X.LEADER_MISSING_EVERY} = 0 THEN NULL ELSE det_category END AS category,
                 CASE WHEN j = 0 AND doc_id % {X.LEADER_MISSING_EVERY} = 0 THEN NULL
                      WHEN (doc_id + 2 * j) % {X.FLIP_LEAK_EVERY} = 0 THEN NOT leaked ELSE leaked END AS canary_leaked
          FROM panel0),
leaders AS (SELECT evidence_id, status AS l_status, injection_detected AS l_det, category AS l_cat,
                   canary_leaked AS l_leak FROM panel WHERE mode = 'leader'),
votes AS (SELECT v.evidence_id, v.judge_id,
                 coalesce(l.l_status = 'success' AND v.status = 'success'
                          AND v.injection_detected IS NOT DISTINCT FROM l.l_det
                          AND v.canary_leaked IS NOT DISTINCT FROM l.l_leak
                          AND {wellformed_sql('l.l_cat', 'l.l_det')}, FALSE) AS agree
          FROM panel v LEFT JOIN leaders l ON v.evidence_id = l.evidence_id WHERE v.mode = 'validator')"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(X.synthetic_panel(planted_verdicts(spark, sf_dir)), "panel")


@register("p5_validator_votes", pipeline_with(PANEL_SQL) + "SELECT evidence_id, judge_id, agree FROM votes")
def p5_validator_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.validator_votes(_panel(spark, sf_dir))


@register(
    "p6_panel_acceptance",
    pipeline_with(PANEL_SQL)
    + """SELECT evidence_id, CAST(count(*) AS BIGINT) AS n_validators, CAST(count_if(agree) AS BIGINT) AS n_agree,
       count_if(agree) > count(*) * 0.5 AS accepted FROM votes GROUP BY evidence_id""",
)
def p6_panel_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.panel_acceptance(_panel(spark, sf_dir))


# ------------------------------------------------------------------ ledger

_V5 = "injection_detected, judge_reliable, canary_tripped, conclusive_tampering, category"


@register(
    "l1_ledger_row",
    pipeline_with()
    + f"""SELECT evidence_id, {_V5}, evidence_hash, CAST(len(removed_items) AS BIGINT) AS n_removed_items,
       sha256(array_to_string(removed_items, chr(1))) AS removed_items_hash, sender AS submitted_by FROM verdict""",
)
def l1_ledger_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.ledger_rows(planted_verdicts(spark, sf_dir).withColumn("submitted_by", F.col("sender")), 0)
    return rows.select(
        "evidence_id", *[c.strip() for c in _V5.split(",")], "evidence_hash",
        bsize(F.col("removed_items")).alias("n_removed_items"),
        sha(F.array_join("removed_items", SEP)).alias("removed_items_hash"), "submitted_by",
    )


N_BATCHES = 3


def scenario_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every planted document becomes a submission, every seventh twice.

    Ids repeat (``ev-<doc_id div 5>``), so a batch holds duplicates and later
    batches re-submit ids of earlier ones; every eleventh document keeps an id
    of its own. batch = doc_id % 3, arrival = doc_id.
    """
    d = F.col("doc_id")
    twice = F.array_repeat(F.lit(1), F.when(d % 7 == 0, 2).otherwise(1))  # an at-least-once source
    return planted(spark, sf_dir).withColumn("_again", F.explode(twice)).select(
        F.when(d % 11 == 4, F.concat(F.lit("solo-"), d.cast("string")))
        .otherwise(F.concat(F.lit("ev-"), F.expr("doc_id div 5").cast("string")))
        .alias("evidence_id"),
        d.alias("sub_id"), d.alias("arrival"), (d % N_BATCHES).alias("batch_id"),
        "doc_id", "text", "sender", "scope", "chain_id",
    )


def run_scenario(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Screen-and-record the batches in order; returns (ledger_path, outcomes)."""
    root = work_path(spark, "ledger")
    ledger_path, outcome_path = os.path.join(root, "ledger"), os.path.join(root, "outcome")
    subs = scenario_submissions(spark, sf_dir)
    for b in range(N_BATCHES):
        batch = subs.where(F.col("batch_id") == b)
        L.screen_and_record(batch, ledger_path, outcome_path, b, stub_scorer())
    return ledger_path, spark.read.parquet(outcome_path)


SCENARIO_SQL = """
subs AS (SELECT CASE WHEN doc_id % 11 = 4 THEN 'solo-' || CAST(doc_id AS VARCHAR)
                     ELSE 'ev-' || CAST(doc_id // 5 AS VARCHAR) END AS ev,
                doc_id AS sub_id, doc_id % 3 AS batch_id, * FROM verdict),
outcome AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY ev ORDER BY batch_id, sub_id) = 1
                           THEN 'recorded' ELSE 'rejected' END AS status FROM subs),
ledger AS (SELECT * FROM outcome WHERE status = 'recorded')"""


@register(
    "l2_screen_and_record",
    pipeline_with(SCENARIO_SQL)
    + """SELECT CAST(batch_id AS BIGINT) AS batch_id, ev AS evidence_id, sub_id, status,
       CASE WHEN status = 'rejected' THEN 'Evidence ''' || ev || ''' already screened' END AS message,
       CASE WHEN status = 'recorded' THEN category END AS category,
       CASE WHEN status = 'recorded' THEN evidence_hash END AS evidence_hash
FROM outcome""",
)
def l2_screen_and_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = run_scenario(spark, sf_dir)
    return out.select("batch_id", "evidence_id", "sub_id", "status", "message", "category", "evidence_hash")


@register(
    "s2_ledger_write",
    pipeline_with(SCENARIO_SQL)
    + """SELECT ev AS evidence_id, CAST(batch_id AS BIGINT) AS batch_id, sender AS submitted_by, category,
       evidence_hash, CAST(len(removed_items) AS BIGINT) AS n_removed_items FROM ledger""",
)
def s2_ledger_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = run_scenario(spark, sf_dir)
    led = L.read_ledger(spark, path)
    return led.select("evidence_id", "batch_id", "submitted_by", "category", "evidence_hash",
                      bsize(F.col("removed_items")).alias("n_removed_items"))


@register(
    "s3_ledger_read",
    pipeline_with(SCENARIO_SQL)
    + """SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS records,
       CAST(count_if(injection_detected) AS BIGINT) AS flagged,
       CAST(count(DISTINCT sender) AS BIGINT) AS submitters FROM ledger GROUP BY batch_id""",
)
def s3_ledger_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = run_scenario(spark, sf_dir)
    led = L.read_ledger(spark, path)
    return led.groupBy("batch_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("records"),
        F.count_if("injection_detected").cast("bigint").alias("flagged"),
        F.count_distinct("submitted_by").cast("bigint").alias("submitters"),
    )


@register(
    "l3_get_records",
    pipeline_with(SCENARIO_SQL)
    + """, requests AS (SELECT DISTINCT ev AS evidence_id FROM subs
                  UNION ALL SELECT 'ghost-' || CAST(doc_id AS VARCHAR) FROM verdict)
SELECT r.evidence_id, l.evidence_hash IS NOT NULL AS found, l.category, l.sender AS submitted_by, l.evidence_hash
FROM requests r LEFT JOIN ledger l ON r.evidence_id = l.ev""",
)
def l3_get_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = run_scenario(spark, sf_dir)
    subs = scenario_submissions(spark, sf_dir)
    ghosts = planted(spark, sf_dir).select(F.concat(F.lit("ghost-"), F.col("doc_id").cast("string")).alias("evidence_id"))
    requests = subs.select("evidence_id").distinct().unionByName(ghosts)
    got = L.get_records(spark, path, requests)
    return got.select("evidence_id", "found", "category", "submitted_by", "evidence_hash")


# ------------------------------------------------------------------ several writers, segments, index


@register(
    "l2_two_writers",
    pipeline_with(
        """
subs AS (SELECT CASE WHEN doc_id % 11 = 4 THEN 'solo-' || CAST(doc_id AS VARCHAR)
                     ELSE 'ev-' || CAST(doc_id // 5 AS VARCHAR) END AS ev,
                doc_id AS sub_id, CASE WHEN doc_id % 2 = 0 THEN 'job-a' ELSE 'job-b' END AS writer, * FROM verdict),
outcome AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY writer, sub_id) = 1 AS won,
                   first_value(writer) OVER (PARTITION BY ev ORDER BY writer, sub_id) AS stored_by FROM subs)"""
    )
    + """SELECT writer, ev AS evidence_id, sub_id, CASE WHEN won THEN 'recorded' ELSE 'rejected' END AS status, stored_by,
       CAST(1 AS BIGINT) AS stored, CASE WHEN won THEN category END AS category, CASE WHEN won THEN evidence_hash END AS evidence_hash
FROM outcome""",
)
def l2_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers decide before either publishes; the one that publishes later yields the ids both took."""
    root = work_path(spark, "two-writers")
    ledger_path, outcome_path = os.path.join(root, "ledger"), os.path.join(root, "outcome")
    subs = scenario_submissions(spark, sf_dir)
    decided = [L.decide(subs.where(F.col("doc_id") % 2 == k), ledger_path, outcome_path, 0, stub_scorer(), w) for k, w in enumerate(("job-a", "job-b"))]
    for batch in decided:
        L.publish(spark, batch)
    held = L.read_ledger(spark, ledger_path).groupBy("evidence_id").agg(F.count(F.lit(1)).alias("stored"), F.min("writer").alias("stored_by"))
    out = spark.read.schema(L.OUTCOME_SCHEMA).parquet(outcome_path)
    return out.join(held, "evidence_id").select("writer", "evidence_id", "sub_id", "status", "stored_by", "stored", "category", "evidence_hash")


SEGMENTS = S.FANOUT + 1


def segmented_ledger(spark: SparkSession, sf_dir: str) -> str:
    """The verdicts of all planted documents in SEGMENTS commits."""
    path = work_path(spark, "segments")
    verdicts = planted_verdicts(spark, sf_dir).withColumn("submitted_by", F.col("sender"))
    rows = stored(verdicts.select(*L.RECORD_FIELDS, "doc_id"), "verdict-rows")
    for k in range(SEGMENTS):
        part = S.write_segment(L.ledger_rows(rows.where(F.col("doc_id") % SEGMENTS == k), k), path)
        if not S.commit(spark, S.snapshot(spark, path), [part], batch=("batch", k)):
            raise RuntimeError("another writer in a folder of this job")
    return path


@register(
    "s2_level_merge",
    pipeline_with()
    + f"""SELECT evidence_id, CAST(doc_id % {SEGMENTS} AS BIGINT) AS batch_id, category, CAST(1 AS BIGINT) AS copies_before,
       CAST(1 AS BIGINT) AS copies_after FROM verdict""",
)
def s2_level_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that began before a merge and one that begins after it see each id once."""
    path = segmented_ledger(spark, sf_dir)
    reader = S.rows_of(spark, S.snapshot(spark, path), L.LEDGER_SCHEMA)
    S.merge_levels(spark, path, L.LEDGER_SCHEMA)
    before = reader.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("copies_before"))
    after = L.read_ledger(spark, path).groupBy("evidence_id", "batch_id", "category").agg(F.count(F.lit(1)).alias("copies_after"))
    return after.join(before, "evidence_id").select("evidence_id", "batch_id", "category", "copies_before", "copies_after")


@register(
    "l3_indexed_lookup",
    pipeline_with(
        """
requests AS (SELECT evidence_id FROM verdict WHERE doc_id % 7 = 0
                  UNION ALL SELECT 'ghost-' || CAST(doc_id AS VARCHAR) FROM verdict)"""
    )
    + """SELECT r.evidence_id, v.evidence_hash IS NOT NULL AS found, v.category, v.sender AS submitted_by, v.evidence_hash
FROM requests r LEFT JOIN verdict v ON r.evidence_id = v.evidence_id""",
)
def l3_indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by range and Bloom page in a ledger of merged and fresh segments."""
    path = segmented_ledger(spark, sf_dir)
    S.merge_levels(spark, path, L.LEDGER_SCHEMA)
    docs = planted(spark, sf_dir).select("evidence_id", "doc_id")
    ghosts = docs.select(F.concat(F.lit("ghost-"), F.col("doc_id").cast("string")).alias("evidence_id"))
    got = L.get_records(spark, path, docs.where(F.col("doc_id") % 7 == 0).select("evidence_id").unionByName(ghosts))
    return got.select("evidence_id", "found", "category", "submitted_by", "evidence_hash")
