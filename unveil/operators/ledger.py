"""Write-once verdict ledger.

Rows live in immutable segments behind numbered snapshots (``segments``). A
batch is named by its writer (a job or a stream's checkpoint) and its number.
It decides on key columns alone against a snapshot, writes that decision to
the shared folder, reads the texts of the winners once, writes its outcome and
a segment, and publishes by creating the next snapshot. If another writer has created it first, the ids that the
others have stored meanwhile are rejected in the outcome and left out of the segment,
and the batch tries the next number. So each id is stored once,
by the batch that published first, however many writers there are. Replaying a
batch with the submissions it had gives back what is stored; other submissions
under a used number are refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unveil.functions import fixed
from unveil.operators import segments as S
from unveil.operators.pipeline import prepare, verdicts
from unveil.operators.segments import id_bucket
from unveil.session import work_path
from unveil.sources import store

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("evidence_id", T.StringType()),
        T.StructField("injection_detected", T.BooleanType()),
        T.StructField("judge_reliable", T.BooleanType()),
        T.StructField("canary_tripped", T.BooleanType()),
        T.StructField("conclusive_tampering", T.BooleanType()),
        T.StructField("category", T.StringType()),
        T.StructField("evidence_hash", T.StringType()),
        T.StructField("removed_items", T.ArrayType(T.StringType())),
        T.StructField("submitted_by", T.StringType()),
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("id_bucket", T.IntegerType()),
    ]
)
RECORD_FIELDS = [f.name for f in LEDGER_SCHEMA.fields if f.name not in ("writer", "batch_id", "id_bucket")]


class BatchConflict(ValueError):
    """A used batch number came back with other submissions."""


def ledger_rows(verdict: DataFrame, batch_id: int, writer: str = "batch") -> DataFrame:
    """L1: verdict + hash + removals + submitter, fixed schema."""
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields if f.name in RECORD_FIELDS]
    return verdict.select(
        *fields, F.lit(writer).alias("writer"), F.lit(batch_id).cast("bigint").alias("batch_id"), id_bucket(F.col("evidence_id")).alias("id_bucket")
    )


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """All records of the newest snapshot."""
    return S.rows_of(spark, S.snapshot(spark, ledger_path), LEDGER_SCHEMA)


def reject_message(evidence_id: F.Column) -> F.Column:
    head, tail = fixed.template_parts(fixed.LEDGER_MESSAGE, "evidence_id")
    return F.when(evidence_id.isNull(), F.lit("Evidence id is missing")).otherwise(F.concat(F.lit(head), evidence_id, F.lit(tail)))


def ids_in(spark: SparkSession, snap: S.Snapshot, ids: DataFrame) -> DataFrame:
    """The subset of ``ids`` (evidence_id) that a snapshot stores.

    Only files whose index admits one of the ids are read, and of them the id column.
    """
    led = S.rows_that_may_match(spark, snap, LEDGER_SCHEMA, ids).select("evidence_id", "id_bucket")
    keyed = ids.select("evidence_id", id_bucket(F.col("evidence_id")).alias("id_bucket"))
    return led.join(keyed, ["id_bucket", "evidence_id"], "left_semi").select("evidence_id")


def classify_submissions(spark: SparkSession, subs: DataFrame, snap: S.Snapshot) -> DataFrame:
    """(evidence_id, sub_id, state), one row for each pair in ``subs``; reads no text.

    state: fresh (first of a new id, by arrival, then sub_id), stale (first of
    a stored id), duplicate, or null_id. Both aggregates are partial, so a hot
    id is reduced before the shuffle.
    """
    pairs = subs.groupBy("evidence_id", "sub_id").agg(F.min("arrival").alias("arrival"))
    firsts = pairs.where(F.col("evidence_id").isNotNull()).groupBy("evidence_id").agg(F.min(F.struct("arrival", "sub_id")).alias("_w"))
    known = ids_in(spark, snap, firsts).select("evidence_id", F.lit(True).alias("_known"))
    tagged = firsts.join(known, "evidence_id", "left")
    j = pairs.join(tagged, "evidence_id", "left")
    state = (
        F.when(F.col("evidence_id").isNull(), F.lit("null_id"))
        .when(~F.col("sub_id").eqNullSafe(F.col("_w.sub_id")), F.lit("duplicate"))
        .when(F.col("_known"), F.lit("stale")).otherwise(F.lit("fresh"))
    )
    return j.select("evidence_id", "sub_id", state.alias("state"))


OUTCOME_SCHEMA = T.StructType(
    [
        T.StructField("evidence_id", T.StringType()),
        T.StructField("sub_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        *[f for f in LEDGER_SCHEMA.fields if f.name in RECORD_FIELDS and f.name != "evidence_id"],
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``; empty if nothing has been written yet."""
    return spark.read.schema(schema).parquet(path) if store.exists(spark, path) else spark.createDataFrame([], schema)


@dataclass
class Batch:
    """A decided batch that is not published yet."""

    writer: str
    batch_id: int
    ledger_path: str
    outcome_path: str
    seen: set[str] = field(default_factory=set)  # segments that the decision has looked at
    segment: S.Segment | None = None


def _outcome(spark: SparkSession, path: str, writer: str, batch_id: int) -> DataFrame:
    mine = (F.col("writer") == writer) & (F.col("batch_id") == batch_id)
    return _read(spark, path, OUTCOME_SCHEMA).where(mine)


def _null_record() -> list[F.Column]:
    return [F.lit(None).cast(LEDGER_SCHEMA[c].dataType).alias(c) for c in RECORD_FIELDS if c != "evidence_id"]


def _winning_texts(subs: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row of ``subs`` for each pair in ``fresh``; of repeated rows the one whose text has the least digest."""
    same = F.col("s.evidence_id").eqNullSafe(F.col("f.evidence_id")) & F.col("s.sub_id").eqNullSafe(F.col("f.sub_id"))
    found = subs.alias("s").join(fresh.alias("f"), same, "left_semi")
    order = F.struct(F.sha2(F.col("text").cast("binary"), 256), "sender", "scope", "chain_id")
    one = found.groupBy("evidence_id", "sub_id").agg(F.min_by(F.struct(*subs.columns), order).alias("one"))
    return one.select("one.*")


def decide(subs: DataFrame, ledger_path: str, outcome_path: str, batch_id: int, scorer, writer: str = "batch", resume: bool | None = None) -> Batch:
    """Decides and scores a batch against the newest snapshot, and writes its outcome and segment.

    Nothing is visible in the ledger yet; statuses count once ``publish`` has
    been through. An outcome that a lost run has left is taken over (``resume``: whether
    there is one, if the caller knows).
    """
    spark = subs.sparkSession
    snap = S.snapshot(spark, ledger_path)
    batch = Batch(writer, batch_id, ledger_path, outcome_path)
    if resume is None:
        resume = bool(_outcome(spark, outcome_path, writer, batch_id).head(1))
    if not resume:
        state_path = work_path(spark, "batch-state")
        classify_submissions(spark, subs, snap).write.parquet(state_path)
        states = spark.read.parquet(state_path)
        texts = _winning_texts(subs, states.where("state = 'fresh'").select("evidence_id", "sub_id"))
        v = verdicts(scorer(prepare(texts))).withColumn("submitted_by", F.col("sender"))
        scored = F.col("reply_state") == "complete"
        recorded = v.select(
            "evidence_id", "sub_id",
            F.when(scored, F.lit("recorded")).otherwise(F.lit("unscored")).alias("status"),
            F.when(~scored, F.concat(F.lit("replies: "), F.col("reply_state"))).alias("message"),
            *[F.when(scored, F.col(c)).cast(LEDGER_SCHEMA[c].dataType).alias(c) for c in RECORD_FIELDS if c != "evidence_id"],
        )
        rejected = states.where("state != 'fresh'").select(
            "evidence_id", "sub_id", F.lit("rejected").alias("status"), reject_message(F.col("evidence_id")).alias("message"), *_null_record()
        )
        named = recorded.unionByName(rejected).select("*", F.lit(writer).alias("writer"), F.lit(batch_id).cast("bigint").alias("batch_id"))
        _publish(named, outcome_path, ["writer", "batch_id"])
        batch.seen = {s.name for s in snap.segments}
    batch.segment = _segment(spark, batch)
    return batch


def _segment(spark: SparkSession, batch: Batch) -> S.Segment:
    decided = _outcome(spark, batch.outcome_path, batch.writer, batch.batch_id).where("status = 'recorded'")
    return S.write_segment(ledger_rows(decided, batch.batch_id, batch.writer), batch.ledger_path)


def publish(spark: SparkSession, batch: Batch) -> None:
    """Makes a decided batch visible, without the ids that others have published since it was decided."""
    while True:
        snap = S.snapshot(spark, batch.ledger_path)
        if snap.committed(batch.writer, batch.batch_id):
            if batch.segment.name not in S.named(spark, batch.ledger_path):  # another run of the same batch came first
                S.drop_segment(spark, batch.ledger_path, batch.segment.name)
            return
        added = {s.name for s in snap.segments} - batch.seen
        if added and batch.segment.rows:
            _yield_ids(spark, batch, snap.only(added))
        batch.seen |= added
        if S.commit(spark, snap, [batch.segment], batch=(batch.writer, batch.batch_id)):
            return


def _yield_ids(spark: SparkSession, batch: Batch, others: S.Snapshot) -> None:
    """Rejects the batch's recorded ids that ``others`` hold, in its outcome and in its segment."""
    out = _outcome(spark, batch.outcome_path, batch.writer, batch.batch_id)
    lost_path = work_path(spark, "lost-ids")
    ids_in(spark, others, out.where("status = 'recorded'").select("evidence_id")).distinct().write.parquet(lost_path)
    lost = spark.read.schema("evidence_id string").parquet(lost_path)
    if not lost.head(1):
        return
    was = out.join(lost.withColumn("_lost", F.lit(True)), "evidence_id", "left")
    gone = F.col("_lost") & (F.col("status") == "recorded")
    fields = [f.name for f in OUTCOME_SCHEMA.fields]
    new = {
        "status": F.when(gone, F.lit("rejected")).otherwise(F.col("status")),
        "message": F.when(gone, reject_message(F.col("evidence_id"))).otherwise(F.col("message")),
        **{c: F.when(~F.coalesce(gone, F.lit(False)), F.col(c)) for c in RECORD_FIELDS if c != "evidence_id"},
    }
    copy_path = work_path(spark, "outcome")
    was.select(*[new.get(c, F.col(c)).alias(c) for c in fields]).write.parquet(copy_path)
    _publish(spark.read.schema(OUTCOME_SCHEMA).parquet(copy_path), batch.outcome_path, ["writer", "batch_id"])
    S.drop_segment(spark, batch.ledger_path, batch.segment.name)
    batch.segment = _segment(spark, batch)


def screen_and_record(
    subs: DataFrame,
    ledger_path: str,
    outcome_path: str,
    batch_id: int,
    scorer,
    writer: str = "batch",
) -> DataFrame:
    """L2 + S2 for one batch; returns the batch outcome read back from storage.

    subs needs evidence_id, sub_id, arrival, text, sender, scope, chain_id
    (+ whatever ``scorer`` reads). One row is kept for each (evidence_id,
    sub_id); of repeated rows the one whose text has the least digest. Duplicates, ids already
    in the ledger and null ids are rejected before scoring. A winner whose
    model replies have not arrived has status ``unscored`` and no record, so a
    later batch may submit it again. A batch number that was used raises
    ``BatchConflict`` when the submissions differ, and otherwise gives back
    the stored outcome. Small segments are merged as they add up.
    """
    spark = subs.sparkSession
    before = _outcome(spark, outcome_path, writer, batch_id)
    resume = bool(before.head(1))
    if resume:
        keys = ["evidence_id", "sub_id"]
        old, new = before.select(*keys), subs.select(*keys).distinct()
        if old.exceptAll(new).unionByName(new.exceptAll(old)).head(1):
            raise BatchConflict(f"batch {batch_id} of writer {writer!r} is stored with other submissions")
    # a batch lost before it was published is finished here, from what was decided
    if not S.snapshot(spark, ledger_path).committed(writer, batch_id):
        publish(spark, decide(subs, ledger_path, outcome_path, batch_id, scorer, writer, resume))
        if S.merge_levels(spark, ledger_path, LEDGER_SCHEMA):
            S.vacuum(spark, ledger_path)
    out = _outcome(spark, outcome_path, writer, batch_id)
    return out.select("batch_id", "evidence_id", "sub_id", "status", "message", "category", "evidence_hash")


def _publish(rows: DataFrame, path: str, by: list[str]) -> None:
    """Writes the partitions that ``rows`` names, and no other."""
    rows.sortWithinPartitions(*by, "evidence_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def compact(spark: SparkSession, ledger_path: str, target_path: str) -> DataFrame:
    """A copy of the newest snapshot as one segment in a ledger of its own."""
    snap = S.snapshot(spark, ledger_path)
    copy = S.write_segment(S.rows_of(spark, snap, LEDGER_SCHEMA), target_path, 1, sum(s.rows for s in snap.segments))
    fresh = S.Snapshot(target_path, -1, [], snap.batches)
    if not S.commit(spark, fresh, [copy]):
        raise FileExistsError(f"{target_path} holds a ledger")
    return read_ledger(spark, target_path)


class RecordNotFound(KeyError):
    pass


def get_records(spark: SparkSession, ledger_path: str, requests: DataFrame, strict: bool = False) -> DataFrame:
    """L3/S3: bulk keyed lookup; every request comes back with ``found``.

    Only files that can hold a requested id, by range and Bloom page, are read; the
    buckets of the requests (at most 16 numbers) are a partition
    filter of that scan, and the join runs on bucket and id. The lookup
    is of one snapshot. With ``strict`` a missing id raises, as a single keyed get does.
    """
    asked = requests.select("*", id_bucket(F.col("evidence_id")).alias("id_bucket"))
    buckets = [r.id_bucket for r in asked.select("id_bucket").where("id_bucket is not null").distinct().collect()]
    snap = S.snapshot(spark, ledger_path)
    led = S.rows_that_may_match(spark, snap, LEDGER_SCHEMA, requests).where(F.col("id_bucket").isin(buckets)).select(*RECORD_FIELDS, "id_bucket")
    out = asked.join(led, ["id_bucket", "evidence_id"], "left").select(*requests.columns, *[c for c in RECORD_FIELDS if c != "evidence_id"])
    out = out.select("*", F.col("evidence_hash").isNotNull().alias("found"))
    if strict:
        miss = out.where(~F.col("found")).select("evidence_id").head(1)
        if miss:
            raise RecordNotFound(miss[0].evidence_id)
    return out
