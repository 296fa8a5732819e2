"""Structured Streaming jobs (ST1, ST2).

ST1 runs the same stateless column functions as the batch ``check`` over a
stream of arriving documents. ST2 feeds each micro-batch to the batch
``screen_and_record`` through ``foreachBatch``. The stream is a ledger writer
of its own: its name is made once and kept beside its checkpoint, so a stream
with a new checkpoint, a second stream and batch jobs can share a ledger. A
replayed micro-batch gets back what it stored. Uniqueness is forever, not per
watermark horizon, so ``dropDuplicatesWithinWatermark`` is not a substitute.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from unveil.operators import ledger as L
from unveil.operators.pipeline import VERDICT_COLUMNS, attach_replies, prepare, verdicts
from unveil.session import ensure_checkpoint_dir

EVIDENCE_SCHEMA = (
    "evidence_id string, sub_id bigint, arrival bigint, doc_id bigint, text string, "
    "sender string, scope string, chain_id string"
)


def read_evidence_stream(spark: SparkSession, input_dir: str, schema: str = EVIDENCE_SCHEMA,
                         max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(input_dir)


def screen_stream(stream: DataFrame, scorer=None, *carry: str, folded: DataFrame | None = None) -> DataFrame:
    """ST1: stream of evidence rows -> stream of verdicts (no state).

    Replies come from a ``scorer`` or from ``folded``, the written result of
    ``replies_by_evidence``, joined stream-static on evidence_id; it is folded
    once, before the stream starts. A row whose replies are not there gets no
    verdict, with ``reply_state`` saying so.
    """
    p = prepare(stream)
    v = verdicts(scorer(p) if scorer is not None else attach_replies(p, folded))
    return v.select("evidence_id", *carry, *VERDICT_COLUMNS, "reply_state")


def stream_writer(spark: SparkSession, checkpoint: str) -> str:
    """The ledger writer name that belongs to a checkpoint."""
    path = checkpoint.rstrip("/") + "-writer"
    try:
        return spark.read.schema("writer string").parquet(path).first().writer
    except Exception as e:  # noqa: BLE001 -- the first start makes the name
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
    name = f"stream-{uuid.uuid4().hex[:16]}"
    spark.createDataFrame([(name,)], "writer string").coalesce(1).write.parquet(path)
    return name


def start_ledger_stream(stream: DataFrame, ledger_path: str, outcome_path: str, scorer,
                        checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """ST2: write-once ledger fed by micro-batches; the epoch is the batch number of the stream's writer."""
    spark = stream.sparkSession
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "ledger-stream")
    writer = stream_writer(spark, ckpt)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        L.screen_and_record(batch, ledger_path, outcome_path, int(epoch_id), scorer, writer)

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
