"""P2 over a content-addressed reply cache: each distinct prompt is asked once, over all batches.

A prompt's key is the hash of its kind and text. Replies lie in the segments
of ``unveil.operators.segments`` under that key, so a batch reads only files that can
hold its keys, two jobs may fill one cache, and ``merge_levels`` and ``vacuum`` apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unveil.operators import segments as S
from unveil.operators.responses import Model, score_with
from unveil.session import work_path

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("evidence_id", T.StringType()),  # the prompt's key
        T.StructField("response", T.StringType()),
        T.StructField("asked_in", T.StringType()),
        T.StructField("id_bucket", T.IntegerType()),
    ]
)


def prompt_key(kind: Column, prompt: Column) -> Column:
    """Null for a null prompt."""
    return F.sha2(F.concat(F.coalesce(kind, F.lit("")), F.lit("\n"), prompt), 256)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _held(snap: S.Snapshot, keys: DataFrame) -> DataFrame:
    """Replies of a snapshot for ``keys`` (evidence_id), from the files that can hold them."""
    rows = S.rows_that_may_match(keys.sparkSession, snap, CACHE_SCHEMA, keys)
    return rows.select("evidence_id", "response", "asked_in", "id_bucket")


def answer(prompts: DataFrame, model: Model, path: str, batch: str) -> DataFrame:
    """(evidence_id, kind, key, response, asked_in) for every row of ``prompts`` (evidence_id, kind, prompt).

    Prompts are folded by key, with a partial aggregate before the shuffle, so a text
    that a third of all rows share is one row of one task and one call. Keys
    that the cache at ``path`` holds are not asked; replies of the others join it
    under the name ``batch``. If another job has stored some of the same
    keys meanwhile, its replies count and this job's are left out, so every
    reader sees one reply a key.

    A null prompt is not asked and has a null reply. A null reply of the model
    is no reply: it is handed back as null, is not kept, and a later batch asks again.
    Repeated rows come back as often as they were given. A job lost before
    its commit leaves nothing in the cache; its replies are asked again.
    """
    spark = prompts.sparkSession
    key = prompt_key(F.col("kind"), F.col("prompt"))
    rows = _stored(prompts.select("evidence_id", "kind", "prompt", key.alias("key")), "prompts")
    each = rows.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("evidence_id")).agg(F.min("kind").alias("kind"), F.min("prompt").alias("prompt"))
    distinct = _stored(each, "distinct-prompts")
    keys = distinct.select("evidence_id")
    snap = S.snapshot(spark, path)
    todo = distinct.join(_held(snap, keys).select("evidence_id"), "evidence_id", "left_anti")
    asked = _stored(score_with(todo, model).where("response is not null"), "asked")
    fresh = asked.select("evidence_id", "response", F.lit(batch).alias("asked_in"), S.id_bucket(F.col("evidence_id")).alias("id_bucket"))
    segment, seen = S.write_segment(fresh, path), {s.name for s in snap.segments}
    while segment.files:
        latest = S.snapshot(spark, path)
        since = {s.name for s in latest.segments} - seen
        if since:
            theirs = _held(latest.only(since), fresh.select("evidence_id")).select("evidence_id")
            mine = fresh.join(theirs, "evidence_id", "left_anti").select(CACHE_SCHEMA.names)
            n = mine.count()
            if n < segment.rows:
                S.drop_segment(spark, path, segment.name)
                segment = S.write_segment(mine, path, n=n)
            seen |= since
        if not segment.files or S.commit(spark, latest, [segment]):
            break
    replies = _stored(_held(S.snapshot(spark, path), keys).join(keys, "evidence_id", "left_semi"), "replies")
    found = replies.select(F.col("evidence_id").alias("key"), "response", "asked_in")
    return rows.drop("prompt").join(found, "key", "left").select("evidence_id", "kind", "key", "response", "asked_in")
