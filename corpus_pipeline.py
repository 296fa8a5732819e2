"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``; all but the last return
the columns that they were given. Each stage's docstring says what becomes of
nulls, empty texts, ties, repeated rows and clashing names; an empty table gives an empty one everywhere.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.llm import languages, mixing, packing, personal_data
from unveil.llm.near_dedup import near_duplicates
from unveil.llm.shared import stored, text_of
from unveil.llm.textblocks import blocks, has_letter
from unveil.session import ship_package

NEAR = 80

# the model, the replication draw and the packing shards are not SQL
ORACLE_SQL = None


def _with_letter(docs: DataFrame) -> DataFrame:
    """The rows whose text holds a letter."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch, "__text"):
                yield rows.filter(pa.array(has_letter(rows.column(place), data, offsets))).select(names)

    names, place = docs.columns, len(docs.columns)
    return docs.select(*names, text_of().alias("__text")).mapInArrow(run, docs.schema)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language; a null ``lang`` takes the predicted one.

    Where no row has a ``lang`` to learn from, only texts without a letter are dropped.
    Null and empty texts have none and go; null ids and repeated rows stay as they are. Other columns are not touched.
    """
    ship_package(spark)
    model = languages.learn(docs)
    if not model[0]:
        return _with_letter(docs)
    named = languages.identify(docs, model, pred="__pred", score="__score", mix="__mix")
    kept = named.where(F.col("__pred") != languages.UNKNOWN)
    return kept.select(*[F.coalesce("lang", "__pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate class, linked from NEAR percent of five-word shingles.

    Null, empty and word-less texts are alike to nothing and stay.
    Different texts under one id are documents of their own here; of rows that
    repeat both id and text one is kept. Rows with a null id are all kept.
    """
    ship_package(spark)
    again = stored(docs.groupBy(F.col("doc_id").cast("bigint").alias("__id")).count().where("count > 1 and __id is not null").select("__id"), "repeated-ids")
    if not again.head(1):
        gone = stored(near_duplicates(docs, NEAR).where("not kept").select("doc_id"), "gone")
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    marked = docs.withColumn("__id", F.col("doc_id").cast("bigint")).join(again.withColumn("__again", F.lit(True)), "__id", "left")
    keyed = marked.withColumn("__key", F.when(F.col("__again"), F.xxhash64("__id", text_of())).otherwise(F.col("__id")))
    classes = near_duplicates(keyed, NEAR, doc_id="__key").where("doc_id is not null").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    members = keyed.where("__key is not null").select("__key", "__id").distinct()
    versions = stored(classes.join(members, "__key"), "versions-of-docs")
    least = versions.groupBy("component_id").agg(F.min(F.struct("__id", "__key")).alias("least")).select("least.__key")
    gone = stored(versions.join(least, "__key", "left_anti").select("__key").distinct(), "gone")
    rest = keyed.join(gone.hint("merge"), "__key", "left_anti")
    once = rest.where("__again").dropDuplicates(["__key"]).select(docs.columns)
    return rest.where("__again is null").select(docs.columns).unionByName(once)


def personal_data_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every personal identifier found in a text by its kind in brackets.

    Every row stays; null texts stay null and empty ones empty. Repeated rows and null ids are rows like others.
    """
    ship_package(spark)
    return personal_data.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents to the target source weights, in shuffled order.

    A row's count follows from its id and source, so repeated rows get equal
    counts and a null id counts as ''. A null source is a source of its own; null and
    empty texts take part. Columns that bear the names of the operator's own come back as they were given.
    """
    aside = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c in ("copy_no", "n_copies", "shuffle_key")}
    mixed = mixing.mix(docs.withColumnsRenamed(aside))
    return mixed.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every byte of every document, and an end mark each, in sequences of the permitted lengths.

    Null and empty texts are an end mark; repeated rows are packed as often as they
    stand there. Only ids and text lengths are read.
    """
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data_removal),
    ("source_mix", source_mix),
    ("best_fit", best_fit),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with what each keeps written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
