"""Driver queries for the cleaner operators C0-C15 and E1/E2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.functions import cleaner as C
from unveil.functions import fixed
from unveil.operators import evaluation as E
from unveil.operators.planting import planted
from unveil.plans.common import blen, bsize, joined_hash, planted_cleaned, sha, spread
from unveil.plans.registry import register
from unveil.plans.sqltext import (
    advisory_list,
    conclusive_list,
    planted_clean_with,
    q,
)
from unveil.sources.tables import table

SEP_SQL = "chr(1)"


def _hash_list(x: str) -> str:
    return f"sha256(array_to_string({x}, {SEP_SQL}))"


# --------------------------------------------------------------------------
# C0 null guard
# --------------------------------------------------------------------------

@register(
    "c0_null_guard",
    planted_clean_with()
    + f"""SELECT evidence_id, text IS NULL AS text_is_null, length(t0) AS guarded_len,
       CAST(len(list_filter(removed, lambda e: e.category = {q(fixed.CAT_INPUT_WAS_NONE)})) AS BIGINT) AS n_none_entries
FROM cleaned""",
)
def c0_null_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = planted_cleaned(spark, sf_dir, keep_stages=True, render=False)
    return d.select(
        "evidence_id",
        F.col("text").isNull().alias("text_is_null"),
        blen(F.col("_t0")).alias("guarded_len"),
        bsize(F.filter("removed", lambda e: e["category"] == fixed.CAT_INPUT_WAS_NONE)).alias(
            "n_none_entries"
        ),
    )


# --------------------------------------------------------------------------
# C1 on the real pages table
# --------------------------------------------------------------------------

@register(
    "c1_html_comments",
    f"""SELECT page_id,
       CAST(len(regexp_extract_all(html, {q(fixed.HTML_COMMENT)})) AS BIGINT) AS n_comments,
       length(regexp_replace(html, {q(fixed.HTML_COMMENT)}, '', 'g')) AS stripped_len,
       sha256(regexp_replace(html, {q(fixed.HTML_COMMENT)}, '', 'g')) AS stripped_hash
FROM pages""",
)
def c1_html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    out, log = C.c1_html_comments(F.coalesce(F.col("html"), F.lit("")))
    d = pages.select("page_id", out.alias("stripped"), log.alias("log"))
    return d.select(
        "page_id",
        F.coalesce(F.try_element_at("log", F.lit(1))["n"], F.lit(0)).cast("bigint").alias("n_comments"),
        blen(F.col("stripped")).alias("stripped_len"),
        sha(F.col("stripped")).alias("stripped_hash"),
    )


# --------------------------------------------------------------------------
# C2..C9: stage outputs inside the full chain
# --------------------------------------------------------------------------

def _stage(spark, sf_dir, cols) -> DataFrame:
    d = planted_cleaned(spark, sf_dir, keep_stages=True, render=False)
    return d.select("evidence_id", *cols(d))


def _entries(cat: str):
    return F.filter("removed", lambda e: e["category"] == cat)


def _entries_sql(cat: str) -> str:
    return f"list_filter(removed, lambda e: e.category = {q(cat)})"


@register(
    "c2_hidden_styled",
    planted_clean_with()
    + f"""SELECT evidence_id, CAST(len(p2) AS BIGINT) AS n_hidden,
       {_hash_list('p2')} AS payload_hash, sha256(t2) AS text_hash
FROM cleaned""",
)
def c2_hidden_styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, lambda d: [
        bsize(_entries(fixed.CAT_HIDDEN_STYLED)).alias("n_hidden"),
        joined_hash(F.transform(_entries(fixed.CAT_HIDDEN_STYLED), lambda e: e["payload"])).alias(
            "payload_hash"
        ),
        sha(F.col("_t2")).alias("text_hash"),
    ])


@register(
    "c3_image_alt",
    planted_clean_with()
    + f"""SELECT evidence_id,
       CAST(len(p3) AS BIGINT) AS n_images,
       CAST(len({_entries_sql(fixed.CAT_IMAGE_ALT)}) AS BIGINT) AS n_logged,
       {_hash_list(f"list_transform({_entries_sql(fixed.CAT_IMAGE_ALT)}, lambda e: e.payload)")} AS alt_hash,
       sha256(t3) AS text_hash
FROM cleaned""",
)
def c3_image_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, lambda d: [
        bsize(C.c3_alts(F.col("_t2"))).alias("n_images"),
        bsize(_entries(fixed.CAT_IMAGE_ALT)).alias("n_logged"),
        joined_hash(F.transform(_entries(fixed.CAT_IMAGE_ALT), lambda e: e["payload"])).alias("alt_hash"),
        sha(F.col("_t3")).alias("text_hash"),
    ])


def _count_of(cat: str):
    return F.coalesce(F.try_element_at(_entries(cat), F.lit(1))["n"], F.lit(0)).cast("bigint")


def _count_of_sql(cat: str) -> str:
    return f"CAST(coalesce({_entries_sql(cat)}[1].n, 0) AS BIGINT)"


@register(
    "c4_zero_width",
    planted_clean_with()
    + f"""SELECT evidence_id, {_count_of_sql(fixed.CAT_ZERO_WIDTH)} AS n_zero_width,
       sha256(t4) AS text_hash FROM cleaned""",
)
def c4_zero_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, lambda d: [
        _count_of(fixed.CAT_ZERO_WIDTH).alias("n_zero_width"),
        sha(F.col("_t4")).alias("text_hash"),
    ])


@register(
    "c5_invisible_controls",
    planted_clean_with()
    + f"""SELECT evidence_id, {_count_of_sql(fixed.CAT_INVISIBLE_CONTROL)} AS n_controls,
       sha256(t5) AS text_hash FROM cleaned""",
)
def c5_invisible_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, lambda d: [
        _count_of(fixed.CAT_INVISIBLE_CONTROL).alias("n_controls"),
        sha(F.col("_t5")).alias("text_hash"),
    ])


@register(
    "c6_nfkc",
    planted_clean_with()
    + f"""SELECT evidence_id, len({_entries_sql(fixed.CAT_UNICODE_NORMALIZED)}) > 0 AS normalized,
       sha256(t6) AS text_hash FROM cleaned""",
)
def c6_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, lambda d: [
        (F.size(_entries(fixed.CAT_UNICODE_NORMALIZED)) > 0).alias("normalized"),
        sha(F.col("_t6")).alias("text_hash"),
    ])


@register(
    "c7_role_labels",
    planted_clean_with()
    + f"""SELECT evidence_id, CAST(len(p7) AS BIGINT) AS n_labels,
       {_hash_list("list_transform(p7, lambda m: trim(m, " + q(fixed.WHITESPACE_CHARS) + "))")} AS labels_hash,
       sha256(t7) AS text_hash FROM cleaned""",
)
def c7_role_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, lambda d: [
        bsize(C.c7_labels(F.col("_t6"))).alias("n_labels"),
        joined_hash(F.transform(C.c7_labels(F.col("_t6")), C.py_strip)).alias("labels_hash"),
        sha(F.col("_t7")).alias("text_hash"),
    ])


@register(
    "c8_role_brackets",
    planted_clean_with()
    + f"""SELECT evidence_id, CAST(len(p8) AS BIGINT) AS n_brackets,
       {_hash_list('p8')} AS brackets_hash, sha256(t8) AS text_hash FROM cleaned""",
)
def c8_role_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, lambda d: [
        bsize(C.c8_brackets(F.col("_t7"))).alias("n_brackets"),
        joined_hash(C.c8_brackets(F.col("_t7"))).alias("brackets_hash"),
        sha(F.col("_t8")).alias("text_hash"),
    ])


@register(
    "c9_tidy",
    planted_clean_with()
    + """SELECT evidence_id, length(cleaned_text) AS cleaned_len, sha256(cleaned_text) AS cleaned_hash
FROM cleaned""",
)
def c9_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, lambda d: [
        blen(F.col("cleaned_text")).alias("cleaned_len"),
        sha(F.col("cleaned_text")).alias("cleaned_hash"),
    ])


@register(
    "c10_clean",
    planted_clean_with()
    + """SELECT evidence_id, sha256(cleaned_text) AS cleaned_hash,
       CAST(len(removed) AS BIGINT) AS n_removed FROM cleaned""",
)
def c10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = planted_cleaned(spark, sf_dir)
    return d.select(
        "evidence_id", sha(F.col("cleaned_text")).alias("cleaned_hash"), bsize(F.col("removed")).alias("n_removed")
    )


# --------------------------------------------------------------------------
# C11..C15 over the log (long tables)
# --------------------------------------------------------------------------

@register(
    "c11_removal_log",
    planted_clean_with()
    + """SELECT evidence_id, e.seq AS seq, e.category AS category, e.n AS n, e.payload AS payload
FROM (SELECT evidence_id, unnest(removed) AS e FROM cleaned)""",
)
def c11_removal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = planted_cleaned(spark, sf_dir)
    return d.select("evidence_id", F.explode("removed").alias("e")).select(
        "evidence_id", "e.seq", "e.category", "e.n", "e.payload"
    )


def _items_long(d: DataFrame, col: str = "removed_items") -> DataFrame:
    return d.select("evidence_id", F.posexplode(col).alias("pos", "item")).select(
        "evidence_id", (F.col("pos") + 1).alias("seq"), "item"
    )


_ITEMS_LONG_SQL = """SELECT evidence_id, CAST(i AS INTEGER) AS seq, {x}[i] AS item
FROM (SELECT evidence_id, {x}, unnest(range(1, len({x}) + 1)) AS i FROM cleaned)"""


@register("c12_rendered_log", planted_clean_with() + _ITEMS_LONG_SQL.format(x="removed_items"))
def c12_rendered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items_long(planted_cleaned(spark, sf_dir))


@register(
    "c13_category_of",
    planted_clean_with()
    + """SELECT evidence_id, seq, split_part(item, ':', 1) AS category FROM ("""
    + _ITEMS_LONG_SQL.format(x="removed_items")
    + ")",
)
def c13_category_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _items_long(planted_cleaned(spark, sf_dir))
    return d.select("evidence_id", "seq", C.category_of(F.col("item")).alias("category"))


@register(
    "c14_conclusive",
    planted_clean_with()
    + f"""SELECT evidence_id, CAST(len({conclusive_list('removed_items')}) AS BIGINT) AS n_conclusive,
       len({conclusive_list('removed_items')}) > 0 AS conclusive FROM cleaned""",
)
def c14_conclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = planted_cleaned(spark, sf_dir)
    items = C.conclusive_items(F.col("removed_items"))
    return d.select("evidence_id", bsize(items).alias("n_conclusive"), (F.size(items) > 0).alias("conclusive"))


@register(
    "c15_advisory",
    planted_clean_with(f"adv AS (SELECT evidence_id, {advisory_list('removed_items')} AS advisory FROM cleaned)")
    + """SELECT evidence_id, CAST(i AS INTEGER) AS seq, advisory[i] AS item
FROM (SELECT evidence_id, advisory, unnest(range(1, len(advisory) + 1)) AS i FROM adv)""",
)
def c15_advisory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = planted_cleaned(spark, sf_dir).select(
        "evidence_id", C.advisory_items(F.col("removed_items")).alias("advisory")
    )
    return _items_long(d, "advisory")


# --------------------------------------------------------------------------
# E1, E2
# --------------------------------------------------------------------------

from unveil.operators.planting import planted_sql  # noqa: E402


@register(
    "e1_planted_counts",
    f"""SELECT technique, is_attack, CAST(count(*) AS BIGINT) AS docs,
       CAST(count(text) AS BIGINT) AS with_text,
       CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS total_chars
FROM ({planted_sql()}) GROUP BY technique, is_attack""",
)
def e1_planted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.planted_counts(planted(spark, sf_dir))


@register(
    "e2_detection_matrix",
    planted_clean_with()
    + f"""SELECT technique, CAST(GROUPING(technique) AS INTEGER) AS is_total,
       CAST(count(*) AS BIGINT) AS docs,
       CAST(count_if(len(removed) > 0) AS BIGINT) AS caught,
       CAST(count_if(len({conclusive_list('removed_items')}) > 0) AS BIGINT) AS conclusive,
       CAST(count_if(cleaned_text <> trim(coalesce(text, ''), {q(fixed.WHITESPACE_CHARS)})) AS BIGINT) AS altered
FROM cleaned GROUP BY ROLLUP (technique)""",
)
def e2_detection_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.detection_matrix(planted_cleaned(spark, sf_dir))
