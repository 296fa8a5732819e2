"""Driver queries for the evaluation reports (E3-E8) and the S1 scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.operators import evaluation as E
from unveil.operators.planting import planted
from unveil.plans.common import blen, planted_cleaned, sha
from unveil.plans.ledger_queries import PANEL_SQL
from unveil.plans.standins import synthetic_panel
from unveil.plans.pipeline_queries import planted_verdicts
from unveil.plans.registry import register
from unveil.plans.sqltext import pipeline_with, planted_clean_with, q
from unveil.session import work_path
from unveil.sources.tables import evidence_union, one_file_each, strict_text_corpus, table
from unveil.functions import fixed


def _pinned_sql() -> str:
    rows = ", ".join(
        f"({q(t)}, [{', '.join(q(x) for x in items)}])" for t, items in E.PINNED_FALSE_POSITIVES.items()
    )
    return f"pinned(technique, expected) AS (VALUES {rows})"


@register(
    "e3_false_positives",
    planted_clean_with(_pinned_sql())
    + """SELECT c.evidence_id, c.technique, CAST(len(c.removed_items) AS BIGINT) AS n_removed,
       p.expected IS NOT NULL AS pinned, coalesce(c.removed_items = p.expected, FALSE) AS exact_match
FROM cleaned c LEFT JOIN pinned p ON c.technique = p.technique
WHERE NOT c.is_attack AND len(c.removed_items) > 0""",
)
def e3_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.false_positives(planted_cleaned(spark, sf_dir))


@register(
    "e4_unchanged",
    planted_clean_with()
    + f"""SELECT technique, is_attack, CAST(count(*) AS BIGINT) AS docs,
       CAST(count_if(cleaned_text = trim(coalesce(text, ''), {q(fixed.WHITESPACE_CHARS)})) AS BIGINT) AS unchanged
FROM cleaned GROUP BY technique, is_attack""",
)
def e4_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.unchanged(planted_cleaned(spark, sf_dir))


def _lists_sql() -> str:
    rows = ", ".join(f"({q(t)}, {q(lst)})" for lst, ts in E.TECHNIQUE_LISTS.items() for t in ts)
    return f"lists(technique, list) AS (VALUES {rows})"


def _e5_sql() -> str:
    from unveil.operators.planting import planted_sql

    return f"""WITH planted AS ({planted_sql()}), {_lists_sql()},
per_tech AS (SELECT technique, CAST(count(*) AS BIGINT) AS n_lists, min(list) AS list FROM lists GROUP BY technique),
seen AS (SELECT technique, CAST(count(*) AS BIGINT) AS docs FROM planted GROUP BY technique)
SELECT coalesce(s.technique, p.technique) AS technique, coalesce(s.docs, 0) AS docs,
       coalesce(p.n_lists, 0) AS n_lists, p.list,
       CASE WHEN s.docs IS NULL THEN 'not_in_corpus' WHEN p.n_lists IS NULL THEN 'unclassified'
            WHEN p.n_lists > 1 THEN 'multiply_classified' ELSE 'ok' END AS status
FROM seen s FULL OUTER JOIN per_tech p ON s.technique = p.technique"""


@register("e5_label_completeness", _e5_sql())
def e5_label_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_completeness(planted(spark, sf_dir))


@register(
    "e7_judge_reliability",
    pipeline_with(PANEL_SQL)
    + """SELECT p.judge_id, CAST(count(*) AS BIGINT) AS readings, CAST(count_if(p.canary_leaked) AS BIGINT) AS leaked,
       CAST(count_if(NOT v.conclusive AND NOT p.injection_detected AND p.canary_leaked) AS BIGINT) AS unreliable_clean
FROM panel p LEFT JOIN verdict v ON p.evidence_id = v.evidence_id
WHERE p.status = 'success' GROUP BY p.judge_id""",
)
def e7_judge_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.judge_reliability(synthetic_panel(planted_verdicts(spark, sf_dir)))


@register(
    "e8_removal_census",
    planted_clean_with()
    + """SELECT source, category, CAST(GROUPING(source) * 2 + GROUPING(category) AS INTEGER) AS level,
       CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT evidence_id) AS BIGINT) AS docs
FROM (SELECT evidence_id, source, unnest(removed).category AS category FROM cleaned)
GROUP BY CUBE (source, category)""",
)
def e8_removal_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.removal_census(planted_cleaned(spark, sf_dir, render=False))


@register(
    "e8_top_categories",
    planted_clean_with()
    + """SELECT category, CAST(count(*) AS BIGINT) AS entries
FROM (SELECT unnest(removed).category AS category FROM cleaned)
GROUP BY category ORDER BY entries DESC, category LIMIT 3""",
)
def e8_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_categories(planted_cleaned(spark, sf_dir, render=False), 3)


@register(
    "s1_corpus_scan",
    """SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS evidence_id, 'documents' AS origin, length(text) AS text_len, sha256(text) AS text_hash FROM documents
UNION ALL SELECT 'page-' || CAST(page_id AS VARCHAR), 'pages', length(html), sha256(html) FROM pages
UNION ALL SELECT 'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 'conversations', length(text), sha256(text) FROM conversations""",
)
def s1_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evidence_union(spark, sf_dir)
    return ev.select("evidence_id", "origin", blen(F.col("text")).alias("text_len"), sha(F.col("text")).alias("text_hash"))


@register(
    "s1_strict_corpus",
    """SELECT 'doc=' || CAST(doc_id AS VARCHAR) AS label, CASE WHEN doc_id % 50 IN (7, 8) THEN 'not_utf8' ELSE 'kept' END AS state,
       CASE WHEN doc_id % 50 NOT IN (7, 8) THEN sha256(coalesce(text, '') || CASE WHEN doc_id % 50 = 9 THEN chr(233) ELSE '' END || chr(10)) END AS text_hash
FROM documents""",
)
def s1_strict_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as one file each, some with bytes that are no UTF-8 at the end, read strictly."""
    tail = {7: "FF", 8: "C3", 9: "C3A9"}
    kind = F.col("doc_id") % 50
    more = F.unhex(F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in tail.items()], F.lit("")))
    body = F.concat(F.coalesce("text", F.lit("")).cast("binary"), more, F.lit(b"\n"))
    root = work_path(spark, "one-file-each")
    one_file_each(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), body.alias("body")), root)
    corpus, quarantine = strict_text_corpus(spark, root)
    kept = corpus.select("label", F.lit("kept").alias("state"), sha(F.col("text")).alias("text_hash"))
    return kept.unionByName(quarantine.select("label", F.col("reason").alias("state"), F.lit(None).cast("string").alias("text_hash")))


@register(
    "e6_parity_diff",
    "SELECT CAST(0 AS BIGINT) AS native_only, CAST(0 AS BIGINT) AS python_only, CAST(count(*) AS BIGINT) AS rows FROM documents",
)
def e6_parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native chain vs the independent row-wise scanner over the planted table."""
    from unveil.plans.common import spread

    src = spread(planted(spark, sf_dir), "evidence_id")
    native = planted_cleaned(spark, sf_dir)
    return E.parity_diff(native, E.python_clean(src))


@register(
    "e8_categories_per_doc",
    planted_clean_with()
    + """SELECT CAST(len(list_distinct(list_transform(removed, lambda e: e.category))) AS BIGINT) AS n_categories,
       CAST(count(*) AS BIGINT) AS docs FROM cleaned GROUP BY 1""",
)
def e8_categories_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.categories_per_document(planted_cleaned(spark, sf_dir, render=False))
