"""Evaluation reports over a labelled, cleaned corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unveil.functions.cleaner import conclusive_items, py_strip


def _n(cond) -> F.Column:
    return F.count_if(cond).cast("bigint")


def planted_counts(planted: DataFrame) -> DataFrame:
    """E1 summary: documents per planted technique."""
    return planted.groupBy("technique", "is_attack").agg(
        F.count(F.lit(1)).cast("bigint").alias("docs"),
        F.count("text").cast("bigint").alias("with_text"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).cast("bigint").alias("total_chars"),
    )


def detection_matrix(cleaned: DataFrame) -> DataFrame:
    """Per technique (plus a rollup total): caught, conclusive, altered.

    One partial aggregate per task, then a tiny shuffle of per-technique
    counters: a technique holding a third of all rows costs nothing extra.
    """
    flags = cleaned.select(
        "technique",
        (F.size("removed") > 0).alias("caught"),
        (F.size(conclusive_items(F.col("removed_items"))) > 0).alias("conclusive"),
        (F.col("cleaned_text") != py_strip(F.coalesce("text", F.lit("")))).alias("altered"),
    )
    return flags.rollup("technique").agg(
        F.grouping("technique").cast("int").alias("is_total"),
        F.count(F.lit(1)).cast("bigint").alias("docs"),
        _n(F.col("caught")).alias("caught"),
        _n(F.col("conclusive")).alias("conclusive"),
        _n(F.col("altered")).alias("altered"),
    )


# Which list each planted technique belongs to (E5). A technique in no list
# or in several is a classification error.
TECHNIQUE_LISTS = {
    "caught": (
        "zero_width_chars", "html_comment", "white_span", "display_none_div", "font_size_zero_span",
        "image_alt_text", "fake_system_role", "fake_instruction_header", "inst_bracket", "bidi_override",
        "fullwidth_role_label", "soft_hyphen", "tag_characters",
    ),
    "missed": ("base64_encoded", "split_across_lines", "foreign_language"),
    "clean": ("blank_alt_image", "benign_instructions_header", "untouched", "null_text"),
}

# Clean documents the cleaner is known to alter, with the exact log.
PINNED_FALSE_POSITIVES = {
    "benign_instructions_header": ["fake_role_label:'Instructions:'"],
    "null_text": ["input_was_none"],
}


def false_positives(cleaned: DataFrame) -> DataFrame:
    """Clean documents with any removal, flagged pinned / exact match.

    The pinned-exception table is a literal of a few rows (bounded size),
    so it is broadcast explicitly.
    """
    spark = cleaned.sparkSession
    pinned = F.broadcast(
        spark.createDataFrame(list(PINNED_FALSE_POSITIVES.items()), "technique string, expected array<string>")
    )
    fp = cleaned.where(~F.col("is_attack") & (F.size("removed_items") > 0))
    j = fp.join(pinned, "technique", "left")
    return j.select(
        "evidence_id",
        "technique",
        F.size("removed_items").cast("bigint").alias("n_removed"),
        F.col("expected").isNotNull().alias("pinned"),
        F.coalesce(F.col("removed_items") == F.col("expected"), F.lit(False)).alias("exact_match"),
    )


def unchanged(cleaned: DataFrame) -> DataFrame:
    """Per technique, documents whose cleaned text equals the stripped original."""
    same = F.col("cleaned_text") == py_strip(F.coalesce("text", F.lit("")))
    return cleaned.groupBy("technique", "is_attack").agg(
        F.count(F.lit(1)).cast("bigint").alias("docs"),
        _n(same).alias("unchanged"),
    )


def label_completeness(planted: DataFrame) -> DataFrame:
    """E5: every technique in the corpus is in exactly one list, and vice versa."""
    spark = planted.sparkSession
    rows = [(t, lst) for lst, ts in TECHNIQUE_LISTS.items() for t in ts]
    lists = spark.createDataFrame(rows, "technique string, list string")
    per_tech = lists.groupBy("technique").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_lists"), F.min("list").alias("list")
    )
    seen = planted.groupBy("technique").agg(F.count(F.lit(1)).cast("bigint").alias("docs"))
    j = seen.join(per_tech, "technique", "full_outer")
    status = (
        F.when(F.col("docs").isNull(), F.lit("not_in_corpus"))
        .when(F.col("n_lists").isNull(), F.lit("unclassified"))
        .when(F.col("n_lists") > 1, F.lit("multiply_classified"))
        .otherwise(F.lit("ok"))
    )
    return j.select(
        "technique",
        F.coalesce("docs", F.lit(0)).cast("bigint").alias("docs"),
        F.coalesce("n_lists", F.lit(0)).cast("bigint").alias("n_lists"),
        "list",
        status.alias("status"),
    )


def judge_reliability(panel: DataFrame) -> DataFrame:
    """Per judge, canary leaks and clean-but-unreliable readings.

    ``conclusive`` (from the cleaner) travels with the panel rows, so this is
    one partial aggregate and no join.
    """
    j = panel.where(F.col("status") == "success")
    unreliable_clean = ~F.col("conclusive") & ~F.col("injection_detected") & F.col("canary_leaked")
    return j.groupBy("judge_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("readings"),
        _n(F.col("canary_leaked")).alias("leaked"),
        _n(unreliable_clean).alias("unreliable_clean"),
    )


def removal_census(cleaned: DataFrame) -> DataFrame:
    """Entries and documents per (source, category), with cube totals.

    ``removed`` is one array per document, so a document gives one row for
    each of its categories and one for its total; counting rows then counts
    documents, and neither ids nor a cube over the entries is needed. The
    totals over sources come from the small per-source table.
    """
    log = F.col("removed.category")

    def row(category, entries):
        return F.struct(category.alias("category"), category.isNull().cast("int").alias("is_total"), entries.cast("bigint").alias("entries"))

    per_category = F.transform(F.array_distinct(log), lambda c: row(c, F.size(F.filter(log, lambda x: x == c))))
    rows = F.concat(per_category, F.array(row(F.lit(None).cast("string"), F.size(log))))
    exploded = cleaned.where(F.size("removed") > 0).select("source", F.inline(rows))
    sums = [F.sum("entries").alias("entries"), F.sum("docs").alias("docs")]
    by_source = exploded.withColumn("docs", F.lit(1).cast("bigint")).groupBy("source", "category", "is_total").agg(*sums)
    overall = by_source.groupBy("category", "is_total").agg(*sums).select(F.lit(None).cast("string").alias("source"), "*")
    return by_source.select("source", "category", F.col("is_total").alias("level"), "entries", "docs").unionByName(
        overall.select("source", "category", (F.col("is_total") + 2).alias("level"), "entries", "docs")
    )


def categories_per_document(cleaned: DataFrame) -> DataFrame:
    """How many distinct removal categories each document tripped ("several
    strips are more suspicious than one"), as a histogram."""
    n = F.size(F.array_distinct(F.col("removed.category"))).cast("bigint")
    return cleaned.select(n.alias("n_categories")).groupBy("n_categories").agg(
        F.count(F.lit(1)).cast("bigint").alias("docs")
    )


def top_categories(cleaned: DataFrame, k: int = 3) -> DataFrame:
    """E8 top-k: the k most frequent removal categories (the limit is the feature)."""
    e = cleaned.select(F.explode("removed.category").alias("category"))
    return e.groupBy("category").agg(F.count(F.lit(1)).cast("bigint").alias("entries")).orderBy(
        F.desc("entries"), "category"
    ).limit(k)


def python_clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The row-wise Python cleaner over Arrow batches (parity path, slow)."""
    from unveil.session import ship_package

    ship_package(df.sparkSession)

    def run(batches):
        from unveil.functions.rowwise import clean_row

        for pdf in batches:
            res = [clean_row(None if t is None else str(t)) for t in pdf[text_col]]
            yield pdf[["evidence_id"]].assign(
                cleaned_text=[r[0] for r in res], removed_items=[r[1] for r in res]
            )

    return df.select("evidence_id", text_col).mapInPandas(
        run, "evidence_id string, cleaned_text string, removed_items array<string>"
    )


def parity_diff(native: DataFrame, python: DataFrame) -> DataFrame:
    """Rows present in one cleaner output and not the other, both ways.

    Each side becomes one digest a row; equal rows meet in a partial aggregate
    on (evidence_id, digest), so no text is shuffled and either side runs once.
    """
    digest = F.sha2(F.to_json(F.struct("cleaned_text", "removed_items")), 256)

    def side(df, n, p):
        return df.select("evidence_id", digest.alias("digest"), F.lit(n).alias("n"), F.lit(p).alias("p"))

    met = side(native, 1, 0).unionByName(side(python, 0, 1)).groupBy("evidence_id", "digest").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return met.agg(
        total(F.greatest(F.col("n") - F.col("p"), F.lit(0))).alias("native_only"),
        total(F.greatest(F.col("p") - F.col("n"), F.lit(0))).alias("python_only"),
        total(F.col("n")).alias("rows"),
    )
