"""Registered queries of the training-data operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.llm import alignment, context_tree, decontamination, fingerprints, hard_negatives, languages, mixing, packing, personal_data, token_files, toxicity, vectors
from unveil.llm.near_dedup import near_duplicates
from unveil.llm.shared import id_fold, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return deco


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5
    THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 85 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM reach r JOIN both_ways l ON l.x = r.node WHERE r.root < l.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(r.root AS BIGINT) AS component_id, s.doc_id = r.root AS kept
FROM sets s JOIN (SELECT node, min(root) AS root FROM reach GROUP BY 1) r ON r.node = s.doc_id
"""


@query("op2_near_duplicates", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_language_mixtures")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = id_fold(F.col("doc_id"), 5)
    model = languages.learn(docs.where(fold != 0))
    held = docs.select("doc_id", "text", (fold == 0).alias("held_out"))
    return languages.identify(held, model).select("doc_id", "held_out", "lang_pred", "score", "languages")


@query("op1_toxicity_nnpu")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    fold = id_fold(F.col("doc_id"), 5)
    model = toxicity.learn(docs.where(fold != 0), labels.where(fold != 0))
    return toxicity.score(docs.select("doc_id", "text", (fold == 0).alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


@query("op4_prefix_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE per AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY 1),
whole AS (SELECT sum(sqrt(CAST(chars AS DOUBLE))) AS w, CAST(sum(chars) AS DOUBLE) AS total FROM per),
rates AS (SELECT source, CASE WHEN chars > 0 THEN sqrt(CAST(chars AS DOUBLE)) / w * total * 1.0 / chars ELSE 0.0 END AS rate FROM per, whole),
terms(source, rate, k, p, cdf) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM terms WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
drawn AS (
  SELECT *, CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
counted AS (
  SELECT d.*, CAST((SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.cdf <= d.u) AS INTEGER) AS n_copies FROM drawn d),
copies AS (SELECT doc_id, text, lang, source, n_chars, n_copies, CAST(unnest(generate_series(1, n_copies)) AS INTEGER) AS copy_no FROM counted WHERE n_copies > 0)
SELECT *, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy_no) AS shuffle_key FROM copies
"""


@query("op3_poisson_mix", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


OP9_SQL = """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM good q JOIN good c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


@query("op9_rotated_codes", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_huffman_tokens")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_context_tree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = context_tree.score_texts(docs, id_fold(F.col("doc_id"), 10) != 0)
    return out.select("doc_id", (~F.col("is_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP11_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width, unnest(list_transform(generate_series(1, len(w) - least(len(w), 10) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM items WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT doc_id, width, w, unnest(generate_series(1, len(w) - width + 1)) AS pos FROM low, widths WHERE len(w) >= width),
grams AS (SELECT doc_id, width, pos, array_to_string(w[pos:pos + width - 1], ' ') AS g FROM places),
found AS (SELECT x.doc_id, x.pos, x.width, y.item_id FROM grams x JOIN windows y USING (width, g)),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + width - 1)) AS p FROM found) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1),
linked AS (
  SELECT DISTINCT x.doc_id, x.pos AS d_at, x.item_id, i.pos AS i_at, x.width FROM found x
  JOIN (SELECT item_id, width, unnest(generate_series(1, len(w) - width + 1)) AS pos, w FROM (SELECT item_id, least(len(w), 10) AS width, w FROM items WHERE len(w) > 0)) i
    ON i.item_id = x.item_id AND i.width = x.width
  JOIN low d ON d.doc_id = x.doc_id WHERE i.w[i.pos:i.pos + x.width - 1] = d.w[x.pos:x.pos + x.width - 1]),
reach AS (
  SELECT l.doc_id, l.d_at, l.item_id, l.width + coalesce(
    list_position(list_transform(generate_series(0, greatest(len(d.w) - l.d_at, len(i.w) - l.i_at) + 1),
      lambda k: coalesce(d.w[CAST(l.d_at + l.width + k AS BIGINT)] = i.w[CAST(l.i_at + l.width + k AS BIGINT)], false)), false) - 1, 0) AS n
  FROM linked l JOIN low d ON d.doc_id = l.doc_id JOIN items i ON i.item_id = l.item_id),
best AS (
  SELECT doc_id, n, d_at, item_id FROM reach
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, d_at, CAST(item_id AS VARCHAR)) = 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated,
  CAST(coalesce(b.n, 0) AS INTEGER) AS longest, CAST(b.d_at - 1 AS BIGINT) AS longest_at, CAST(b.item_id AS VARCHAR) AS longest_item
FROM low w LEFT JOIN hits h USING (doc_id) LEFT JOIN named m USING (doc_id) LEFT JOIN best b USING (doc_id)
"""


@query("op11_suffix_decontamination", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM good a JOIN good c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, label=moved)


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return alignment.report(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
