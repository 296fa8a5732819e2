"""Driver queries for canary (T1-T5), judge (J1-J8) and pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.functions import fixed
from unveil.functions import judge as J
from unveil.operators.pipeline import prepare, prompt_table, replies_by_evidence, score_join, screen, verdicts
from unveil.operators.planting import planted
from unveil.operators.reply_cache import answer
from unveil.operators.responses import table_scorer
from unveil.plans.common import SEP, blen, bsize, sha, spread, stored
from unveil.plans.registry import register
from unveil.plans.standins import stub_responses, stub_scorer, text_model, text_model_sql
from unveil.plans.sqltext import label_key_sql, normalize_sql, pipeline_with, wellformed_sql
from unveil.session import work_path


def planted_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spread(planted(spark, sf_dir), "evidence_id"))


def planted_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(stub_scorer()(planted_prepared(spark, sf_dir)))


W = pipeline_with()


# ------------------------------------------------------------------ canary

@register("t1_seed", W + "SELECT evidence_id, seed FROM prepared")
def t1_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_prepared(spark, sf_dir).select("evidence_id", "seed")


@register(
    "t2_seed_material",
    W + "SELECT evidence_id, sender, scope, CAST(chain_id AS VARCHAR) AS chain_id, sha256(cleaned_text) AS text_hash FROM prepared",
)
def t2_seed_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planted_prepared(spark, sf_dir)
    return p.select("evidence_id", "sender", "scope", F.col("chain_id").cast("string").alias("chain_id"),
                    sha(F.col("cleaned_text")).alias("text_hash"))


@register("t3_canary_word", W + "SELECT evidence_id, canary_word FROM prepared")
def t3_canary_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_prepared(spark, sf_dir).select("evidence_id", "canary_word")


@register("t4_trap", W + "SELECT evidence_id, trap FROM prepared")
def t4_trap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from unveil.functions.canary import trap_sentence

    return planted_prepared(spark, sf_dir).select("evidence_id", trap_sentence(F.col("canary_word")).alias("trap"))


@register("t5_canary_leak", W + "SELECT evidence_id, canary_response, leaked FROM verdict")
def t5_canary_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = planted_verdicts(spark, sf_dir)
    return v.select("evidence_id", "canary_response", F.col("canary_leaked").alias("leaked"))


# ------------------------------------------------------------------ judge

def _parsed(spark, sf_dir) -> DataFrame:
    s = stub_scorer()(planted_prepared(spark, sf_dir))
    return s.select("evidence_id", J.parsed_reply(F.col("detection_response")).alias("p"))


@register(
    "j1_label_key",
    W + f"SELECT evidence_id, well_formed, category_text, "
    f"CASE WHEN well_formed THEN {label_key_sql('category_text')} END AS label_key FROM parsed",
)
def j1_label_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _parsed(spark, sf_dir)
    ok = F.col("p.well_formed")
    return d.select(
        "evidence_id",
        ok.alias("well_formed"),
        F.when(ok, F.col("p.category_text")).alias("category_text"),
        F.when(ok, J.label_key(F.col("p.category_text"))).alias("label_key"),
    )


@register(
    "j2_normalize_category",
    W + f"SELECT evidence_id, {normalize_sql('category_text', 'TRUE')} AS as_detected, "
    f"{normalize_sql('category_text', 'FALSE')} AS as_clean FROM parsed",
)
def j2_normalize_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _parsed(spark, sf_dir)
    raw = F.when(F.col("p.well_formed"), F.col("p.category_text"))
    return d.select(
        "evidence_id",
        J.normalize_category(raw, F.lit(True)).alias("as_detected"),
        J.normalize_category(raw, F.lit(False)).alias("as_clean"),
    )


@register(
    "j3_wellformed",
    W + f"SELECT evidence_id, det AS detected, det_category AS category, "
    f"{wellformed_sql('det_category', 'det')} AS wellformed FROM parsed",
)
def j3_wellformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = planted_verdicts(spark, sf_dir)
    return v.select(
        "evidence_id",
        F.col("model_detected").alias("detected"),
        F.col("model_category").alias("category"),
        J.category_is_wellformed(F.col("model_category"), F.col("model_detected")).alias("wellformed"),
    )


@register(
    "j4_removal_context",
    W + "SELECT evidence_id, CAST(len(advisory_items) AS BIGINT) AS n_advisory, "
    "length(removal_context) AS context_len, sha256(removal_context) AS context_hash FROM prepared",
)
def j4_removal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planted_prepared(spark, sf_dir)
    ctx = J.removal_context(F.col("advisory_items"))
    return p.select("evidence_id", bsize(F.col("advisory_items")).alias("n_advisory"),
                    blen(ctx).alias("context_len"), sha(ctx).alias("context_hash"))


def _prompt_q(col: str):
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = planted_prepared(spark, sf_dir)
        return p.select(
            "evidence_id",
            blen(F.col(col)).alias("prompt_len"),
            sha(F.col(col)).alias("prompt_hash"),
            F.col(col).contains(F.col("canary_word")).alias("holds_word"),
        )

    return fn


for _name, _col in (("j5_detection_prompt", "detection_prompt"), ("j6_canary_prompt", "canary_prompt")):
    register(
        _name,
        W + f"SELECT evidence_id, length({_col}) AS prompt_len, sha256({_col}) AS prompt_hash, "
        f"contains({_col}, canary_word) AS holds_word FROM prepared",
    )(_prompt_q(_col))


@register(
    "j7_parse_response",
    W + """SELECT evidence_id, det AS detected, det_category AS category, doc_id % 3 = 0 AS decoded_detected,
       CASE WHEN doc_id % 3 = 0 THEN 'fake_role' ELSE 'none' END AS decoded_category FROM verdict""",
)
def j7_parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as text, and as the struct that a client library hands over decoded."""
    v = planted_verdicts(spark, sf_dir)
    flag = F.col("doc_id") % 3 == 0
    struct = F.struct(flag.alias("injection_detected"), F.when(flag, F.lit("Role-play")).otherwise(F.lit("none")).alias("category"))
    both = v.select("evidence_id", "model_detected", "model_category", J.parse_response(struct, decoded=True).alias("d"))
    return both.select("evidence_id", F.col("model_detected").alias("detected"), F.col("model_category").alias("category"),
                       F.col("d.detected").alias("decoded_detected"), F.col("d.category").alias("decoded_category"))


_VERDICT5 = "injection_detected, category, judge_reliable, canary_tripped, conclusive_tampering"


@register("j8_verdict", W + f"SELECT evidence_id, {_VERDICT5}, category IN {fixed.FINAL_CATEGORIES} AS accepted FROM verdict")
def j8_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = planted_verdicts(spark, sf_dir)
    return v.select("evidence_id", *[c.strip() for c in _VERDICT5.split(",")], J.category_is_accepted(F.col("category")).alias("accepted"))


# ------------------------------------------------------------------ pipeline

@register(
    "p1_prompt_table",
    W + "SELECT evidence_id, kind, length(prompt) AS prompt_len, sha256(prompt) AS prompt_hash FROM prompts",
)
def p1_prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = prompt_table(planted_prepared(spark, sf_dir))
    return pr.select("evidence_id", "kind", blen(F.col("prompt")).alias("prompt_len"),
                     sha(F.col("prompt")).alias("prompt_hash"))


@register(
    "p2_score_join",
    W + "SELECT p.evidence_id, p.kind, r.response FROM prompts p LEFT JOIN responses r "
    "ON p.evidence_id = r.evidence_id AND p.kind = r.kind",
)
def p2_score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = reply_table(spark, sf_dir)
    kinds = F.explode(F.array(F.lit("detection"), F.lit("canary"))).alias("kind")
    return score_join(planted(spark, sf_dir).select("evidence_id", kinds), responses)


def reply_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written output of a batch-inference job (here the stand-in model)."""
    return stored(stub_responses(prompt_table(planted_prepared(spark, sf_dir), "doc_id")), "replies")


@register(
    "p2_reply_cache",
    W + f"""SELECT evidence_id, kind, sha256(response) AS reply_hash,
       CASE WHEN bool_or(doc_id % 2 = 1) OVER same THEN 'first' ELSE 'second' END AS asked_in,
       count(*) OVER same AS n_same_prompt
FROM ({text_model_sql('prompts')}) WINDOW same AS (PARTITION BY kind, prompt)""",
)
def p2_reply_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches over one cache: the odd documents, then all of them; each distinct prompt is asked once."""
    prompts = stored(prompt_table(planted_prepared(spark, sf_dir), "doc_id"), "all-prompts")
    cache = work_path(spark, "reply-cache")
    answer(prompts.where("doc_id % 2 = 1").drop("doc_id"), text_model, cache, "first")
    replies = stored(answer(prompts.drop("doc_id"), text_model, cache, "second"), "cached-replies")
    same = with_count(replies)
    return same.select("evidence_id", "kind", sha(F.col("response")).alias("reply_hash"), "asked_in", "n_same_prompt")


def with_count(replies: DataFrame) -> DataFrame:
    """Each row with the number of rows that share its prompt; folded first, so a hot prompt is one row."""
    counts = replies.groupBy("key").agg(F.count("*").alias("n_same_prompt"))
    return replies.join(stored(counts, "prompt-counts"), "key")


@register("p3_evidence_hash", W + "SELECT evidence_id, evidence_hash FROM prepared")
def p3_evidence_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_prepared(spark, sf_dir).select("evidence_id", "evidence_hash")


P4_SQL_COLS = (
    f"evidence_id, {_VERDICT5}, evidence_hash, CAST(len(removed_items) AS BIGINT) AS n_removed_items, "
    "sha256(array_to_string(removed_items, chr(1))) AS removed_items_hash"
)


def p4_columns(v: DataFrame) -> DataFrame:
    return v.select(
        "evidence_id", *[c.strip() for c in _VERDICT5.split(",")], "evidence_hash",
        bsize(F.col("removed_items")).alias("n_removed_items"),
        sha(F.array_join("removed_items", SEP)).alias("removed_items_hash"),
    )


@register("p4_check", W + f"SELECT {P4_SQL_COLS} FROM verdict")
def p4_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_columns(planted_verdicts(spark, sf_dir))


EXTRA_DETECTION = '{"injection_detected": true, "category": "fake_role"}'


@register(
    "p4_check_reply_table",
    W
    + f"""SELECT evidence_id,
       CASE WHEN state = 'complete' THEN conclusive OR det2 WHEN conclusive THEN TRUE END AS injection_detected,
       CASE WHEN conclusive THEN 'hidden_content_removed' WHEN state != 'complete' THEN NULL
            WHEN NOT det2 AND leaked THEN 'judge_unreliable' WHEN NOT det2 THEN 'none'
            WHEN cat2 IN ('malformed_judge_response') THEN 'unspecified' ELSE cat2 END AS category,
       CASE WHEN state = 'complete' THEN NOT leaked END AS judge_reliable,
       CASE WHEN state = 'complete' THEN leaked END AS canary_tripped,
       conclusive AS conclusive_tampering, state AS reply_state
FROM (SELECT *, CASE WHEN doc_id % 17 = 3 THEN 'missing_canary' WHEN doc_id % 19 = 5 THEN 'missing_detection' ELSE 'complete' END AS state,
             det OR doc_id % 6 = 0 AS det2,
             CASE WHEN doc_id % 6 != 0 THEN det_category WHEN det THEN least(det_category, 'fake_role') ELSE 'fake_role' END AS cat2
      FROM verdict)""",
)
def p4_check_reply_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply-table path of the screen: missing and repeated replies included.

    Every sixth document has a second detection reply that reports an
    injection, leaking canary replies come twice beside a harmless one, and
    some rows of either kind have not arrived.
    """
    ids = planted(spark, sf_dir).select("evidence_id", "doc_id")
    replies = reply_table(spark, sf_dir).join(ids, "evidence_id")
    k = F.col("doc_id")
    late = ((F.col("kind") == "canary") & (k % 17 == 3)) | ((F.col("kind") == "detection") & (k % 19 == 5) & (k % 17 != 3))
    arrived = replies.where(~late)
    second = arrived.where((k % 6 == 0) & (F.col("kind") == "detection")).withColumn("response", F.lit(EXTRA_DETECTION))
    harmless = arrived.where((k % 5 == 0) & (F.col("kind") == "canary")).withColumn("response", F.lit("zzz nothing to see"))
    folded = stored(replies_by_evidence(arrived.unionByName(second).unionByName(harmless)), "folded-replies")
    v = screen(spread(planted(spark, sf_dir), "evidence_id"), scorer=table_scorer(folded))
    return v.select("evidence_id", *[c.strip() for c in _VERDICT5.split(",")], "reply_state")
