"""Screening pipeline (P1-P4): clean -> canary -> prompts -> replies -> verdict.

Everything up to the prompts is a per-row projection. Replies arrive as a
table keyed by (evidence_id, kind); they are folded to one row per evidence
id (partial aggregation, then a shuffle on evidence_id) and joined back on
evidence_id. When the evidence side was hash-partitioned on evidence_id
before cleaning (``spread``) the join reuses that layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unveil.functions import canary as T
from unveil.functions import judge as J
from unveil.functions.cleaner import advisory_items, clean, is_conclusive, result_barrier
from unveil.session import ship_package

VERDICT_COLUMNS = (
    "injection_detected",
    "judge_reliable",
    "canary_tripped",
    "conclusive_tampering",
    "category",
    "evidence_hash",
    "removed_items",
)


def prepare(evidence: DataFrame, text_col: str = "text") -> DataFrame:
    """C10, C14/C15, T1-T3, J5/J6 and P3 as one projection chain.

    evidence needs: evidence_id, text, sender, scope, chain_id.
    """
    c = clean(evidence, text_col)
    return c.select(
        "*",
        is_conclusive(F.col("removed")).alias("conclusive"),
        advisory_items(F.col("removed_items")).alias("advisory_items"),
        T.seed_hex(*T.seed_material(F.col("sender"), F.col("scope"), F.col("chain_id"), F.col("cleaned_text"))).alias(
            "seed"
        ),
        F.concat(F.lit("0x"), F.sha2(F.col("cleaned_text"), 256)).alias("evidence_hash"),
    ).select(
        "*",
        T.canary_word(F.col("seed")).alias("canary_word"),
    ).select(
        "*",
        J.detection_prompt(F.col("cleaned_text"), F.col("advisory_items")).alias("detection_prompt"),
        J.canary_prompt(F.col("cleaned_text"), F.col("canary_word")).alias("canary_prompt"),
    )


def prompt_table(prepared: DataFrame, *carry: str) -> DataFrame:
    """Two independent prompts per document, long form (evidence_id, kind, prompt)."""
    return prepared.select(
        "evidence_id",
        *carry,
        F.inline(
            F.array(
                F.struct(F.lit("detection").alias("kind"), F.col("detection_prompt").alias("prompt")),
                F.struct(F.lit("canary").alias("kind"), F.col("canary_prompt").alias("prompt")),
            )
        ),
    )


# A canary word wherever it stands, overlaps included.
CANARY_WORDS = r"(?=(XG-[A-Z0-9]{10}))"


def replies_by_evidence(responses: DataFrame) -> DataFrame:
    """Folds (evidence_id, kind, response) to one row per evidence id, fail closed.

    Every reply is parsed on its own and only the results are aggregated, so
    an id with any number of replies is reduced before the shuffle: detected
    if any reply is, with the category that sorts first among those that are;
    the canary words that any canary reply shows; and the number of replies of each
    kind. Write the result once and pass it to ``attach_replies`` or
    ``table_scorer`` as often as needed.
    """
    ship_package(responses.sparkSession)
    is_detection = F.col("kind") == "detection"
    parsed = responses.select("evidence_id", "kind", "response", J.parse_response(F.when(is_detection, F.col("response"))).alias("p"))
    words = F.when(F.col("kind") == "canary", F.regexp_extract_all("response", F.lit(CANARY_WORDS), F.lit(1)))
    marked = parsed.select("evidence_id", "kind", "p.detected", "p.category", F.explode_outer(F.array_distinct(words)).alias("word"))
    return marked.groupBy("evidence_id").agg(
        F.max(F.when(is_detection, F.col("detected"))).alias("reply_detected"),
        F.coalesce(F.min(F.when(is_detection & F.col("detected"), F.col("category"))), F.max(F.when(is_detection, F.col("category")))).alias("reply_category"),
        F.collect_set("word").alias("reply_words"),
        F.max(is_detection).alias("has_detection"),
        F.max(F.col("kind") == "canary").alias("has_canary"),
    )


def score_join(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """P2 (a): prompts joined with a reply table on (evidence_id, kind)."""
    return prompts.join(responses, ["evidence_id", "kind"], "left")


def attach_replies(prepared: DataFrame, folded: DataFrame) -> DataFrame:
    """P2 (a) for the verdict: the folded replies, left-joined on the evidence id."""
    return prepared.join(folded, "evidence_id", "left")


def reply_state(columns: list[str]) -> Column:
    """complete, or which reply has not arrived: a missing row is no verdict."""
    if "has_detection" not in columns:
        return F.lit("complete")
    detection, canary = (F.coalesce(F.col(c), F.lit(False)) for c in ("has_detection", "has_canary"))
    return (
        F.when(detection & canary, F.lit("complete")).when(detection, F.lit("missing_canary"))
        .when(canary, F.lit("missing_detection")).otherwise(F.lit("missing"))
    )


def verdicts(scored: DataFrame, skip_model_when_conclusive: bool = False) -> DataFrame:
    """J7, T5, J8 over prepared rows with replies.

    The replies are the columns detection_response/canary_response, or those
    of ``replies_by_evidence``. ``reply_state`` tells whether both replies of
    a row have arrived; until then the fields that depend on the model are
    null, and so is the verdict unless the cleaner alone is conclusive.
    """
    ship_package(scored.sparkSession)
    state = reply_state(scored.columns)
    if "has_detection" in scored.columns:
        det = F.struct(F.col("reply_detected").alias("detected"), F.col("reply_category").alias("category"))
        leaked = F.array_contains(F.coalesce("reply_words", F.array().cast("array<string>")), F.col("canary_word"))
        arrived = state == "complete"
        parsed, leaked = F.when(arrived, det), F.when(arrived, leaked)
    else:
        parsed = J.parse_response(F.col("detection_response"))
        leaked = T.canary_tripped(F.col("canary_response"), F.col("canary_word"))
    j = scored.select("*", parsed.alias("_det"), leaked.alias("_leaked"))
    v = J.combine_verdict(F.col("_det.detected"), F.col("_det.category"), F.col("_leaked"), F.col("conclusive"))
    j = j.select("*", v.alias("_v"))
    reliable, tripped = F.col("_v.judge_reliable"), F.col("_v.canary_tripped")
    if skip_model_when_conclusive:
        reliable = F.when(F.col("conclusive"), F.lit(None)).otherwise(reliable)
        tripped = F.when(F.col("conclusive"), F.lit(None)).otherwise(tripped)
    base = [c for c in scored.columns]
    out = j.select(
        *base,
        F.col("_det.detected").alias("model_detected"),
        F.col("_det.category").alias("model_category"),
        F.col("_leaked").alias("canary_leaked"),
        F.col("_v.injection_detected").alias("injection_detected"),
        reliable.alias("judge_reliable"),
        tripped.alias("canary_tripped"),
        F.col("_v.conclusive_tampering").alias("conclusive_tampering"),
        F.when(F.col("conclusive") | (state == "complete"), F.col("_v.category")).alias("category"),
        state.alias("reply_state"),
    )
    derived = [c for c in out.columns if c not in base]
    return out.select(*base, result_barrier(derived))


def screen(evidence: DataFrame, responses: DataFrame | None = None, scorer=None, *carry: str,
           skip_model_when_conclusive: bool = False) -> DataFrame:
    """P4 ``check`` over a table: verdict per evidence row, nothing stored.

    Replies come either from ``responses`` (evidence_id, kind, response),
    folded and joined on evidence_id, or from ``scorer(prepared) -> prepared`` adding
    detection_response/canary_response in place (no shuffle). Default is
    parity: the model is consulted even when the cleaner was conclusive.
    With ``skip_model_when_conclusive`` the judge fields of conclusive rows
    are null (callers can then drop those rows before scoring).
    """
    p = prepare(evidence)
    scored = scorer(p) if scorer is not None else attach_replies(p, replies_by_evidence(responses))
    v = verdicts(scored, skip_model_when_conclusive=skip_model_when_conclusive)
    return v.select("evidence_id", *carry, *VERDICT_COLUMNS, "reply_state", "removed")
