"""Judge (J1-J8): label normalisation, prompts, reply parsing, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unveil.functions import fixed
from unveil.functions.canary import trap_sentence
from unveil.functions.udfs import parse_verdict


def label_key(raw: Column) -> Column:
    """Lower-case, keep Unicode letters and digits only."""
    return F.regexp_replace(F.lower(raw.cast("string")), r"[^\p{L}\p{N}]", "")


def _synonym_map() -> Column:
    kv = []
    for k, v in fixed.CATEGORY_SYNONYMS.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def normalize_category(raw: Column, detected: Column) -> Column:
    """False -> none; true -> synonym, with miss or none -> unspecified.

    The 34-entry vocabulary is a literal map folded into the expression:
    no join, no broadcast, evaluated inside codegen.
    """
    mapped = F.try_element_at(_synonym_map(), label_key(F.coalesce(raw.cast("string"), F.lit("None"))))
    attack = F.when(mapped.isNull() | (mapped == fixed.CATEGORY_NONE), F.lit(fixed.CATEGORY_UNSPECIFIED)).otherwise(
        mapped
    )
    return F.when(~detected, F.lit(fixed.CATEGORY_NONE)).otherwise(attack)


def category_is_wellformed(category: Column, detected: Column) -> Column:
    """J3."""
    ok_true = category.isin(
        *fixed.MODEL_ATTACK_CATEGORIES, fixed.CATEGORY_UNSPECIFIED, fixed.CATEGORY_MALFORMED_RESPONSE
    )
    return F.coalesce(
        F.when(detected, ok_true).otherwise(category == fixed.CATEGORY_NONE), F.lit(False)
    )


def removal_context(advisory_items: Column) -> Column:
    """J4: '- item' lines in the fixed block; empty without advisory items."""
    head, tail = fixed.template_parts(fixed.REMOVAL_CONTEXT_TEMPLATE, "items")
    lines = F.array_join(F.transform(advisory_items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(advisory_items) > 0, F.concat(F.lit(head), lines, F.lit(tail))).otherwise(F.lit(""))


def detection_prompt(cleaned_text: Column, advisory_items: Column) -> Column:
    """Cleaned evidence in the fence plus J4; never holds the canary."""
    a, b, c = fixed.template_parts(fixed.DETECTION_TEMPLATE, "evidence", "removal_context")
    return F.concat(F.lit(a), cleaned_text, F.lit(b), removal_context(advisory_items), F.lit(c))


def canary_prompt(cleaned_text: Column, word: Column) -> Column:
    """Summarisation task over text + blank line + trap."""
    a, b = fixed.template_parts(fixed.CANARY_TEMPLATE, "document")
    return F.concat(F.lit(a), cleaned_text, F.lit("\n\n"), trap_sentence(word), F.lit(b))


def reply_body(raw: Column) -> Column:
    """The reply text without white space around it and without a Markdown fence."""
    ws = F.lit(fixed.WHITESPACE_CHARS)
    bare = F.btrim(raw, ws)
    opened = F.btrim(bare, F.lit("`"))
    inner = F.when(F.lower(F.left(opened, F.lit(4))) == "json", F.substr(opened, F.lit(5))).otherwise(opened)
    return F.when(bare.startswith("```"), F.btrim(inner, ws)).otherwise(bare)


def decoded_body(reply: Column) -> Column:
    """A reply that arrives decoded (struct, map or variant) as JSON text.

    A null field of a struct cannot be told from a missing one and is left
    out, so that a null verdict counts as no verdict.
    """
    return F.to_json(reply)


def parsed_reply(raw: Column, decoded: bool = False) -> Column:
    """Strict JSON in the Arrow UDF: Spark's readers accept trailing text and single quotes."""
    return parse_verdict(decoded_body(raw) if decoded else reply_body(raw))


def parse_response(raw: Column, decoded: bool = False) -> Column:
    """struct<detected, category> from a detection reply; fails closed.

    ``decoded`` says that the reply is a struct, map or variant instead of
    text. Label normalisation stays native.
    """
    p = parsed_reply(raw, decoded)
    ok = p["well_formed"]
    detected = F.when(ok, p["detected"]).otherwise(F.lit(True))
    category = F.when(ok, normalize_category(p["category_text"], p["detected"])).otherwise(
        F.lit(fixed.CATEGORY_MALFORMED_RESPONSE)
    )
    return F.struct(detected.alias("detected"), category.alias("category"))


def category_is_accepted(category: Column) -> Column:
    """Whether a verdict's category is one of the values that it can take (null: no)."""
    return F.coalesce(category.isin(*fixed.FINAL_CATEGORIES), F.lit(False))


def combine_verdict(detected: Column, category: Column, leaked: Column, conclusive: Column) -> Column:
    """Struct of the five verdict fields."""
    renorm = normalize_category(category, detected)
    cat = (
        F.when(conclusive, F.lit(fixed.CATEGORY_HIDDEN_CONTENT_REMOVED))
        .when(~detected & leaked, F.lit(fixed.CATEGORY_JUDGE_UNRELIABLE))
        .otherwise(renorm)
    )
    return F.struct(
        (conclusive | detected).alias("injection_detected"),
        cat.alias("category"),
        (~leaked).alias("judge_reliable"),
        leaked.alias("canary_tripped"),
        conclusive.alias("conclusive_tampering"),
    )
