"""Receipt-log jobs (R1-R4) over a table of JSON receipt text.

JSON is parsed once into a VARIANT (of a repeated key the last value counts);
leaf types come from ``schema_of_variant``, so structure checks are native
column expressions and nothing shuffles.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unveil.functions import fixed

LEADER = "$.consensus_data.leader_receipt"


ACCEPTS = {  # the classes of ``type_class`` that a leaf name takes
    "bool": ("bool",),
    "str": ("str",),
    "int": ("int", "bool"),
    "dict": ("dict",),
    "list": ("list",),
    "str|None": ("str", "null"),
}


# How schema_of_variant begins for each class. Whole numbers arrive as BIGINT, or beyond its range as
# a decimal of 19 or more digits; a shorter decimal is a float such as 5.0, which is no int.
TYPE_NAMES = {
    "null": r"VOID$",
    "bool": r"BOOLEAN$",
    "str": r"STRING$",
    "int": r"(?:(?:BIG|SMALL|TINY)?INT|DECIMAL\((?:19|[23]\d),0\))$",
    "list": r"ARRAY",
    "dict": r"OBJECT",
}


def is_class(v: Column, path: str, *classes: str) -> Column:
    """Whether a JSON path is there and of one of the classes; its type is looked up once."""
    named = "|".join(TYPE_NAMES[c] for c in classes)
    return F.coalesce(F.schema_of_variant(F.variant_get(v, path, "variant")).rlike(f"^(?:{named})"), F.lit(False))


def type_class(v: Column, path: str = "$") -> Column:
    """Class of a JSON path: missing/null/bool/str/int/list/dict/other."""
    t = F.schema_of_variant(F.variant_get(v, path, "variant"))
    out = F.when(t.isNull() | (t == "NULL"), F.lit("missing"))
    for name, pattern in TYPE_NAMES.items():
        out = out.when(t.rlike(f"^{pattern}"), F.lit(name))
    return out.otherwise(F.lit("other"))


def with_variant(receipts: DataFrame, json_col: str = "receipt") -> DataFrame:
    """Adds ``_v``; text that is not JSON gives null. Repeated keys are allowed in this session from here on."""
    receipts.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return receipts.select("*", F.try_parse_json(F.col(json_col)).alias("_v"))


def _int_keys(m: Column) -> Column:
    whole = F.map_filter(m, lambda k, _: k.rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"))
    return F.map_from_entries(F.transform(F.map_entries(whole), lambda e: F.struct(F.trim(e["key"]).cast("int").alias("key"), e["value"].alias("value"))))


def parse_receipts(receipts: DataFrame, json_col: str = "receipt") -> DataFrame:
    """Typed leader-receipt fields with case-folded enums; bad rows flagged.

    Checks run in the typed reader's order (vote, execution result, mode);
    ``error_reason`` names the first failure, rows with one go to quarantine.
    ``result`` and ``calldata`` are decoded from base64, ``eq_outputs`` has
    integer keys (others are left out), ``node_config`` stays JSON; a field
    that is missing or of another shape is null.
    """
    d = with_variant(receipts, json_col)
    v = F.col("_v")

    def s(path: str) -> Column:
        return F.try_variant_get(v, f"{LEADER}.{path}", "string")

    vote, status, mode = F.lower(s("vote")), F.upper(s("execution_result")), F.lower(s("mode"))
    gas = F.when(type_class(v, f"{LEADER}.gas_used") == "int", F.try_variant_get(v, f"{LEADER}.gas_used", "bigint"))
    reason = (
        F.when(v.isNull(), F.lit("not_json"))
        .when(vote.isNull(), F.lit("missing_vote"))
        .when(~vote.isin(*fixed.VOTE_VALUES), F.lit("invalid_vote"))
        .when(status.isNull() | ~status.isin(*fixed.STATUS_VALUES), F.lit("invalid_execution_result"))
        .when(mode.isNull() | ~mode.isin(*fixed.MODE_VALUES), F.lit("invalid_mode"))
    )
    keep = [c for c in receipts.columns if c != json_col]
    return d.select(
        *keep,
        F.try_variant_get(v, "$.hash", "string").alias("hash"),
        vote.alias("vote"), status.alias("execution_result"), mode.alias("mode"), gas.alias("gas_used"),
        F.try_to_binary(s("result"), F.lit("base64")).alias("result"),
        F.try_to_binary(s("calldata"), F.lit("base64")).alias("calldata"),
        F.try_variant_get(v, f"{LEADER}.contract_state", "map<string,map<string,string>>").alias("contract_state"),
        F.to_json(F.variant_get(v, f"{LEADER}.node_config", "variant")).alias("node_config"),
        _int_keys(F.try_variant_get(v, f"{LEADER}.eq_outputs", "map<string,string>")).alias("eq_outputs"),
        reason.isNull().alias("ok"), reason.alias("error_reason"),
    )


def split_quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R1 output -> (good rows, quarantined rows with error_reason)."""
    return parsed.where(F.col("ok")).drop("error_reason"), parsed.where(~F.col("ok"))


def structure_checks(template, v: Column, path: str = "$", name: str = "$") -> list[tuple[str, Column]]:
    """(path, holds) for every rule of ``template``, depth first.

    A dict asks for its keys (more are allowed), a one-element list for a list
    whose every element fits, a string names a leaf class of ``ACCEPTS``.
    """
    if isinstance(template, dict):
        out = [(name, is_class(v, path, "dict"))]
        for key, sub in template.items():
            out += structure_checks(sub, v, f"{path}['{key}']", f"{name}.{key}")
        return out
    if isinstance(template, list):
        items = F.try_variant_get(v, path, "array<variant>")

        def fits(x):
            holds = None
            for _, ok in structure_checks(template[0], x):
                holds = ok if holds is None else holds & ok
            return holds

        return [(name, is_class(v, path, "list")), (f"{name}[*]", F.coalesce(F.forall(items, fits), F.lit(False)))]
    return [(name, is_class(v, path, *ACCEPTS[template]))]


def conformance(receipts: DataFrame, json_col: str = "receipt", template=fixed.RECEIPT_TEMPLATE) -> DataFrame:
    """R2: whether each receipt fits ``template`` (any structure), and the first failing path.

    Each rule is looked at once for a receipt, and none behind the first that fails.
    """
    d = with_variant(receipts, json_col)
    failing = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(path)) for path, ok in structure_checks(template, F.col("_v"))]
    keep = [c for c in receipts.columns if c != json_col]
    # the one-row generator keeps the chain from being merged into both columns that read it
    first = d.select(*keep, F.inline(F.array(F.struct(F.coalesce(*failing).alias("first_failing_path")))))
    return first.select(*keep, F.col("first_failing_path").isNull().alias("conforms"), "first_failing_path")


def _json(value) -> Column:
    """A Python value in the text form that equal variants share."""
    return F.to_json(F.parse_json(F.lit(json.dumps(value))))


def contains(v: Column, needle) -> Column:
    """Python's ``needle in value`` for a text, list or object variant; false for other kinds."""
    text = F.try_variant_get(v, "$", "string").contains(needle) if isinstance(needle, str) else F.lit(False)
    listed = F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x) == _json(needle))
    keyed = F.map_contains_key(F.try_variant_get(v, "$", "map<string,variant>"), needle) if isinstance(needle, str) else F.lit(False)
    kind = type_class(v)
    found = F.when(kind == "str", text).when(kind == "list", listed).when(kind == "dict", keyed)
    return F.coalesce(found, F.lit(False))


def envelope(
    receipts: DataFrame, json_col: str = "receipt", message="done", message_part="on", data=None, data_part="function_name"
) -> DataFrame:
    """Predicates on the receipt's top level (an ``error`` key with a null value is an error).

    ``is_object`` tells whether the text is a JSON object; if not, every
    predicate is null. A predicate on a missing key is false. ``message`` and
    ``data`` are compared as whole JSON values, the parts with ``contains``.
    """
    d = with_variant(receipts, json_col)
    keep = [c for c in receipts.columns if c != json_col]
    v = F.col("_v")
    valid = F.coalesce(type_class(v) == "dict", F.lit(False))
    get = lambda k: F.variant_get(v, f"$.{k}", "variant")
    has = lambda k: get(k).isNotNull()
    same = lambda k, value: F.coalesce(F.to_json(get(k)) == _json(value), F.lit(False))
    predicates = {
        "has_error": has("error"), "has_success": ~has("error"), "has_message": has("message"), "has_data": has("data"),
        "message_is": same("message", message), "message_contains": contains(get("message"), message_part),
        "data_is": same("data", data), "data_contains": contains(get("data"), data_part),
    }
    return d.select(*keep, valid.alias("is_object"), *[F.when(valid, p).alias(n) for n, p in predicates.items()])


def vote_tally(receipts: DataFrame, key: str = "receipt_id", json_col: str = "receipt", values: tuple[str, ...] = fixed.VOTE_VALUES) -> DataFrame:
    """Validator votes of each receipt, case-folded; other values count in ``n_other``.

    Every receipt has a row. Votes are counted within their own receipt, so
    there is no shuffle.
    """
    votes = F.map_values(F.try_variant_get(F.col("_v"), "$.consensus_data.votes", "map<string,string>"))
    d = with_variant(receipts, json_col).select(key, F.transform(F.coalesce(votes, F.array().cast("array<string>")), F.lower).alias("_votes"))

    def count(value: str) -> Column:
        return F.size(F.filter("_votes", lambda x: x == value)).cast("bigint")

    other = F.size(F.filter("_votes", lambda x: ~F.coalesce(x.isin(*values), F.lit(False)))).cast("bigint")
    return d.select(key, *[count(x).alias(f"n_{x}") for x in values], other.alias("n_other"))
