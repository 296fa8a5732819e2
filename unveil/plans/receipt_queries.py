"""Driver queries for the receipt-log jobs (R1-R4) over receipts built from ``orders``.

Each order becomes one JSON receipt text; ``o_orderkey % 16`` picks a shape
(conforming, case-folded enums, missing key, extra key, wrong leaf type,
unknown vote, ``error: null``, missing vote, float where an int belongs, text
that is not JSON, a JSON list, a repeated key, no votes, odd votes). The builder is one
SQL expression that Spark and DuckDB both evaluate to the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.functions import fixed
from unveil.operators import receipts as R
from unveil.plans.registry import register
from unveil.sources.tables import table


def receipt_expr(dialect: str) -> str:
    sha = "sha2(CAST(o_orderkey AS STRING), 256)" if dialect == "spark" else "sha256(CAST(o_orderkey AS VARCHAR))"
    s = "STRING" if dialect == "spark" else "VARCHAR"
    k = "(o_orderkey % 16)"
    vote = f"(CASE WHEN {k} = 1 THEN 'AGREE' WHEN {k} = 5 THEN 'maybe' WHEN o_orderkey % 4 = 3 THEN 'disagree' ELSE 'agree' END)"

    def v(i: int) -> str:
        return (f"(CASE WHEN (o_orderkey + {i}) % 3 = 0 THEN 'disagree' WHEN (o_orderkey + {i}) % 7 = 0 "
                f"THEN 'timeout' ELSE 'agree' END)")

    gas = f"CAST(o_orderkey % 1000 AS {s})"
    return f"""(CASE {k} WHEN 9 THEN 'no receipt' WHEN 10 THEN '[1]' ELSE '{{"consensus_data": {{"final": ' || (CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END)
|| ', "leader_receipt": {{"args": [' || CAST(o_custkey AS {s}) || '], "class_name": "Guard", "contract_state": '
|| (CASE WHEN {k} = 0 THEN '{{"a": {{"x": "1"}}}}' ELSE '"s' || CAST({k} AS {s}) || '"' END)
|| ', "result": "aGk=", "calldata": "AAEC", "eq_outputs": ' || (CASE WHEN {k} = 0 THEN '{{"0": "ok", "7": "no"}}' ELSE '{{"leader": {{"0": "ok"}}}}' END) || ', "error": null, "execution_result": "'
|| (CASE WHEN {k} = 7 THEN 'success' WHEN o_orderkey % 3 = 0 THEN 'ERROR' ELSE 'SUCCESS' END)
|| '", "gas_used": ' || (CASE WHEN {k} = 4 THEN '"' || {gas} || '"' WHEN {k} = 8 THEN {gas} || '.0' ELSE {gas} END)
|| ', "method": "screen_and_record", "mode": "' || (CASE WHEN {k} = 1 THEN 'Leader' ELSE 'leader' END)
|| '", "node_config": {{"address": "0x' || substr({sha}, 17, 40) || '", "config": {{}}, "model": "m'
|| CAST(o_custkey % 3 AS {s}) || '", "provider": "p", "stake": ' || CAST(o_custkey % 100 AS {s})
|| ', "plugin": "x", "plugin_config": {{}}}}'
|| (CASE WHEN {k} = 7 THEN '' ELSE ', "vote": "' || {vote} || '"' END)
|| '}}, "validators": [], "votes": ' || (CASE {k} WHEN 12 THEN '{{}}' WHEN 13 THEN '{{"v0": "AGREE", "v1": "perhaps", "v2": null}}'
ELSE '{{"v0": "' || {v(0)} || '", "v1": "' || {v(1)} || '", "v2": "' || {v(2)} || '"}}' END) || '}}, "created_at": "' || CAST(o_custkey AS {s})
|| '", "data": {{"function_args": "[]", "function_name": "screen_and_record"}}, "from_address": "0x'
|| substr({sha}, 1, 40) || '"'
|| (CASE WHEN {k} = 2 THEN '' ELSE ', "hash": "0x' || substr({sha}, 1, 16) || '"' END)
|| ', "status": "FINALIZED", "to_address": "0xc0de", "type": 2, "value": 0'
|| (CASE WHEN {k} = 11 THEN ', "status": "FINALIZED"' ELSE '' END)
|| (CASE WHEN {k} = 3 THEN ', "extra": 1' ELSE '' END)
|| (CASE WHEN {k} = 6 THEN ', "error": null' ELSE '' END)
|| (CASE WHEN o_orderkey % 5 = 0 THEN ', "message": "done"' WHEN o_orderkey % 5 = 1 THEN ', "message": ["on", 2]' ELSE '' END)
|| '}}' END)"""


def receipts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.select(F.col("o_orderkey").alias("receipt_id"), F.expr(receipt_expr("spark")).alias("receipt"))


RECEIPTS_CTE = f"""WITH receipts AS (
SELECT receipt_id, raw, CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS receipt, json_valid(raw) AS valid
FROM (SELECT o_orderkey AS receipt_id, {receipt_expr('duckdb')} AS raw FROM orders))
"""
LR = "$.consensus_data.leader_receipt"


def _sql_class(path: str) -> str:
    return f"""(CASE json_type(receipt, '{path}') WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool'
      WHEN 'VARCHAR' THEN 'str' WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'ARRAY' THEN 'list'
      WHEN 'OBJECT' THEN 'dict' WHEN 'DOUBLE' THEN 'other' ELSE 'missing' END)"""


def _in(vals) -> str:
    return "(" + ", ".join(f"'{x}'" for x in vals) + ")"


_R1_SQL = (
    RECEIPTS_CTE
    + f"""SELECT receipt_id, json_extract_string(receipt, '$.hash') AS hash, vote, execution_result, mode,
       CASE WHEN {_sql_class(LR + '.gas_used')} = 'int' THEN CAST(json_extract(receipt, '{LR}.gas_used') AS BIGINT) END AS gas_used,
       reason IS NULL AS ok, reason AS error_reason, decode(from_base64(json_extract_string(receipt, '{LR}.result'))) AS result,
       lower(hex(from_base64(json_extract_string(receipt, '{LR}.calldata')))) AS calldata_hex,
       json_extract_string(receipt, '{LR}.contract_state.a.x') AS state_x,
       json_extract_string(receipt, '{LR}.node_config.model') AS model,
       json_extract_string(receipt, '{LR}.eq_outputs."7"') AS eq_output_7
FROM (SELECT *, CASE WHEN NOT valid THEN 'not_json' WHEN vote IS NULL THEN 'missing_vote'
                     WHEN vote NOT IN {_in(fixed.VOTE_VALUES)} THEN 'invalid_vote'
                     WHEN execution_result IS NULL OR execution_result NOT IN {_in(fixed.STATUS_VALUES)} THEN 'invalid_execution_result'
                     WHEN mode IS NULL OR mode NOT IN {_in(fixed.MODE_VALUES)} THEN 'invalid_mode' END AS reason
      FROM (SELECT receipt_id, receipt, valid, lower(json_extract_string(receipt, '{LR}.vote')) AS vote,
                   upper(json_extract_string(receipt, '{LR}.execution_result')) AS execution_result,
                   lower(json_extract_string(receipt, '{LR}.mode')) AS mode FROM receipts))"""
)


@register("r1_parse", _R1_SQL)
def r1_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.parse_receipts(receipts_table(spark, sf_dir))
    return p.select(
        "receipt_id", "hash", "vote", "execution_result", "mode", "gas_used", "ok", "error_reason",
        F.decode("result", "UTF-8").alias("result"), F.lower(F.hex("calldata")).alias("calldata_hex"),
        F.try_element_at(F.try_element_at("contract_state", F.lit("a")), F.lit("x")).alias("state_x"),
        F.get_json_object("node_config", "$.model").alias("model"), F.try_element_at("eq_outputs", F.lit(7)).alias("eq_output_7"),
    )


def _paths(template, path: str = "$") -> list[tuple[str, str]]:
    if not isinstance(template, dict):
        return [(path, template)]
    return [(path, "dict"), *(x for k, sub in template.items() for x in _paths(sub, f"{path}.{k}"))]


def _r2_sql() -> str:
    checks = ", ".join(f"{{'path': '{p}', 'ok': {_sql_class(p)} IN {_in(R.ACCEPTS[kind])}}}" for p, kind in _paths(fixed.RECEIPT_TEMPLATE))
    return (
        RECEIPTS_CTE
        + f"""SELECT receipt_id, len(failing) = 0 AS conforms, failing[1].path AS first_failing_path
FROM (SELECT receipt_id, list_filter([{checks}], lambda c: NOT c.ok) AS failing FROM receipts)"""
    )


@register("r2_conformance", _r2_sql())
def r2_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conformance(receipts_table(spark, sf_dir))


_DATA = {"function_name": "screen_and_record", "function_args": "[]"}


@register(
    "r3_envelope",
    RECEIPTS_CTE
    + """SELECT receipt_id, is_object,
       CASE WHEN is_object THEN list_contains(keys, 'error') END AS has_error,
       CASE WHEN is_object THEN NOT list_contains(keys, 'error') END AS has_success,
       CASE WHEN is_object THEN list_contains(keys, 'message') END AS has_message,
       CASE WHEN is_object THEN list_contains(keys, 'data') END AS has_data,
       CASE WHEN is_object THEN coalesce(json_extract_string(receipt, '$.message') = 'done', FALSE) END AS message_is,
       CASE WHEN is_object THEN coalesce(CASE json_type(receipt, '$.message') WHEN 'VARCHAR' THEN contains(json_extract_string(receipt, '$.message'), 'on')
            WHEN 'ARRAY' THEN list_contains(json_extract_string(receipt, '$.message[*]'), 'on') END, FALSE) END AS message_contains,
       CASE WHEN is_object THEN coalesce(list_sort(json_keys(receipt, '$.data')) = ['function_args', 'function_name']
            AND json_extract_string(receipt, '$.data.function_args') = '[]'
            AND json_extract_string(receipt, '$.data.function_name') = 'screen_and_record', FALSE) END AS data_is,
       CASE WHEN is_object THEN coalesce(list_contains(json_keys(receipt, '$.data'), 'function_name'), FALSE) END AS data_contains
FROM (SELECT *, json_type(receipt) = 'OBJECT' AS is_object, json_keys(receipt) AS keys FROM receipts)""",
)
def r3_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.envelope(receipts_table(spark, sf_dir), data=_DATA)


@register(
    "r4_vote_tally",
    RECEIPTS_CTE
    + """SELECT receipt_id, CAST(len(list_filter(votes, lambda x: x = 'agree')) AS BIGINT) AS n_agree,
       CAST(len(list_filter(votes, lambda x: x = 'disagree')) AS BIGINT) AS n_disagree,
       CAST(len(list_filter(votes, lambda x: x IS NULL OR x NOT IN ('agree', 'disagree'))) AS BIGINT) AS n_other
FROM (SELECT receipt_id, coalesce(list_transform(map_values(CAST(json_extract(receipt, '$.consensus_data.votes') AS MAP(VARCHAR, VARCHAR))),
                                                 lambda x: lower(x)), []) AS votes FROM receipts)""",
)
def r4_vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vote_tally(receipts_table(spark, sf_dir))
