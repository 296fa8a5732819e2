"""Receipt-log jobs (FIXTURES.md F8 cases)."""

import json

from unveil.operators import receipts as R


def _receipt(**over):
    base = {
        "consensus_data": {
            "final": True,
            "leader_receipt": {
                "args": [], "class_name": "G", "contract_state": "s", "eq_outputs": {"leader": {}},
                "error": None, "execution_result": "success", "gas_used": 5, "method": "m", "mode": "Leader",
                "node_config": {"address": "0x1", "config": {}, "model": "m", "provider": "p", "stake": 1,
                                "plugin": "x", "plugin_config": {}},
                "vote": "AGREE",
            },
            "validators": [], "votes": {"a": "agree", "b": "disagree"},
        },
        "created_at": "t", "data": {"function_args": "[]", "function_name": "f"}, "from_address": "0x2",
        "hash": "0xh", "status": "FINALIZED", "to_address": "0x3", "type": 2, "value": True,
    }
    base.update(over)
    return base


def test_receipt_cases(spark):
    conforming = _receipt()
    missing = _receipt()
    del missing["hash"]
    extra = _receipt(extra=1)
    wrong_leaf = _receipt()
    wrong_leaf["consensus_data"]["leader_receipt"]["gas_used"] = "5"
    bad_vote = _receipt()
    bad_vote["consensus_data"]["leader_receipt"]["vote"] = "maybe"
    err = _receipt(error=None)
    rows = [(i, json.dumps(r)) for i, r in enumerate([conforming, missing, extra, wrong_leaf, bad_vote, err])]
    df = spark.createDataFrame(rows, "receipt_id bigint, receipt string")
    conf = {r.receipt_id: (r.conforms, r.first_failing_path) for r in R.conformance(df).collect()}
    assert conf[0] == (True, None)  # bool accepted where an int is expected (value: true)
    assert conf[1] == (False, "$.hash")
    assert conf[2] == (True, None)
    assert conf[3] == (False, "$.consensus_data.leader_receipt.gas_used")
    parsed = {r.receipt_id: r for r in R.parse_receipts(df).collect()}
    assert (parsed[0].vote, parsed[0].mode, parsed[0].execution_result, parsed[0].ok) == ("agree", "leader", "SUCCESS", True)
    assert parsed[4].error_reason == "invalid_vote"
    good, bad = R.split_quarantine(R.parse_receipts(df))
    assert bad.count() == 1 and good.count() == 5
    env = {r.receipt_id: r for r in R.envelope(df).collect()}
    assert env[5].has_error and not env[5].has_success and env[0].has_success
    tally = {r.receipt_id: (r.n_agree, r.n_disagree) for r in R.vote_tally(df).collect()}
    assert tally[0] == (1, 1)


def test_hostile_receipts(spark):
    floats = _receipt()
    floats["consensus_data"]["leader_receipt"]["gas_used"] = 10.0
    texts = [json.dumps(_receipt()), "not json", None, "[1]", json.dumps(floats), json.dumps(_receipt())[:-1] + ', "hash": "0xlast"}',
             json.dumps(_receipt(consensus_data={"votes": {"a": "AGREE", "b": "agree", "c": "maybe", "d": None}})),
             json.dumps(_receipt(consensus_data={"votes": {}}))]
    df = spark.createDataFrame(list(enumerate(texts)), "receipt_id bigint, receipt string")
    env = {r.receipt_id: r for r in R.envelope(df).collect()}
    assert [env[i].is_object for i in range(8)] == [True, False, False, False, True, True, True, True]
    assert all(env[i].has_success is None and env[i].has_error is None and env[i].data_is is None for i in (1, 2, 3))
    conf = {r.receipt_id: r for r in R.conformance(df).collect()}
    assert not conf[4].conforms and conf[4].first_failing_path.endswith("gas_used") and conf[1].first_failing_path == "$"
    parsed = {r.receipt_id: r for r in R.parse_receipts(df).collect()}
    assert parsed[5].hash == "0xlast" and parsed[5].ok and parsed[1].error_reason == "not_json" and parsed[4].gas_used is None
    tally = {r.receipt_id: (r.n_agree, r.n_disagree, r.n_other) for r in R.vote_tally(df).collect()}
    assert tally == {0: (1, 1, 0), 1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 1, 0), 5: (1, 1, 0), 6: (2, 0, 2), 7: (0, 0, 0)}
    assert "Exchange" not in R.vote_tally(df)._jdf.queryExecution().executedPlan().toString()


def test_templates_and_predicates(spark):
    rows = [(0, '{"xs": [{"a": 1}, {"a": 2, "b": null}], "message": "well done", "data": ["x", 3, {"k": [1]}]}'),
            (1, '{"xs": [{"a": 1}, {"a": 2.5}], "message": ["done"], "data": {"x": 1}}'), (2, '{"xs": [], "message": null}'), (3, '{"xs": {}}')]
    df = spark.createDataFrame(rows, "receipt_id bigint, receipt string")
    got = {r.receipt_id: (r.conforms, r.first_failing_path) for r in R.conformance(df, template={"xs": [{"a": "int"}]}).collect()}
    assert got == {0: (True, None), 1: (False, "$.xs[*]"), 2: (True, None), 3: (False, "$.xs")}
    env = {r.receipt_id: r for r in R.envelope(df, message=["done"], message_part="done", data={"x": 1}, data_part="x").collect()}
    assert [env[i].message_is for i in range(4)] == [False, True, False, False]
    assert [env[i].message_contains for i in range(4)] == [True, True, False, False]
    assert [env[i].data_is for i in range(4)] == [False, True, False, False]
    assert [env[i].data_contains for i in range(4)] == [True, True, False, False]
    nested = R.envelope(df, data_part={"k": [1]}).where("receipt_id = 0").first()
    assert nested.data_contains and env[2].has_message and not env[3].has_data


def test_typed_fields(spark):
    r = _receipt()
    r["consensus_data"]["leader_receipt"].update(result="aGk=", calldata="AAEC", contract_state={"a": {"x": "1"}}, eq_outputs={"0": "ok", "12": "no"})
    p = R.parse_receipts(spark.createDataFrame([(0, json.dumps(r))], "receipt_id bigint, receipt string")).first()
    assert bytes(p.result) == b"hi" and bytes(p.calldata) == b"\x00\x01\x02" and p.contract_state == {"a": {"x": "1"}}
    assert p.eq_outputs == {0: "ok", 12: "no"} and json.loads(p.node_config)["model"] == "m"


def test_conformance_looks_each_rule_up_once(spark):
    """A rule costs one type lookup a receipt: not one for each class it is compared with, nor one for each column that reads it."""
    from pyspark.sql import functions as F

    from unveil.functions import fixed

    rows = spark.range(1).select("id", F.col("id").cast("string").alias("receipt"))
    rules = R.structure_checks(fixed.RECEIPT_TEMPLATE, F.col("_v"))
    was = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = R.conformance(rows)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", was)
    assert plan.count("SchemaOfVariant.schemaOfVariant(") == len(rules)
    types = {"n": "int", "b": "bool", "o": {"s": "str|None"}, "l": ["int"]}
    texts = ['{"n": 1, "b": true, "o": {"s": null}, "l": [1, true]}', '{"n": 5.0, "b": true, "o": {"s": "x"}, "l": []}', '{"n": 12345678901234567890, "b": false, "o": {}, "l": []}',
             '{"n": true, "b": true, "o": {"s": ""}, "l": [1, "x"]}', '{"n": 1, "b": null, "o": {"s": ""}, "l": []}', "[]", "no json", None]
    data = spark.createDataFrame(list(enumerate(texts)), "receipt_id int, receipt string")
    got = {r.receipt_id: (r.conforms, r.first_failing_path) for r in R.conformance(data, template=types).collect()}
    assert got == {0: (True, None), 1: (False, "$.n"), 2: (False, "$.o.s"), 3: (False, "$.l[*]"), 4: (False, "$.b"), 5: (False, "$"), 6: (False, "$"), 7: (False, "$")}
