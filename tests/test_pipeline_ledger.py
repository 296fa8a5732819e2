"""Screening pipeline, panel consensus and the write-once ledger."""


import pytest
from pyspark.sql import functions as F

from corpus_rows import CORPUS
from unveil.operators import consensus as K
from unveil.operators import ledger as L
from unveil.operators.pipeline import prepare, prompt_table, replies_by_evidence, screen
from unveil.operators.responses import model_scorer, score_with, table_scorer


def _evidence(spark, rows):
    return spark.createDataFrame(
        [(eid, i, i, i, text, "sender", "contract", "4221") for i, (eid, text) in enumerate(rows)],
        "evidence_id string, sub_id bigint, arrival bigint, doc_id bigint, text string, "
        "sender string, scope string, chain_id string",
    )


def _scorer(says_injected: bool, leaks: bool):
    def score(p):
        det = '{"injection_detected": %s, "category": "%s"}' % (
            "true" if says_injected else "false", "hidden_instruction" if says_injected else "none")
        canary = F.concat(F.lit("Here you go: "), F.col("canary_word")) if leaks else F.lit("A summary.")
        return p.select("*", F.lit(det).alias("detection_response"), canary.alias("canary_response"))

    return score


def test_corpus_with_unhelpful_model(spark):
    v = {r.evidence_id: r for r in screen(_evidence(spark, CORPUS), scorer=_scorer(False, False)).collect()}
    conclusive = {e for e, r in v.items() if r.conclusive_tampering}
    assert len(conclusive) == 5 and all(v[e].injection_detected for e in conclusive)
    assert all(v[e].category == "hidden_content_removed" for e in conclusive)
    assert not any(r.injection_detected for e, r in v.items() if e.startswith("clean/"))
    assert all(r.evidence_hash.startswith("0x") and len(r.evidence_hash) == 66 for r in v.values())


def test_leak_marks_judge_not_evidence(spark):
    ev = _evidence(spark, [("a", "An ordinary invoice."), ("b", CORPUS[2][1])])
    v = {r.evidence_id: r for r in screen(ev, scorer=_scorer(False, True)).collect()}
    assert (v["a"].injection_detected, v["a"].judge_reliable, v["a"].category) == (False, False, "judge_unreliable")
    assert (v["b"].category, v["b"].canary_tripped) == ("hidden_content_removed", True)


def test_prompts_are_independent(spark):
    p = prepare(_evidence(spark, CORPUS))
    bad = p.where(F.col("detection_prompt").contains(F.col("canary_word"))
                  | ~F.col("canary_prompt").contains(F.col("canary_word")))
    assert bad.count() == 0
    assert prompt_table(p).count() == 2 * len(CORPUS)


def test_reply_table_join_path(spark):
    ev = _evidence(spark, [("a", "An ordinary invoice."), ("b", "Another one.")])
    replies = spark.createDataFrame(
        [("a", "detection", '{"injection_detected": true, "category": "jailbreak"}'),
         ("a", "canary", "A summary."), ("b", "canary", "A summary.")],
        "evidence_id string, kind string, response string")
    v = {r.evidence_id: r for r in screen(ev, responses=replies).collect()}
    assert v["a"].category == "hidden_instruction" and v["a"].reply_state == "complete"
    b = v["b"]  # a reply that has not arrived is no verdict
    assert (b.injection_detected, b.category, b.judge_reliable, b.reply_state) == (None, None, None, "missing_detection")


def test_repeated_replies_fail_closed(spark):
    ev = _evidence(spark, [("a", "An ordinary invoice."), ("b", "Another one."), ("c", CORPUS[2][1])])
    word = {r.evidence_id: r.canary_word for r in prepare(ev).collect()}
    clean = '{"injection_detected": false, "category": "none"}'
    replies = spark.createDataFrame(
        [("a", "detection", clean), ("a", "canary", "zzz harmless"), ("a", "canary", f"XG-{word['a']} as asked"),
         ("b", "detection", clean), ("b", "detection", "not json"), ("b", "canary", None)],
        "evidence_id string, kind string, response string")
    v = {r.evidence_id: r for r in screen(ev, responses=replies).collect()}
    assert (v["a"].canary_tripped, v["a"].judge_reliable, v["a"].category) == (True, False, "judge_unreliable")
    assert (v["b"].injection_detected, v["b"].category, v["b"].judge_reliable) == (True, "unspecified", True)
    assert v["c"].injection_detected and v["c"].category == "hidden_content_removed" and v["c"].judge_reliable is None


def test_real_scorers_reach_every_entry_point(spark, tmp_path):
    ev = _evidence(spark, [("a", "An ordinary invoice."), ("b", "Another one.")])

    def model(pdf):
        says = '{"injection_detected": true, "category": "base64"}'
        return pdf["kind"].map(lambda k: says if k == "detection" else "A summary.")

    inline = {r.evidence_id: r.category for r in screen(ev, scorer=model_scorer(model)).collect()}
    folded = replies_by_evidence(score_with(prompt_table(prepare(ev)), model))
    table = {r.evidence_id: r.category for r in screen(ev, scorer=table_scorer(folded)).collect()}
    assert inline == table == {"a": "encoded_payload", "b": "encoded_payload"}
    part = replies_by_evidence(score_with(prompt_table(prepare(ev)), model).where("evidence_id = 'a'"))
    led, out = str(tmp_path / "ledger"), str(tmp_path / "outcome")
    got = {r.evidence_id: r.status for r in L.screen_and_record(ev, led, out, 0, table_scorer(part)).collect()}
    assert got == {"a": "recorded", "b": "unscored"} and L.read_ledger(spark, led).count() == 1
    later = {r.evidence_id: r.status for r in L.screen_and_record(ev, led, out, 1, table_scorer(folded)).collect()}
    assert later == {"a": "rejected", "b": "recorded"}


def test_panel(spark):
    panel = spark.createDataFrame([
        ("agree", 0, "leader", "success", True, "fake_role", False),
        ("agree", 1, "validator", "success", True, "hidden_instruction", False),
        ("none_label", 0, "leader", "success", True, "none", False),
        ("none_label", 1, "validator", "success", True, "none", False),
        ("no_leader", 0, "leader", "error", None, None, None),
        ("no_leader", 1, "validator", "success", False, "none", False),
        ("canary", 0, "leader", "success", False, "none", True),
        ("canary", 1, "validator", "success", False, "none", False),
    ], "evidence_id string, judge_id int, mode string, status string, injection_detected boolean, "
       "category string, canary_leaked boolean")
    votes = {r.evidence_id: r.agree for r in K.validator_votes(panel).collect()}
    assert votes == {"agree": True, "none_label": False, "no_leader": False, "canary": False}
    acc = {r.evidence_id: r.accepted for r in K.panel_acceptance(panel).collect()}
    assert acc["agree"] and not acc["canary"]
    alone = K.panel_acceptance(panel.where("mode = 'leader'")).collect()
    assert len(alone) == 4 and not any(r.n_validators or r.accepted for r in alone)


def test_ledger_cases(spark, tmp_path):
    led, out = str(tmp_path / "ledger"), str(tmp_path / "outcome")
    score = _scorer(False, False)
    b0 = _evidence(spark, [("x", "first x"), ("y", "first y"), ("x", "second x, same batch")])
    r0 = {(r.evidence_id, r.sub_id): r for r in L.screen_and_record(b0, led, out, 0, score).collect()}
    assert r0[("x", 0)].status == "recorded" and r0[("x", 2)].status == "rejected"
    assert r0[("x", 2)].message == "Evidence 'x' already screened"
    b1 = _evidence(spark, [("y", "again y"), ("z", "new z")])
    r1 = {r.evidence_id: r.status for r in L.screen_and_record(b1, led, out, 1, score).collect()}
    assert r1 == {"y": "rejected", "z": "recorded"}
    assert L.read_ledger(spark, led).count() == 3
    # replay batch 1: gives back what is stored, adds nothing
    r2 = {r.evidence_id: r.status for r in L.screen_and_record(b1, led, out, 1, score).collect()}
    assert r2 == r1
    # other submissions under a used number change nothing
    with pytest.raises(L.BatchConflict):
        L.screen_and_record(_evidence(spark, [("w", "other")]), led, out, 1, score)
    assert sorted(r.evidence_id for r in L.read_ledger(spark, led).collect()) == ["x", "y", "z"]
    req = spark.createDataFrame([("x",), ("missing",)], "evidence_id string")
    got = {r.evidence_id: r for r in L.get_records(spark, led, req).collect()}
    assert got["x"].found and got["x"].submitted_by == "sender" and not got["missing"].found
    plan = L.get_records(spark, led, req)._jdf.queryExecution().toString()
    assert "id_bucket" in plan[plan.index("PartitionFilters"):]
    kept = sorted(map(str, L.read_ledger(spark, led).collect()))
    assert sorted(map(str, L.compact(spark, led, str(tmp_path / "compact")).collect())) == kept
    with pytest.raises(L.RecordNotFound):
        L.get_records(spark, led, req, strict=True)


def test_ledger_odd_submissions(spark, tmp_path):
    led, out, score = str(tmp_path / "ledger"), str(tmp_path / "outcome"), _scorer(False, False)
    b = _evidence(spark, [("d", "text d"), (None, "no id"), ("e", "text e")])
    twice = b.unionByName(b.where("evidence_id = 'd'"))
    r = {(x.evidence_id, x.sub_id): x for x in L.screen_and_record(twice, led, out, 0, score, "job-1").collect()}
    assert len(r) == 3 and r[("d", 0)].status == "recorded" and r[("e", 2)].status == "recorded"
    assert (r[(None, 1)].status, r[(None, 1)].message) == ("rejected", "Evidence id is missing")
    assert sorted(x.evidence_id for x in L.read_ledger(spark, led).collect()) == ["d", "e"]
    # another writer uses the same number
    other = _evidence(spark, [("f", "text f"), ("d", "again")])
    r = {x.evidence_id: x.status for x in L.screen_and_record(other, led, out, 0, score, "job-2").collect()}
    assert r == {"f": "recorded", "d": "rejected"} and L.read_ledger(spark, led).count() == 3


def test_the_text_is_scanned_once(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "subs")
    _evidence(spark, [("x", "first x"), ("y", "first y"), ("x", "second x")]).write.parquet(src)
    plans = []
    publish = L._publish
    monkeypatch.setattr(L, "_publish", lambda rows, *a: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), publish(rows, *a)))
    L.screen_and_record(spark.read.parquet(src), str(tmp_path / "l"), str(tmp_path / "o"), 0, _scorer(False, False))
    scans = [line for line in plans[0].split("\n") if "FileScan" in line and src in line]
    assert len(scans) == 1 and "text" in scans[0]


def test_shared_folder_is_needed_off_a_local_master(spark, monkeypatch):
    from unveil import session

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Far)


def test_flagship_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert sum(r.docs for r in rows) == 200


def test_hot_id_first_wins(spark, tmp_path):
    """One id holding a third of the batch: exactly its earliest arrival is recorded."""
    rows = [(f"id-{i}", f"text {i}") for i in range(40)] + [("hot", f"hot text {i}") for i in range(20)]
    subs = _evidence(spark, rows).withColumn("arrival", 1000 - F.col("sub_id"))  # later rows arrive first
    out = L.screen_and_record(subs, str(tmp_path / "l"), str(tmp_path / "o"), 0, _scorer(False, False)).collect()
    hot = [r for r in out if r.evidence_id == "hot"]
    assert len(hot) == 20
    assert [r.sub_id for r in hot if r.status == "recorded"] == [59]
    assert sum(r.status == "recorded" for r in out) == 41


def test_skip_model_when_conclusive(spark):
    ev = _evidence(spark, [("a", CORPUS[0][1]), ("b", "An ordinary invoice.")])
    v = {r.evidence_id: r for r in screen(ev, scorer=_scorer(False, True), skip_model_when_conclusive=True).collect()}
    assert v["a"].conclusive_tampering and v["a"].judge_reliable is None and v["a"].canary_tripped is None
    assert v["b"].judge_reliable is False and v["b"].canary_tripped is True
