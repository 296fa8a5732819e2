"""P2 with a content-addressed reply cache: calls, races, null prompts and replies."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from unveil.operators import reply_cache as C
from unveil.operators import segments as S


def _prompts(spark, rows):
    return spark.createDataFrame(rows, "evidence_id string, kind string, prompt string")


@pytest.fixture()
def counted(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(len(prompts))
        return pd.Series([None if p.startswith("mute") else f"re {k} {p}" for k, p in zip(prompts["kind"], prompts["prompt"])], index=prompts.index, dtype=object)

    return calls, model


def _told(df):
    return sorted((r.evidence_id, r.kind, r.response, r.asked_in) for r in df.collect())


def test_each_distinct_prompt_is_asked_once(spark, tmp_path, counted):
    calls, model = counted
    path = str(tmp_path / "cache")
    hot = [(f"h{i}", "detection", "same text") for i in range(300)]
    first = [*hot, ("a", "canary", "same text"), ("b", "detection", "other"), ("b", "detection", "other")]
    got = C.answer(_prompts(spark, first), model, path, "one").collect()
    assert calls.value == 3 and len(got) == len(first)
    assert sorted((r.evidence_id, r.kind, r.response) for r in got) == sorted((e, k, f"re {k} {p}") for e, k, p in first)
    second = [("c", "detection", "same text"), ("d", "detection", "new")]
    assert _told(C.answer(_prompts(spark, second), model, path, "two")) == [
        ("c", "detection", "re detection same text", "one"), ("d", "detection", "re detection new", "two")
    ]
    assert calls.value == 4
    C.answer(_prompts(spark, [*first, *second]), model, path, "three").collect()
    assert calls.value == 4


def test_null_prompts_and_replies(spark, tmp_path, counted):
    calls, model = counted
    path = str(tmp_path / "cache")
    rows = [("a", "detection", None), ("b", "detection", "mute"), ("c", "detection", ""), ("d", None, "no kind")]
    want = [("a", "detection", None, None), ("b", "detection", None, None), ("c", "detection", "re detection ", "one"), ("d", None, "re None no kind", "one")]
    key = lambda r: r[0]
    assert sorted(((r.evidence_id, r.kind, r.response, r.asked_in) for r in C.answer(_prompts(spark, rows), model, path, "one").collect()), key=key) == want
    assert calls.value == 3
    C.answer(_prompts(spark, rows), model, path, "two").collect()
    assert calls.value == 4  # the mute one is asked again
    assert C.answer(_prompts(spark, []), model, path, "three").collect() == []


def test_two_jobs_that_ask_at_once_keep_one_reply(spark, tmp_path, counted):
    _, model = counted
    path = str(tmp_path / "cache")
    mine = _prompts(spark, [("a", "detection", "both"), ("b", "detection", "mine")])
    theirs = _prompts(spark, [("c", "detection", "both"), ("d", "detection", "theirs")])
    commit, ran = S.commit, []

    def late(spark_, base, add, *more, **named):
        if not ran:  # another job commits between this one's snapshot and its commit
            ran.append(1)
            C.answer(theirs, model, path, "theirs").collect()
        return commit(spark_, base, add, *more, **named)

    S.commit = late
    try:
        got = _told(C.answer(mine, model, path, "mine"))
    finally:
        S.commit = commit
    assert got == [("a", "detection", "re detection both", "theirs"), ("b", "detection", "re detection mine", "mine")]
    stored = S.rows_of(spark, S.snapshot(spark, path), C.CACHE_SCHEMA)
    assert stored.count() == 3 and stored.select(F.count_distinct("evidence_id")).first()[0] == 3
