"""The ledger's segments: two writers, the index, merges, lost runs."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from test_pipeline_ledger import _evidence, _scorer
from unveil.operators import ledger as L
from unveil.operators import segments as S
from unveil.sources import store

SCORE = _scorer(False, False)


def _paths(tmp_path):
    return str(tmp_path / "ledger"), str(tmp_path / "outcome")


def _rows(spark, ids, batch_id=0):
    """Ledger rows for ids, without scoring anything."""
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in L.LEDGER_SCHEMA.fields if f.name in L.RECORD_FIELDS and f.name not in ("evidence_id", "evidence_hash")]
    df = spark.createDataFrame([(i,) for i in ids], "evidence_id string").select("evidence_id", *null, F.sha2("evidence_id", 256).alias("evidence_hash"))
    return L.ledger_rows(df, batch_id)


def _add(spark, path, ids, batch_id, level=0):
    part = S.write_segment(_rows(spark, ids, batch_id), path, level)
    assert S.commit(spark, S.snapshot(spark, path), [part], batch=("w", batch_id))
    return part


def test_two_writers_store_an_id_once(spark, tmp_path):
    led, out = _paths(tmp_path)
    a = L.decide(_evidence(spark, [("x", "x of a"), ("y", "y of a")]), led, out, 0, SCORE, "a")
    b = L.decide(_evidence(spark, [("x", "x of b"), ("z", "z of b"), ("x", "again")]), led, out, 0, SCORE, "b")
    c = L.decide(_evidence(spark, [("z", "z of c")]), led, out, 0, SCORE, "c")
    assert L.read_ledger(spark, led).count() == 0
    for batch in (a, b, c):
        L.publish(spark, batch)
    held = {r.evidence_id: r.writer for r in L.read_ledger(spark, led).collect()}
    assert held == {"x": "a", "y": "a", "z": "b"} and L.read_ledger(spark, led).count() == 3
    said = {(r.writer, r.evidence_id, r.sub_id): (r.status, r.message, r.category) for r in spark.read.parquet(out).collect()}
    assert said[("b", "x", 0)] == ("rejected", "Evidence 'x' already screened", None)
    assert said[("b", "z", 1)][0] == said[("a", "x", 0)][0] == "recorded" and said[("c", "z", 0)][0] == "rejected"
    # a batch of nothing but lost ids is committed all the same
    assert S.snapshot(spark, led).committed("c", 0)
    # publishing once more changes nothing
    L.publish(spark, b)
    assert L.read_ledger(spark, led).count() == 3


def test_a_version_is_created_once(spark, tmp_path):
    path, wins = str(tmp_path / "log" / "000.json"), []
    threads = [threading.Thread(target=lambda k=k: wins.append(k) if store.create_once(spark, path, str(k)) else None) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(wins) == 1 and store.read_text(spark, path) == str(wins[0])
    assert store.names(spark, str(tmp_path / "log")) == ["000.json"]


def test_writers_at_the_same_time(spark, tmp_path):
    """Threads decide and publish as they come; the ledger holds each id once, as the outcomes say."""
    led, out = _paths(tmp_path)
    # the outcome folder is there, so that the first of two concurrent writers does not have to make it
    L.screen_and_record(_evidence(spark, [("seed", "s")]), led, out, 0, SCORE, "seed")
    work = {w: _evidence(spark, [(f"id-{k}", f"text {k}") for k in ks]) for w, ks in {"a": (1, 2, 3), "b": (2, 3, 4), "c": (3, 4, 5)}.items()}
    decided = {w: L.decide(subs, led, out, 0, SCORE, w) for w, subs in work.items()}
    threads = [threading.Thread(target=L.publish, args=(spark, b)) for b in decided.values()]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ids = [r.evidence_id for r in L.read_ledger(spark, led).collect()]
    assert sorted(ids) == ["id-1", "id-2", "id-3", "id-4", "id-5", "seed"]
    recorded = {(r.evidence_id, r.writer) for r in spark.read.parquet(out).where("status = 'recorded'").collect()}
    assert recorded == {(r.evidence_id, r.writer) for r in L.read_ledger(spark, led).collect()}


def test_a_lost_run_is_finished(spark, tmp_path, monkeypatch):
    """The run ends between outcome and publication; another writer takes an id; the replay yields it."""
    led, out = _paths(tmp_path)
    subs = _evidence(spark, [("x", "x"), ("y", "y")])
    L.decide(subs, led, out, 7, SCORE, "a")
    L.screen_and_record(_evidence(spark, [("x", "other x")]), led, out, 0, SCORE, "b")
    got = {r.evidence_id: r.status for r in L.screen_and_record(subs, led, out, 7, SCORE, "a").collect()}
    assert got == {"x": "rejected", "y": "recorded"}
    assert {r.evidence_id: r.writer for r in L.read_ledger(spark, led).collect()} == {"x": "b", "y": "a"}
    with pytest.raises(L.BatchConflict):
        L.screen_and_record(_evidence(spark, [("q", "q")]), led, out, 7, SCORE, "a")


def test_a_repeated_row_keeps_the_text_of_least_digest(spark, tmp_path):
    led, out = _paths(tmp_path)
    both = _evidence(spark, [("x", "one text"), ("x", "another text")]).withColumn("sub_id", F.lit(0).cast("bigint"))
    for k, df in enumerate((both.coalesce(1).orderBy("text"), both.coalesce(1).orderBy(F.desc("text")))):
        L.screen_and_record(df, f"{led}-{k}", f"{out}-{k}", 0, SCORE)
    a, b = ([r.evidence_hash for r in L.read_ledger(spark, f"{led}-{k}").collect()] for k in range(2))
    assert a == b and len(a) == 1


def test_files_read_do_not_grow_with_the_ledger(spark, tmp_path):
    """Ids of a batch are looked up in the files that can hold them, be the ledger ten times as large."""
    led = str(tmp_path / "ledger")
    asked = spark.createDataFrame([(f"p0-{i}",) for i in range(0, 300, 100)] + [("new-1",), (None,)], "evidence_id string")
    read = []
    for k in range(10):
        _add(spark, led, [f"p{k}-{i}" for i in range(300)], k)
        if k in (0, 9):
            snap = S.snapshot(spark, led)
            read.append(S.files_for(spark, snap, asked))
            assert sorted(r.evidence_id for r in L.ids_in(spark, snap, asked).collect()) == ["p0-0", "p0-100", "p0-200"]
    assert read[0] == read[1] and 1 <= len(read[0]) <= 3
    total = sum(len(s.files) for s in S.snapshot(spark, led).segments)
    assert total > 100  # of which at most three are opened
    none = spark.createDataFrame([(f"q{i}",) for i in range(50)], "evidence_id string")
    assert len(S.files_for(spark, S.snapshot(spark, led), none)) == 0
    # ids between those of each file's range are held off by the Bloom pages alone
    between = spark.createDataFrame([(f"p{k}-{i}x",) for k in range(10) for i in range(0, 300, 3)], "evidence_id string")
    assert len(S.files_for(spark, S.snapshot(spark, led), between)) < total / 2
    plan = L.get_records(spark, led, asked)._jdf.queryExecution().toString()
    assert "id_bucket" in plan[plan.index("PartitionFilters"):]


def test_every_stored_id_is_found(spark, tmp_path):
    """Range and Bloom pages have no false negatives, over several pages and files a bucket."""
    led = str(tmp_path / "ledger")
    ids = [f"{'ü' if i % 3 else 'a'}{i}" for i in range(20_000)]
    S.commit(spark, S.snapshot(spark, led), [S.write_segment(_rows(spark, ids), led)], batch=("w", 0))
    assert max(f["pages"] for s in S.snapshot(spark, led).segments for f in s.files) > 1
    df = spark.createDataFrame([(i,) for i in ids], "evidence_id string")
    assert L.ids_in(spark, S.snapshot(spark, led), df).distinct().count() == len(ids)


def test_large_segments_are_cut_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_FILE", 50)
    led = str(tmp_path / "ledger")
    part = S.write_segment(_rows(spark, [f"i{i:05d}" for i in range(2000)]), led)
    assert part.rows == 2000 and len(part.files) > 16
    by_bucket = {}
    for f in part.files:
        by_bucket.setdefault(f["bucket"], []).append((f["low"], f["high"]))
    for spans in by_bucket.values():
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_merges_bound_files_and_keep_readers(spark, tmp_path):
    led = str(tmp_path / "ledger")
    for k in range(4):
        _add(spark, led, [f"{k}-{i}" for i in range(20)], k)
    old = S.snapshot(spark, led)
    reader = S.rows_of(spark, old, L.LEDGER_SCHEMA)
    assert S.merge_levels(spark, led, L.LEDGER_SCHEMA, fanout=4) == 1
    new = S.snapshot(spark, led)
    assert [(s.level, s.rows) for s in new.segments] == [(1, 80)] and len(new.segments[0].files) <= 16 < sum(len(s.files) for s in old.segments)
    assert reader.count() == L.read_ledger(spark, led).count() == 80
    assert all(new.committed("w", k) for k in range(4)) and not new.committed("w", 4) and new.batches == {"w": [[0, 3]]}
    # merges of merges, and clearing what no kept snapshot names
    for k in range(4, 16):
        _add(spark, led, [f"{k}-{i}" for i in range(5)], k)
        S.merge_levels(spark, led, L.LEDGER_SCHEMA, fanout=4)
    snap = S.snapshot(spark, led)
    assert [(s.level, s.rows) for s in snap.segments] == [(2, 140)]
    under_way = S.write_segment(_rows(spark, ["later"], 99), led)
    assert S.vacuum(spark, led, keep=2) > 0
    folders = [n for n in os.listdir(os.path.join(led, "data")) if n.startswith("segment=")]
    assert f"segment={under_way.name}" in folders and len(folders) <= 6
    assert len(store.names(spark, os.path.join(led, "log"))) == 2
    assert S.commit(spark, S.snapshot(spark, led), [under_way], batch=("w", 99))
    assert L.read_ledger(spark, led).count() == 141


def test_a_merge_yields_to_commits_and_to_other_merges(spark, tmp_path, monkeypatch):
    led = str(tmp_path / "ledger")
    for k in range(2):
        _add(spark, led, [f"{k}-{i}" for i in range(3)], k)
    write, meanwhile = S.write_segment, []

    def slow(rows, path, level=0, n=None):
        out = write(rows, path, level, n)
        if level and not meanwhile:
            meanwhile.append(True)
            _add(spark, led, ["late"], 7)  # a batch is committed while the merge is at work
        return out

    monkeypatch.setattr(S, "write_segment", slow)
    assert S.merge_levels(spark, led, L.LEDGER_SCHEMA, fanout=2) >= 1
    assert sorted(r.evidence_id for r in L.read_ledger(spark, led).collect()) == ["0-0", "0-1", "0-2", "1-0", "1-1", "1-2", "late"]
    assert L.read_ledger(spark, led).count() == 7

    def beaten(rows, path, level=0, n=None):
        out = write(rows, path, level, n)
        if level and len(meanwhile) == 1:
            meanwhile.append(True)
            S.merge_levels(spark, led, L.LEDGER_SCHEMA, fanout=2)  # another job merges first
        return out

    _add(spark, led, ["p"], 8)
    _add(spark, led, ["q"], 9)
    monkeypatch.setattr(S, "write_segment", beaten)
    S.merge_levels(spark, led, L.LEDGER_SCHEMA, fanout=2)
    assert L.read_ledger(spark, led).count() == 9
    assert L.read_ledger(spark, led).select("evidence_id").distinct().count() == 9


def test_batches_merge_by_themselves(spark, tmp_path, monkeypatch):
    led, out = _paths(tmp_path)
    monkeypatch.setattr(S.merge_levels, "__defaults__", (2,))
    for k in range(3):
        L.screen_and_record(_evidence(spark, [(f"b{k}", "t"), ("all", "t")]), led, out, k, SCORE)
    levels = sorted(s.level for s in S.snapshot(spark, led).segments)
    assert levels == [0, 1]
    assert sorted((r.evidence_id, r.batch_id) for r in L.read_ledger(spark, led).collect()) == [("all", 0), ("b0", 0), ("b1", 1), ("b2", 2)]


def test_snapshots_are_plain_records(spark, tmp_path):
    led = str(tmp_path / "ledger")
    _add(spark, led, ["a"], 3)
    with open(os.path.join(led, "log", f"{0:012d}.json")) as f:
        said = json.load(f)
    assert said["version"] == 0 and said["batches"] == {"w": [[3, 3]]} and said["segments"][0]["files"][0]["rows"] == 1
    assert not S.commit(spark, S.Snapshot(led), [], batch=("other", 0))  # version 0 is taken
