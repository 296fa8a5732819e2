"""The state of ST1 with late replies: each document comes out once, whatever the order of arrival."""

import itertools
import random
from collections import Counter

from pyspark.sql import Row
from pyspark.sql import functions as F

from unveil.operators.pipeline import replies_by_evidence
from unveil.streaming.late_replies import DOCUMENT, AwaitBuckets, AwaitReplies, parsed_replies


class Held:
    """A state variable or list in memory."""

    def __init__(self, many):
        self.many, self.now = many, None

    def exists(self):
        return self.now is not None

    def get(self):
        return iter(self.now) if self.many else self.now

    def update(self, value):
        self.now = value

    def put(self, values):
        self.now = list(values)

    def appendList(self, values):
        self.now = [*(self.now or []), *values]

    def clear(self):
        self.now = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, name, schema):
        return Held(True)

    def getValueState(self, name, schema):
        return Held(False)

    def registerTimer(self, at):
        self.timers.add(at)


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def row(kind, until, doc=None, detected=None, category=None, words=None):
    return Row(kind=kind, until=until, doc=doc, detected=detected, category=category, words=words)


def play(batches, clock):
    """Feeds batches of rows, then lets the timers run up to ``clock``; returns what comes out and the state."""
    handle, p = Handle(), AwaitReplies()
    p.init(handle)
    out = []
    for batch in batches:
        out += list(p.handleInputRows(("x",), iter(batch), None))
    for at in sorted(t for t in handle.timers if t <= clock):
        out += list(p.handleExpiredTimer(("x",), None, Expired(at)))
    return out, p


DOC = row(DOCUMENT, 10, doc="d1")
FLAGGED = row("detection", 11, detected=True, category="hidden_instruction")
HARMLESS = row("detection", 12, detected=False, category="none")
CANARY = row("canary", 13, words="XG-A XG-B")


def test_any_order_and_any_batches_give_one_verdict():
    for order in itertools.permutations([DOC, FLAGGED, CANARY]):
        for cuts in ([order], [[r] for r in order], [order[:1], order[1:]], [order[:2], order[2:]]):
            out, p = play(cuts, clock=100)
            assert [(r.doc, r.reply_detected, r.reply_category, r.words, r.has_detection, r.has_canary) for r in out] == [
                ("d1", True, "hidden_instruction", "XG-A XG-B", True, True)
            ]
            assert not p.docs.exists() and not p.fold.exists()  # nothing is left behind


def test_documents_time_out_with_what_has_arrived():
    out, p = play([[DOC], [HARMLESS]], clock=10)
    assert [(r.doc, r.has_detection, r.has_canary, r.reply_category) for r in out] == [("d1", True, False, "none")]
    assert p.fold.exists()  # until its own time is over
    out, p = play([[DOC], [HARMLESS], [CANARY]], clock=9)
    assert len(out) == 1 and out[0].has_canary
    out, p = play([[CANARY, FLAGGED]], clock=100)
    assert out == [] and not p.fold.exists()


def test_several_documents_of_an_id():
    later = row(DOCUMENT, 50, doc="d2")
    out, p = play([[DOC, later], [HARMLESS]], clock=20)
    assert [r.doc for r in out] == ["d1"] and [d[0] for d in p.docs.get()] == ["d2"]
    out, _ = play([[DOC], [HARMLESS, CANARY], [later]], clock=0)
    assert [r.doc for r in out] == ["d1", "d2"]
    # an empty id still times out
    assert [r.doc for r in play([[row("clock", 5)], [DOC]], clock=10)[0]] == ["d1"]


def test_the_fold_is_the_batch_fold(spark):
    replies = [
        ("a", "detection", '{"injection_detected": false, "category": "none"}'), ("a", "detection", '{"injection_detected": true, "category": "fake_role"}'),
        ("a", "detection", '{"injection_detected": true, "category": "base64"}'), ("a", "canary", "XG-ABCDEFGHIJ and XG-0123456789"), ("a", "canary", None),
        ("b", "detection", "no json"), ("b", "canary", "XG-ABCDEFGHIJ XG-ABCDEFGHIJ"), ("c", "detection", None), ("d", "canary", "nothing"),
    ]
    df = spark.createDataFrame(replies, "evidence_id string, kind string, response string")
    want = {r.evidence_id: (r.reply_detected, r.reply_category, sorted(r.reply_words), r.has_detection, r.has_canary) for r in replies_by_evidence(df).collect()}
    parsed = parsed_replies(df.withColumn("at", F.current_timestamp())).collect()
    got = {}
    for name in want:
        rows = [row(r.kind, 5, detected=r.detected, category=r.category, words=r.words) for r in parsed if r.evidence_id == name]
        for order in ([rows], [rows[::-1]], [[r] for r in rows]):
            _, p = play(order, clock=0)
            detected, category, other, words, has_detection, has_canary, _ = p.fold.now
            found = (detected, other if category is None else category, words.split(), has_detection, has_canary)
            assert got.setdefault(name, found) == found
    assert got == want


def test_the_stream_runs(spark):
    from unveil.plans.streaming_queries import st1_late_replies

    rows = st1_late_replies(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r.evidence_id for r in rows}) == 200
    assert {r.reply_state for r in rows} == {"complete", "missing_canary", "missing_detection"}


class Counted(Held):
    """A state variable that counts the trips to it."""

    trips = 0

    def get(self):
        Counted.trips += 1
        return super().get()

    def update(self, value):
        Counted.trips += 1
        super().update(value)

    def clear(self):
        Counted.trips += 1
        super().clear()


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_bucket_is_its_ids_one_by_one():
    """Batches and timers over a bucket give what they give over each id, for few trips to the state."""
    rng = random.Random(4)
    ids = [None, "", *(f"e{i}" for i in range(60))]
    for clocks in ([0, 0, 0, 0], [3, 9, 14, 40], [0, 12, 13, 100]):
        batches = []
        for passed in [0, *clocks[:-1]]:  # rows whose time is up do not reach the state
            rows = []
            for _ in range(150):
                kind, until = rng.choice([DOCUMENT, "detection", "canary", "clock"]), passed + rng.randint(1, 20)
                made = {DOCUMENT: {"doc": f"d{rng.random()}"}, "detection": {"detected": rng.choice([True, False, None]), "category": rng.choice(["a", "b", None])}, "canary": {"words": rng.choice(["X Y", "Z", None])}}
                rows.append(Row(evidence_id=rng.choice(ids), **row(kind, until, **made.get(kind, {})).asDict()))
            batches.append(rows)
        want, one = Counter(), {}
        bucket, handle, got = AwaitBuckets(), Handle(), Counter()
        handle.getValueState = lambda name, schema: Counted(False)
        bucket.init(handle)
        for rows, now in zip(batches, clocks):
            for x in ids:
                own = [r for r in rows if r.evidence_id == x]
                if x not in one:
                    one[x] = AwaitReplies(), Handle()
                    one[x][0].init(one[x][1])
                p, h = one[x]
                want.update(p.handleInputRows((x,), iter(own), None) if own else ())
                for at in sorted(t for t in h.timers if t <= now):
                    want.update(p.handleExpiredTimer((x,), None, Expired(at)))
                h.timers = {t for t in h.timers if t > now}
            Counted.trips = 0
            got.update(bucket.handleInputRows((7,), iter(rows), None))
            bucket.seen = {}  # a task of its own
            for at in sorted(t for t in handle.timers if t <= now):
                got.update(bucket.handleExpiredTimer((7,), Clock(now), Expired(at)))
            handle.timers = {t for t in handle.timers if t > now}
            assert Counted.trips <= 4
            assert got == want
            held = {x: ([tuple(d) for d in p.docs.get()] if p.docs.exists() else [], p._replies()) for x, (p, _) in one.items()}
            assert bucket._load() == {x: v for x, v in held.items() if v[0] or one[x][0].fold.exists()}


def test_rounds_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from unveil.plans import streaming_queries as S

    rows = [(i, None if i == 4 else f"text {i}", "en", "web") for i in range(60)] + [(7, "text 7, once more", "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(S, "work_path", lambda spark, name: str(tmp_path / name))
    got = Counter((r.evidence_id, r.reply_state) for r in S.st1_late_replies(spark, str(tmp_path)).collect())
    state = lambda i: "missing_canary" if i % 17 == 3 else "missing_detection" if i % 19 == 5 else "complete"
    assert got == Counter((f"doc-{i}", state(i)) for i, *_ in rows)
    files = [f for f in (tmp_path / "late-replies" / "replies").iterdir() if f.suffix == ".parquet"]
    assert len(files) > 2 * (S.ROUNDS + 1)
