"""ST1 where replies come after the documents.

Documents and replies are two streams. A document waits in the state store of its evidence id
until a detection and a canary reply are there, and comes out once, with the
replies folded as in the batch path; or, when ``wait`` has passed by event
time, with what has arrived (``reply_state`` names what is missing). Replies are parsed
before they enter the state, which keeps their fold and, of a waiting document,
the few columns that a verdict needs and no text. Verdicts are the batch expressions on what comes out.

The state of many evidence ids is one value, a bucket: each call to the state store takes a trip
out of the Python worker, and a document would need some twenty of them. A bucket is read and written
once a micro-batch that has rows for it; ``buckets`` is fixed for the life of a checkpoint.

``at`` is the time of arrival of a row; rows more than ``late`` behind the newest are not taken any more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from unveil.functions import judge as J
from unveil.operators.pipeline import CANARY_WORDS, VERDICT_COLUMNS, prepare, verdicts
from unveil.session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FOLD = T.StructType(
    [
        T.StructField("detected", T.BooleanType()),
        T.StructField("category_detected", T.StringType()),  # the least among replies that detect
        T.StructField("category_other", T.StringType()),
        T.StructField("words", T.StringType()),  # with a blank between them
        T.StructField("has_detection", T.BooleanType()),
        T.StructField("has_canary", T.BooleanType()),
        T.StructField("until", T.LongType()),
    ]
)
NO_REPLY = (None, None, None, "", False, False, None)
WAITING = T.StructType([T.StructField("doc", T.StringType()), T.StructField("until", T.LongType())])
OUT = "evidence_id string, doc string, reply_detected boolean, reply_category string, words string, has_detection boolean, has_canary boolean"
DOCUMENT = "document"
BUCKET = T.StructType([T.StructField("held", T.StringType())])
BUCKETS = 1 << 14


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def absorbed(fold: tuple, row: Row) -> tuple:
    """The fold of an evidence id with one more reply."""
    detected, category, other, words, has_detection, has_canary, last = fold
    if row.kind == "detection":
        detected = bool(row.detected) or bool(detected)
        category = _least(category, row.category) if row.detected else category
        other, has_detection = _most(other, row.category), True
    else:
        words, has_canary = " ".join(sorted({*words.split(), *(row.words or "").split()})), True
    return (detected, category, other, words, has_detection, has_canary, _most(last, row.until))


def with_fold(evidence_id: str | None, doc: str, fold: tuple) -> Row:
    """What comes out for a document."""
    detected, category, other, words, has_detection, has_canary, _ = fold
    return Row(
        evidence_id=evidence_id, doc=doc, reply_detected=detected, reply_category=other if category is None else category,
        words=words, has_detection=has_detection, has_canary=has_canary,
    )


def over(fold: tuple, rest: list, now: int) -> bool:
    """Whether a fold is no longer needed, with the documents that still wait."""
    return not rest and fold[-1] is not None and fold[-1] <= now


class AwaitReplies(StatefulProcessor):
    """Holds the documents of one evidence id until both kinds of reply are there, or their time is up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.docs = handle.getListState("docs", WAITING)
        self.fold = handle.getValueState("fold", FOLD)

    def close(self) -> None:
        pass

    def _replies(self) -> tuple:
        return tuple(self.fold.get()) if self.fold.exists() else NO_REPLY

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fold, new, times = self._replies(), [], set()
        before = fold
        for row in rows:
            if row.kind == DOCUMENT:
                new.append((row.doc, row.until))
            elif row.kind in ("detection", "canary"):
                fold = absorbed(fold, row)
            else:
                continue
            times.add(row.until)
        if fold != before:
            self.fold.update(fold)
        if fold[4] and fold[5]:
            waiting = [tuple(d) for d in self.docs.get()] if self.docs.exists() else []
            if waiting:
                self.docs.clear()
            for doc, _ in [*waiting, *new]:
                yield with_fold(key[0], doc, fold)
        elif new:
            self.docs.appendList(new)
        for until in times:
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, fold = expiredTimerInfo.getExpiryTimeInMs(), self._replies()
        waiting = [tuple(d) for d in self.docs.get()] if self.docs.exists() else []
        late = [d for d in waiting if d[-1] <= now]
        rest = [d for d in waiting if d[-1] > now]
        for doc, _ in late:
            yield with_fold(key[0], doc, fold)
        if late and rest:
            self.docs.put(rest)
        elif late:
            self.docs.clear()
        if over(fold, rest, now):
            self.fold.clear()


class AwaitBuckets(StatefulProcessor):
    """``AwaitReplies`` for all evidence ids of a bucket, whose documents and folds are one value of the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", BUCKET)
        self.seen: dict = {}  # how far timers of a bucket have been dealt with in this task

    def close(self) -> None:
        pass

    def _load(self) -> dict[str | None, tuple[list, tuple]]:
        """Waiting documents (doc, until) and the fold of each evidence id."""
        found = self.held.get()
        return {x: ([tuple(d) for d in docs], tuple(fold)) for x, docs, fold in json.loads(found[0])} if found else {}

    def _store(self, held: dict[str | None, tuple[list, tuple]]) -> None:
        if held:
            self.held.update((json.dumps([(x, docs, fold) for x, (docs, fold) in held.items()], separators=(",", ":")),))
        else:
            self.held.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, touched, times = self._load(), set(), set()
        for row in rows:
            x = row.evidence_id
            docs, fold = held.get(x, ([], NO_REPLY))
            if row.kind == DOCUMENT:
                docs.append((row.doc, row.until))
            elif row.kind in ("detection", "canary"):
                fold = absorbed(fold, row)
            else:
                continue
            held[x] = docs, fold
            touched.add(x)
            times.add(row.until)
        if not touched:
            return
        for x in touched:
            docs, fold = held[x]
            if fold[4] and fold[5]:
                for doc, _ in docs:
                    yield with_fold(x, doc, fold)
                held[x] = [], fold
        self._store(held)
        for until in times:
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at <= self.seen.get(key[0], at - 1):
            return
        # the watermark has passed all timers that fire now, so the first one settles the bucket
        now = self.seen[key[0]] = max(at, timerValues.getCurrentWatermarkInMs())
        held, kept = self._load(), {}
        for x, (docs, fold) in held.items():
            for doc, until in docs:
                if until <= now:
                    yield with_fold(x, doc, fold)
            rest = [d for d in docs if d[-1] > now]
            fold = NO_REPLY if over(fold, rest, now) else fold
            if rest or fold != NO_REPLY:
                kept[x] = rest, fold
        if kept != held:
            self._store(kept)


def parsed_replies(replies: DataFrame) -> DataFrame:
    """(evidence_id, kind, response, at) -> evidence_id, kind, at, detected, category, words."""
    p = J.parse_response(F.when(F.col("kind") == "detection", F.col("response")))
    words = F.when(F.col("kind") == "canary", F.array_join(F.regexp_extract_all("response", F.lit(CANARY_WORDS), F.lit(1)), " "))
    return replies.select("evidence_id", "kind", "at", p.alias("p"), words.alias("words")).select(
        "evidence_id", "kind", "at", F.col("p.detected").alias("detected"), F.col("p.category").alias("category"), "words"
    )


def screen_with_late_replies(evidence: DataFrame, replies: DataFrame, wait: timedelta, late: timedelta, *carry: str, buckets: int = BUCKETS) -> DataFrame:
    """Verdicts of a stream of evidence rows, each once, when its replies are there or ``wait`` is over.

    ``evidence`` needs what ``prepare`` needs and ``at``; ``replies`` needs
    evidence_id, kind, response and ``at``. Rows without an evidence id never get a reply: they
    come out when their time is up. ``buckets`` should grow with the ids that are held at a time (some 64 each). Needs the RocksDB state store (``ROCKSDB`` under ``PROVIDER``) when started.
    """
    spark = evidence.sparkSession
    ship_package(spark)
    p = prepare(evidence)
    fields = [*carry, "canary_word", "conclusive", "evidence_hash", "removed_items"]
    kept = T.StructType([p.schema[c] for c in fields])
    docs = p.select("evidence_id", F.lit(DOCUMENT).alias("kind"), "at", F.to_json(F.struct(*fields)).alias("doc"))
    both = docs.unionByName(parsed_replies(replies), allowMissingColumns=True).withWatermark("at", f"{int(late.total_seconds())} seconds")
    timed = both.withColumn("until", F.unix_millis("at") + int(wait.total_seconds() * 1000))
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("evidence_id"), F.lit(buckets)))
    ready = dealt.groupBy("bucket").transformWithState(AwaitBuckets(), OUT, "Append", "EventTime")
    words = F.when(F.col("words") != "", F.split("words", " "))
    opened = ready.select("*", F.from_json("doc", kept).alias("d"), words.alias("reply_words")).select("*", "d.*").drop("d", "doc", "words")
    return verdicts(opened).select("evidence_id", *carry, *VERDICT_COLUMNS, "reply_state")
