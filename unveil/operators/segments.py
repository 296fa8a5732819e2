"""Storage of the verdict ledger: immutable segments behind numbered snapshots.

    <ledger>/log/<version>.json          a snapshot: live segments, their files, committed batches
    <ledger>/data/segment=<name>/id_bucket=<k>/*.parquet
    <ledger>/index/segment=<name>/*.parquet   Bloom pages of the segment's files

Rows become visible when a snapshot that names their segment has been created.
A version can be created once, so of two writers that started from the same
version one has to look at what the other added and try the next number.
Readers keep the snapshot they started from.

A file's ids are known by their range and by Bloom pages (one 64-bit word
an id, four bits in it), so a lookup reads only files that can hold what it asks for.
Segments of one level are merged into one of the next as soon as there
are FANOUT of them; a merged segment is cut by ranges of the id.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unveil.sources import store

BUCKETS = 16
ROWS_PER_FILE = 1_000_000
PAGE_WORDS = 256
IDS_PER_PAGE = 1024  # 16 bits an id
FANOUT = 8
KEPT_SNAPSHOTS = 2 * FANOUT
PAGES_SCHEMA = "file string, page int, words array<bigint>"


@dataclass
class Segment:
    name: str
    level: int
    files: list[dict]  # path (below data), bucket, low, high, rows, pages

    @property
    def rows(self) -> int:
        return sum(f["rows"] for f in self.files)


@dataclass
class Snapshot:
    path: str
    version: int = -1
    segments: list[Segment] = field(default_factory=list)
    batches: dict[str, list[list[int]]] = field(default_factory=dict)  # writer -> ranges of committed numbers

    def committed(self, writer: str, batch_id: int) -> bool:
        return any(lo <= batch_id <= hi for lo, hi in self.batches.get(writer, ()))

    def only(self, names: set[str]) -> Snapshot:
        return Snapshot(self.path, self.version, [s for s in self.segments if s.name in names], self.batches)


def id_bucket(evidence_id: Column) -> Column:
    """The ledger partition of an id."""
    return F.conv(F.substring(F.sha2(evidence_id, 256), 1, 1), 16, 10).cast("int")


def _log(path: str, version: int) -> str:
    return os.path.join(path, "log", f"{version:012d}.json")


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest snapshot, or the one of a version."""
    if version is None:
        known = _versions(spark, path)
        if not known:
            return Snapshot(path)
        version = known[-1]
    said = json.loads(store.read_text(spark, _log(path, version)))
    return Snapshot(path, version, [Segment(**s) for s in said["segments"]], said["batches"])


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in store.names(spark, os.path.join(path, "log")) if n.endswith(".json"))


def named(spark: SparkSession, path: str, versions: list[int] | None = None) -> set[str]:
    """Segments that snapshots in the log name."""
    return {s.name for v in (_versions(spark, path) if versions is None else versions) for s in snapshot(spark, path, v).segments}


def _with_number(ranges: list[list[int]], n: int) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted([*ranges, [n, n]]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def commit(spark: SparkSession, base: Snapshot, add: list[Segment], remove: set[str] = frozenset(), batch: tuple[str, int] | None = None) -> bool:
    """Creates the version after ``base``; False if another writer has created it."""
    batches = dict(base.batches)
    if batch:
        batches[batch[0]] = _with_number(batches.get(batch[0], []), batch[1])
    live = [s for s in base.segments if s.name not in remove] + [s for s in add if s.files]
    said = {"version": base.version + 1, "segments": [vars(s) for s in live], "batches": batches}
    return store.create_once(spark, _log(base.path, base.version + 1), json.dumps(said))


# ------------------------------------------------------------------ reading


def _data(spark: SparkSession, path: str, schema: T.StructType, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    base = os.path.join(path, "data")
    found = spark.read.schema(schema).option("basePath", base).parquet(*[os.path.join(base, p) for p in parts])
    return found.select([f.name for f in schema.fields])


def rows_of(spark: SparkSession, snap: Snapshot, schema: T.StructType) -> DataFrame:
    """All rows of a snapshot."""
    return _data(spark, snap.path, schema, [f"segment={s.name}" for s in snap.segments])


def _probe(evidence_id: Column, pages: Column) -> tuple[Column, Column, Column]:
    """Page, word in the page and the four bits of an id."""
    h = F.xxhash64(evidence_id)
    bits = None
    for k in range(4):
        one = F.expr("1L")
        bit = F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(F.xxhash64(evidence_id, F.lit(7)), 6 * k), F.lit(64)).cast("int"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return F.pmod(h, pages).cast("int"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(PAGE_WORDS)).cast("int"), bits


def files_for(spark: SparkSession, snap: Snapshot, ids: DataFrame) -> list[str]:
    """Files that can hold any of ``ids`` (evidence_id), by range and by Bloom page.

    The driver sees file names only. Ids meet the files of their bucket whose range holds them,
    at most one in each merged segment, and then one page in each.
    """
    listed = [(f["path"], f["bucket"], f["low"], f["high"], f["pages"]) for s in snap.segments for f in s.files]
    if not listed:
        return []
    files = spark.createDataFrame(listed, "file string, id_bucket int, low string, high string, pages int")
    keyed = ids.where(F.col("evidence_id").isNotNull()).select("evidence_id", id_bucket(F.col("evidence_id")).alias("id_bucket"))
    near = keyed.join(files, "id_bucket").where("evidence_id >= low and evidence_id <= high")
    page, word, bits = _probe(F.col("evidence_id"), F.col("pages"))
    asked = near.select("file", page.alias("page"), word.alias("word"), bits.alias("bits"))
    index = os.path.join(snap.path, "index")
    pages = spark.read.schema(PAGES_SCHEMA).option("basePath", index).parquet(*[os.path.join(index, f"segment={s.name}") for s in snap.segments])
    a, p = asked.alias("a"), pages.alias("p")
    held = F.get(F.col("p.words"), F.col("a.word")).bitwiseAND(F.col("a.bits")) == F.col("a.bits")
    on = (F.col("a.file") == F.col("p.file")) & (F.col("a.page") == F.col("p.page")) & held
    return sorted(r.file for r in a.join(p, on, "left_semi").select("file").distinct().collect())


def rows_that_may_match(spark: SparkSession, snap: Snapshot, schema: T.StructType, ids: DataFrame) -> DataFrame:
    """Rows of the files that can hold any of ``ids``."""
    return _data(spark, snap.path, schema, files_for(spark, snap, ids))


# ------------------------------------------------------------------ writing


def write_segment(rows: DataFrame, path: str, level: int = 0, n: int | None = None) -> Segment:
    """Writes ``rows`` (with evidence_id and id_bucket) as a segment that no snapshot names yet.

    A bucket gets one file for each ROWS_PER_FILE rows, cut by ranges of the id, however many tasks made the rows.
    """
    spark = rows.sparkSession
    name = f"s-{uuid.uuid4().hex[:16]}"
    n = rows.count() if n is None else n
    if not n:
        return Segment(name, level, [])
    base, place = os.path.join(path, "data"), f"segment={name}"
    parts = -(-n // (BUCKETS * ROWS_PER_FILE))
    dealt = rows.repartition(BUCKETS, "id_bucket") if parts == 1 else rows.repartitionByRange(BUCKETS * parts, "id_bucket", "evidence_id")
    dealt.sortWithinPartitions("id_bucket", "evidence_id").write.partitionBy("id_bucket").parquet(os.path.join(base, place))
    schema = T.StructType([T.StructField("evidence_id", T.StringType()), T.StructField("id_bucket", T.IntegerType())])
    stored = spark.read.schema(schema).option("basePath", base).parquet(os.path.join(base, place))
    ids = stored.select("evidence_id", "id_bucket", F.concat(F.lit(place + "/id_bucket="), F.col("id_bucket"), F.lit("/"), F.col("_metadata.file_name")).alias("file"))
    found = ids.groupBy("file", "id_bucket").agg(F.min("evidence_id").alias("low"), F.max("evidence_id").alias("high"), F.count("*").alias("rows")).collect()
    files = [{"path": r.file, "bucket": r.id_bucket, "low": r.low, "high": r.high, "rows": r.rows, "pages": -(-r.rows // IDS_PER_PAGE)} for r in found]
    sizes = spark.createDataFrame([(f["path"], f["pages"]) for f in files], "file string, pages int")
    page, word, bits = _probe(F.col("evidence_id"), F.col("pages"))
    words = ids.join(sizes, "file").select("file", page.alias("page"), word.alias("word"), bits.alias("bits")).groupBy("file", "page", "word").agg(F.bit_or("bits").alias("bits"))
    entries = words.groupBy("file", "page").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("at"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(PAGE_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0).cast("bigint")))
    pages = entries.select("file", "page", filled.alias("words"))
    pages.write.parquet(os.path.join(path, "index", place))
    return Segment(name, level, files)


def drop_segment(spark: SparkSession, path: str, name: str) -> None:
    for part in ("data", "index"):
        store.delete(spark, os.path.join(path, part, f"segment={name}"))


def merge_levels(spark: SparkSession, path: str, schema: T.StructType, fanout: int = FANOUT) -> int:
    """Merges levels that hold ``fanout`` segments or more; returns the number of merges.

    Batches committed meanwhile stay in; if another job has merged the same
    segments first, this merge is given up. Merged segments stay readable until ``vacuum``.
    """
    done = 0
    while True:
        snap = snapshot(spark, path)
        by_level: dict[int, list[Segment]] = {}
        for s in snap.segments:
            by_level.setdefault(s.level, []).append(s)
        full = [k for k, v in sorted(by_level.items()) if len(v) >= fanout]
        if not full:
            return done
        old = by_level[full[0]]
        names = {s.name for s in old}
        merged = write_segment(rows_of(spark, snap.only(names), schema), path, full[0] + 1, sum(s.rows for s in old))
        while names <= {s.name for s in snap.segments} and not commit(spark, snap, [merged], names):
            snap = snapshot(spark, path)
        if not names <= {s.name for s in snap.segments}:
            drop_segment(spark, path, merged.name)
            return done
        done += 1


def vacuum(spark: SparkSession, path: str, keep: int = KEPT_SNAPSHOTS) -> int:
    """Removes all but the newest ``keep`` snapshots and the segments that only removed ones name.

    Segments that no snapshot has named yet belong to batches under way and stay. A reader
    that has been at work for more than ``keep`` versions may lose its files.
    """
    versions = _versions(spark, path)
    gone, kept = versions[:-keep], versions[-keep:]
    dead = named(spark, path, gone) - named(spark, path, kept)
    for name in dead:
        drop_segment(spark, path, name)
    for v in gone:
        store.delete(spark, _log(path, v))
    return len(dead)
