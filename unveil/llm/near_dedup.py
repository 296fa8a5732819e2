"""MinHash near-duplicate classes by one-permutation hashing.

Each document's set of word shingles is hashed once. The 64-bit range is cut
into equal bins; a bin's value is the least hash in it, and an empty bin
borrows from the first non-empty bin of its own fixed random probe order
(optimal densification). Runs of bins form the band keys; how many bins a run
has follows from the threshold (``banding``). Documents
that share a band key are candidates, and each bucket is covered by a star
around its least id, so that a bucket of n members costs n - 1 pairs.
Candidates are confirmed on the full sets.

A star alone misses a link between two members that both differ too much from
the centre. Buckets that still span several components after the stars are
therefore compared exactly, in families or one by one, by size class and in
blocks of bounded size, inside tasks (``leftover_links``).
Only links leave those tasks; pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unveil.llm.components import components
from unveil.llm.shared import stored, text_of, with_group
from unveil.llm.textblocks import as_long, blocks, chain, mix, span_hashes, word_spans

WIDTH = 5
BINS = 150
PROBES = 64
MISS = 7.5e-6  # a pair at the threshold is no candidate with this probability at most


def banding(threshold: int) -> tuple[int, int]:
    """(bins a band, bands): the longest bands that keep to ``MISS`` at ``threshold`` percent.

    ``BINS`` bins are enough from 8 percent on; below, there are more bands of one bin.
    """
    if not 1 <= threshold <= 100:
        raise ValueError("the threshold is a percentage from 1 to 100")
    for rows in range(BINS, 0, -1):
        bands = BINS // rows
        if (1 - (threshold / 100) ** rows) ** bands <= MISS:
            return rows, bands
    return 1, ceil(log(MISS) / log1p(-threshold / 100))


@lru_cache
def _bins(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower edges of ``n`` bins, and the probe order of each."""
    edges = np.array([(i << 64) // n for i in range(n)], dtype=np.uint64)
    probe = (mix(np.arange(n * PROBES, dtype=np.uint64) + np.uint64(77)) % np.uint64(n)).astype(np.int64).reshape(n, PROBES)
    return edges, probe


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles.

    A row with fewer words than ``width`` has its whole word sequence as the
    one shingle; a row without words has none.
    """
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    runs = chain(hashes, width) if len(hashes) >= width else hashes[:0]
    for a, z in zip(first[:-1], first[1:]):
        if z - a >= width:
            yield np.unique(runs[a : z - width + 1])
        else:
            yield chain(hashes[a:z], z - a) if z > a else hashes[:0]


def densified(ordered: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The bin values of a non-empty sorted hash set."""
    edges, probe = _bins(bins)
    at = np.searchsorted(ordered, edges)
    filled = np.append(at[1:], len(ordered)) > at
    values = ordered[np.minimum(at, len(ordered) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = filled[probe[empty]]
        hit = probes.any(axis=1)
        source = probe[empty, probes.argmax(axis=1)]
        for i in np.flatnonzero(~hit):  # a few bins are filled: go on probing
            tries, step = empty[i], 0
            while not filled[tries]:
                step += 1
                tries = int(mix(np.array([empty[i] * 1_000_003 + PROBES + step], np.uint64))[0] % np.uint64(bins))
            source[i] = tries
        values[empty] = values[source]
    return values


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    parts = values.reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix(key + parts[:, k])
    return key


def signatures(docs: DataFrame, threshold: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (hash of the set), bands."""
    per_band, bands = banding(threshold)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                n, a, b, keys = [], [], [], []
                for one in shingle_sets(data, offsets):
                    n.append(len(one))
                    a.append(one.sum(dtype=np.uint64))
                    b.append(np.bitwise_xor.reduce(mix(one)) if len(one) else np.uint64(0))
                    keys.append(band_keys(densified(one, per_band * bands), per_band).view(np.int64) if len(one) else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n, pa.int64()), as_long(np.array(a, np.uint64)), as_long(np.array(b, np.uint64)), lists],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: int, per_star: int = 250) -> DataFrame:
    """The pairs (hub, member) whose full sets reach ``threshold`` percent.

    Texts travel to their star once; sets are built where they are compared.
    A star of more than ``per_star`` members is dealt over several tasks, each
    with its own copy of the centre, so a task holds one centre set at a time.
    """
    stars = pairs.groupBy("hub").agg(F.ceil(F.count("*") / per_star).cast("int").alias("parts"))
    members = with_group(pairs, stars, "hub").select(
        F.col("member").alias("doc_id"), "hub", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("is_member")
    )
    centres = stars.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_member"))
    rows = docs.join(members.unionByName(centres), "doc_id").select("hub", "part", "is_member", "doc_id", "text")
    dealt = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "is_member", "doc_id")

    def run(batches):
        star, centre = None, []
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                found = ([], [])
                cols = [rows.column(i).to_pylist() for i in range(4)]
                for hub, part, is_member, doc, one in zip(*cols, shingle_sets(data, offsets)):
                    if (hub, part) != star:
                        star, centre = (hub, part), []
                    if not is_member:
                        centre.append(one)
                        continue
                    for c in centre:
                        small, large = (c, one) if len(c) < len(one) else (one, c)
                        if not len(small) or 100 * len(small) < threshold * len(large):
                            continue
                        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        both = int((large[at] == small).sum())
                        if 100 * both >= threshold * (len(c) + len(one) - both):
                            found[0].append(hub)
                            found[1].append(doc)
                            break
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["hub", "member"])

    return dealt.mapInArrow(run, "hub long, member long")


def leftover_links(buckets: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int, block: int = 128) -> DataFrame:
    """Links (hub, member) between different components of one bucket.

    ``buckets`` (bucket, rep) lists the band keys, ``classes`` (rep, n,
    component) what the stars have joined. Buckets with one component need
    nothing. Buckets that share members overlap, so the rest are gathered into
    families (components of their stars). A family is compared as one group
    when that takes fewer pairs than its buckets one by one, as for many
    copies of one text; else, as where small buckets hang together in long
    chains, each bucket is a group. Two sets can only reach the threshold if
    their sizes fall into the same or adjacent classes of a geometric ladder,
    so a group is cut along its sizes; a cut with more than ``block``
    documents is dealt into blocks, and every two blocks meet in one cell. A
    cell holds two blocks at most.
    """
    labelled = buckets.join(classes, "rep")
    mixed = labelled.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("hub"), F.count("*").alias("size")
    ).where("lo != hi")
    held = stored(with_group(labelled, mixed.select("bucket", "hub", "size"), "bucket").select("bucket", "hub", "size", "rep"), "mixed-buckets")
    family = stored(components(held.select("hub", "rep").distinct(), "hub", "rep").select(F.col("node").alias("rep"), F.col("component").alias("family")), "families")
    whole = family.groupBy("family").agg(F.count("*").alias("members"))
    stars = held.select("bucket", "hub", "size").distinct().join(family.withColumnRenamed("rep", "hub"), "hub")
    cost = stars.groupBy("family").agg(F.sum(F.col("size") * F.col("size")).alias("apart"))
    choice = whole.join(cost, "family").select("family", F.expr("members * members <= apart").alias("as_one"))
    chosen = with_group(family, choice, "family")
    as_one = chosen.where("as_one").select("rep", F.lit(0).alias("kind"), F.col("family").alias("gid"))
    apart = chosen.where("not as_one").select("rep")
    one_by_one = held.join(apart, "rep", "left_semi").select("rep", F.lit(1).alias("kind"), F.col("bucket").alias("gid"))
    step = float(np.log(100 / threshold)) * 1.0001
    sized = as_one.unionByName(one_by_one).join(classes, "rep").withColumn("rung", F.floor(F.log("n") / step).cast("int"))
    placed = sized.withColumn("rung", F.explode(F.array(F.col("rung"), F.col("rung") + 1)))
    group = ["kind", "gid", "rung"]
    cuts = placed.groupBy(group).agg(
        F.ceil(F.count("*") / block).cast("int").alias("parts"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo != hi")
    mine = with_group(placed, cuts.drop("lo", "hi"), "gid", "kind", "rung").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    meets = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = [*group, "i", "j"]
    cells = meets.select(F.col("rep").alias("doc_id"), "component", *group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = docs.join(stored(cells, "cells"), "doc_id").select(*keys, "doc_id", "component", "text")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id")

    def links(docs_, comps, sets):
        """Pairs of one cell: shared hashes are counted by a matrix product in column chunks."""
        n = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        keep = count[inverse] > 1
        owner, column = owner[keep], shared[inverse[keep]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = 2048
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, z = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:z], column[a:z] - lo] = 1
            both += part @ part.T
        inter = both.astype(np.int64)
        good = 100 * inter >= threshold * (n[:, None] + n[None, :] - inter)
        a, b = np.nonzero(np.triu(good, 1))
        comps = np.array(comps)
        differ = comps[a] != comps[b]
        return docs_[a[differ]], docs_[b[differ]]

    def run(batches):
        cell, ids, comps, sets = None, [], [], []

        def finish():
            if len(set(comps)) > 1:
                a, b = links(np.array(ids), comps, sets)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["hub", "member"])

        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                cols = [rows.column(i).to_pylist() for i in range(7)]
                for *key, doc, comp, one in zip(*cols, shingle_sets(data, offsets)):
                    if key != cell:
                        yield from finish()
                        cell, ids, comps, sets = key, [], [], []
                    ids.append(doc)
                    comps.append(comp)
                    sets.append(one)
        yield from finish()

    return dealt.mapInArrow(run, "hub long, member long")


def near_duplicates(docs: DataFrame, threshold: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents link when 100 * shared >= threshold * union over their distinct
    5-word shingles (A-Z folded; a shorter text has one shingle, its whole
    sequence). component_id is the least doc_id reachable. Null, empty and
    word-less texts have no shingle and link with nothing. Rows that repeat a
    doc_id are versions of one document: each gets a row, and they share one
    class. A null doc_id links with nothing, has a null
    component and is kept. Columns beyond doc_id and text are not read.

    Equal sets are folded into one class by a partial aggregate before any
    candidate is built, so a group of exact copies of any size costs one row
    per task.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    sets = stored(signatures(rows, threshold), "signatures")
    linkable = sets.where("n_shingles > 0 and doc_id is not null")
    classes = stored(
        linkable.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes"
    )
    buckets = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("h"), F.count("*").alias("c")).where("c > 1")
    meeting = stored(with_group(buckets, hubs, "bucket").select("bucket", "rep", "n", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n")), "buckets")
    # texts move once: only documents that share a bucket are ever compared
    meets = meeting.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    texts = stored(rows.join(meets, "doc_id", "left_semi"), "texts")
    pairs = meeting.where(f"rep != hub and 100 * least(n, hub_n) >= {threshold} * greatest(n, hub_n)").select("hub", F.col("rep").alias("member"))
    links = stored(confirmed(stored(pairs.distinct(), "pairs"), texts, threshold), "links")
    first = components(links, "hub", "member")
    # a repeated doc_id may represent several sets: one row per id is enough here
    sizes = classes.groupBy("rep").agg(F.max("n_shingles").alias("n"))
    known = stored(
        sizes.join(first, sizes.rep == first.node, "left").select("rep", "n", F.coalesce("component", "rep").alias("component")), "known"
    )
    rest = stored(leftover_links(meeting.select("bucket", "rep"), known, texts, threshold), "leftover")
    again = linkable.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    repeats = linkable.join(again, "doc_id").join(classes, ["n_shingles", "set_a", "set_b"]).select(F.col("rep").alias("hub"), F.col("doc_id").alias("member"))
    last = components(links.unionByName(rest).unionByName(repeats), "hub", "member")
    member = sets.join(classes.select("n_shingles", "set_a", "set_b", "rep"), ["n_shingles", "set_a", "set_b"], "left")
    labelled = member.join(last, F.coalesce(member.rep, member.doc_id) == last.node, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return labelled.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
