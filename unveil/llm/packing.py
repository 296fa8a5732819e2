"""Best-fit packing into bins of several permitted capacities.

Documents are cut into pieces that fit the largest capacity. Pieces are dealt
at random into shards of bounded size, and each shard is packed on its own:
in falling order of length a piece goes to the open bin with the least room
that still holds it, and when none does, a bin of the size is opened that
costs least for each unit it would hold, judged by the pieces still to come.
Every bin is then downsized to the smallest capacity that holds its contents.
What a piece still to come will really do is not known when a bin is opened,
so the sizes are optimised jointly: packings with each permitted size as the
least, chosen at each opening or fixed, are made as well, and the cheapest wins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from operator import neg

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD = 20_000
OVERHEAD = 16  # cost of a bin besides its capacity


def cost_of(capacity: int, overhead: int = OVERHEAD) -> int:
    return capacity + overhead


def opening_size(lengths: list[int], i: int, sizes: tuple[int, ...], overhead: int = OVERHEAD) -> int:
    """The size whose bin, opened for ``lengths[i]``, costs least a unit held; ties to the smaller.

    The bin is thought to be filled from the pieces after ``i``, longest first.
    ``sizes`` rise and all hold the piece; ``lengths`` fall.
    """
    best = None
    for capacity in sizes:
        room, j = capacity - lengths[i], i + 1
        while room and (j := bisect_left(lengths, -room, j, key=neg)) < len(lengths):
            room -= lengths[j]
            j += 1
        held = capacity - room
        cost = cost_of(sizes[bisect_left(sizes, held)], overhead)
        if best is None or cost * best[1] < best[0] * held:
            best = (cost, held, capacity)
    return best[2]


def best_fit(lengths: list[int], capacities: tuple[int, ...], least: int, choose: bool = False, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin, offset in the bin, and fill of each bin, for lengths in falling order.

    New bins take the smallest capacity that holds the piece, and at least
    ``least``, or with ``choose`` the ``opening_size`` among those. Ties go to the bin opened first.
    """
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    fill: list[int] = []
    bins, offsets = [], []
    for k, n in enumerate(lengths):
        i = bisect_left(room, (n, -1))
        if i < len(room):
            left, b = room.pop(i)
        else:
            b = len(fill)
            sizes = capacities[bisect_left(capacities, max(n, least)) :]
            left = opening_size(lengths, k, sizes, overhead) if choose else sizes[0]
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        if left > n:
            insort(room, (left - n, b))
    return bins, offsets, fill


def pack_shard(lengths: list[int], capacities: tuple[int, ...], overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """The cheapest packing: bin, offset, and downsized capacity of each bin.

    Ties go to sizes chosen at each opening, then to the smaller least size. ``lengths`` must fall.
    """
    best = None
    for choose in (True, False):
        for least in capacities:
            bins, offsets, fill = best_fit(lengths, capacities, least, choose, overhead)
            final = [capacities[bisect_left(capacities, f)] for f in fill]
            cost = sum(cost_of(c, overhead) for c in final)
            if best is None or cost < best[0]:
                best = (cost, bins, offsets, final)
    return best[1:]


def pieces(docs: DataFrame, length, largest: int, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, copy, piece, start, length: whole documents, cut only above ``largest``.

    Rows that repeat (doc_id, length) are told apart by ``copy``, from 1. They
    are counted by a partial aggregate, so that a row that repeats without end
    is dealt over the shards like any other.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), length.cast("bigint").alias("n")).where("n > 0")
    copies = rows.groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    each = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    cut = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / largest).cast("bigint"))))
    start = F.col("piece") * largest
    return cut.select("doc_id", "copy", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.lit(largest).cast("bigint"), F.col("n") - start).alias("length"))


def pack(
    docs: DataFrame,
    capacities: tuple[int, ...] = CAPACITIES,
    text: str = "text",
    doc_id: str = "doc_id",
    shard: int = SHARD,
    overhead: int = OVERHEAD,
    length=None,
) -> DataFrame:
    """doc_id, copy, piece, start, length, bin_id, bin_offset, bin_capacity.

    The length of a document is its UTF-8 size in bytes plus one for the end
    mark, or the column given as ``length``; null and empty texts take the end
    mark alone. A document longer than the largest capacity is cut into pieces
    of that size and a rest. Every piece is placed once; bin_id is
    ``shard:number``. Rows that repeat a doc_id are packed each on its
    own; a null doc_id is kept. Other columns are not read.

    A shard holds ``shard`` pieces on average, whatever the size of the
    input, so a task packs a bounded number of small rows.
    """
    capacities = tuple(sorted(set(capacities)))
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1 if length is None else length
    parts = pieces(docs, size, capacities[-1], doc_id)
    total = parts.agg(F.count("*")).first()[0]
    shards = max(1, -(-total // shard))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece", "length"), F.lit(shards)).cast("int"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        bins, offsets, final = pack_shard(rows["length"].to_pylist(), capacities, overhead)
        number = rows["shard"][0].as_py()
        made = [pa.array([f"{number}:{b}" for b in bins]), pa.array(offsets, pa.int64()), pa.array([final[b] for b in bins], pa.int64())]
        return pa.table([*(rows[c] for c in ("doc_id", "copy", "piece", "start", "length")), *made], names=["doc_id", "copy", "piece", "start", "length", "bin_id", "bin_offset", "bin_capacity"])

    return dealt.groupBy("shard").applyInArrow(
        run, "doc_id long, copy long, piece int, start long, length long, bin_id string, bin_offset long, bin_capacity long"
    )
