"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds, for a text of n code points, H[i] = sum over j < i of
c[j] * B**j modulo the Mersenne prime 2**31 - 1, for two bases. Any span's hash
follows from two entries, so spans compare in constant time and the longest
common extension of two positions is a binary search. A fingerprint is made of

* the length and the hash of the whole text,
* hashes of the prefixes on a fixed ladder of lengths, in which the longest
  common prefix of two texts is found by binary search, and
* the ``SKETCH`` smallest mixed hashes of all spans of ``SPAN`` code points.

Likeness is 1 for equal hashes; else the larger of the shared-span estimate
(Jaccard, from the union of the two sketches) and the share of the longer text
that the common prefix covers.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unveil.llm.ordered import bucket_of, buckets_for, id_cuts
from unveil.llm.shared import text_of
from unveil.llm.textblocks import mix

P = (1 << 31) - 1
BASES = (1_073_741_827, 715_827_883)
SPAN = 24
SKETCH = 64
LADDER = tuple(sorted({int(8 * 1.125**k) for k in range(140)}))
_cache: dict[tuple[int, bool], np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo P for 0 <= x < 2**62."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    x[x >= P] -= P
    return x


def _powers(k: int, n: int, down: bool = False) -> np.ndarray:
    """B**0 .. B**(n - 1), or those of the inverse, by doubling."""
    base = pow(BASES[k], -1, P) if down else BASES[k]
    have = _cache.get((k, down), np.ones(1, np.int64))
    while len(have) < n:
        have = np.concatenate([have, _mod(have * pow(base, len(have), P))])
    _cache[k, down] = have
    return have[:n]


class PrefixHash:
    """Prefix hash arrays of a sequence of code points."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        c = codes.astype(np.int64) + 1
        self.h = []
        for k in range(len(BASES)):
            sums = np.zeros(self.n + 1, np.int64)
            # n terms below 2**31 each: no overflow below 2**32 code points
            np.cumsum(_mod(c * _powers(k, self.n)), out=sums[1:])
            self.h.append(_mod(sums))

    def spans(self, start: np.ndarray, length: int) -> np.ndarray:
        """62-bit hashes of the spans of ``length`` at ``start``; equal spans have equal hashes wherever they stand."""
        out = np.zeros(len(start), np.uint64)
        for k, h in enumerate(self.h):
            moved = _mod(h[start + length] - h[start] + P) * _powers(k, self.n + 1, down=True)[start]
            out = (out << np.uint64(31)) | _mod(moved).astype(np.uint64)
        return out

    def all_spans(self, length: int) -> np.ndarray:
        """Hashes of every span of ``length``, in order."""
        m = max(0, self.n - length + 1)
        out = np.zeros(m, np.uint64)
        for k, h in enumerate(self.h if m else ()):
            moved = _mod(h[length:] - h[:m] + P) * _powers(k, m, down=True)
            out = (out << np.uint64(31)) | _mod(moved).astype(np.uint64)
        return out

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), end - start)[0])

    def prefix(self, lengths: np.ndarray) -> np.ndarray:
        return (self.h[0][lengths].astype(np.uint64) << np.uint64(31)) | self.h[1][lengths].astype(np.uint64)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int, back: bool = False) -> int:
    """Length of the longest common run of a[i:] and b[j:], or with ``back`` of the ends of a[:i] and b[:j].

    Binary search over span equality: a span's sum at i is B**(i - j) times that at j.
    """
    sides = [(x, y, int(x[i]), int(y[j]), pow(base, i - j, P)) for base, x, y in zip(BASES, a.h, b.h)]
    way = -1 if back else 1
    lo, hi = 0, min(i, j) if back else min(a.n - i, b.n - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        step = way * mid
        if all((int(x[i + step]) - x0 - f * (int(y[j + step]) - y0)) % P == 0 for x, y, x0, y0, f in sides):
            lo = mid
        else:
            hi = mid - 1
    return lo


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """The SKETCH least distinct values, ascending; exact."""
    if len(hashes) > 8 * SKETCH:
        few = np.unique(hashes[hashes <= np.partition(hashes, 4 * SKETCH)[4 * SKETCH]])
        if len(few) >= SKETCH:
            return few[:SKETCH]
    return np.unique(hashes)[:SKETCH]


class Sketcher:
    """What the fingerprints of a text and of its edits need, made once for each text."""

    def __init__(self, text: str):
        self.text, self.codes = text, codes_of(text)
        self.hash = PrefixHash(self.codes)
        n = len(self.codes)
        self.spans = mix(self.hash.all_spans(SPAN))


def _written(n: int, whole: int, ladder: np.ndarray, sketch: np.ndarray) -> str:
    return f"{n:x}:{whole:016x}:{(ladder >> np.uint64(30)).astype('>u4').tobytes().hex()}:{(sketch >> np.uint64(32)).astype('>u4').tobytes().hex()}"


_ladder = np.array(LADDER)


def fingerprint(s: Sketcher) -> str:
    n = s.hash.n
    whole = int(s.hash.prefix(np.array([n]))[0])
    sketch = _smallest(s.spans) if n >= SPAN else mix(np.array([whole], np.uint64))[: min(n, 1)]
    return _written(n, whole, s.hash.prefix(_ladder[_ladder <= n]), sketch)


def edited_fingerprint(s: Sketcher, keep: int, other: Sketcher, taken: int) -> str:
    """Fingerprint of s.text[:keep] + other.text[:taken] from the two texts' own arrays.

    H of the joined text is H of the first part, then H(keep) + B**keep * H'
    of the second; only the spans that cross the seam are hashed anew.
    """
    n = keep + taken
    lengths = np.append(_ladder[_ladder <= n], n)
    inside = np.minimum(lengths, keep)
    beyond = lengths - inside
    parts = []
    for k in range(len(BASES)):
        jump = pow(BASES[k], keep, P)
        parts.append(_mod(s.hash.h[k][inside] + _mod(other.hash.h[k][beyond] * jump)).astype(np.uint64))
    joined = (parts[0] << np.uint64(31)) | parts[1]
    whole = int(joined[-1])
    if n < SPAN:
        sketch = mix(np.array([whole], np.uint64))[: min(n, 1)]
    else:
        lo, hi = max(0, keep - SPAN + 1), min(n, keep + SPAN - 1)
        seam = np.concatenate([s.codes[lo:keep], other.codes[: hi - keep]])
        crossing = PrefixHash(seam)
        sketch = _smallest(
            np.concatenate([s.spans[: max(0, keep - SPAN + 1)], mix(crossing.all_spans(SPAN)), other.spans[: max(0, taken - SPAN + 1)]])
        )
    return _written(n, whole, joined[:-1], sketch)


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone; equal texts have 1, an empty text has 0 with any other."""
    if a == b:
        return 1.0
    (na, ha, la, sa), (nb, hb, lb, sb) = a.split(":"), b.split(":")
    if na == "0" or nb == "0":
        return 0.0
    x, y = np.frombuffer(bytes.fromhex(sa), ">u4"), np.frombuffer(bytes.fromhex(sb), ">u4")
    union = np.union1d(x, y)[:SKETCH]
    shared = np.isin(union, x) & np.isin(union, y)
    lo, hi = 0, min(len(la), len(lb)) // 8
    while lo < hi:  # prefixes of the ladder agree up to some rung
        mid = (lo + hi + 1) // 2
        if la[8 * mid - 8 : 8 * mid] == lb[8 * mid - 8 : 8 * mid]:
            lo = mid
        else:
            hi = mid - 1
    prefix = LADDER[lo - 1] / max(int(na, 16), int(nb, 16)) if lo else 0.0
    return float(max(shared.sum() / max(len(union), 1), prefix))


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document next to the one that follows it in descending id order.

    Returns bucket, guest, doc_id, text, dealt and sorted so that within a
    task each row is followed by its next document: rows go to quantile
    buckets of the id, and each bucket ends with a guest, the first row of the
    bucket below (for the lowest bucket, the largest id of all). Texts are
    shuffled once. Null ids come last; rows that repeat an id are ordered by
    length and text hash.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    parts = buckets_for(rows)
    cuts = id_cuts(rows.select("doc_id"), "doc_id", parts)
    placed = rows.withColumn("bucket", bucket_of(F.col("doc_id"), cuts, parts))
    # null ids sort below every id, in bucket 0
    tops = sorted((r.bucket, r.top) for r in placed.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    above = {}  # largest id of a bucket -> the bucket that it closes
    for i, (bucket, top) in enumerate(tops):
        above[top] = tops[(i + 1) % len(tops)][0]
    ids = {k: v for k, v in above.items() if k is not None}
    if ids:
        # one row a bucket: as many as asked for, whatever the size of the table
        closes = docs.sparkSession.createDataFrame([(int(k), int(v)) for k, v in ids.items()], "doc_id bigint, bucket int")
        guests = rows.join(F.broadcast(closes), "doc_id")
    else:  # no row has an id: all follow each other in one bucket
        guests = placed
    both = placed.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    return both.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.length("text"), F.xxhash64("text"))


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness.

    The edited text keeps the first n_chars - floor(n_chars / 2) code points
    and goes on with the first floor(n_chars / 2) of the next document in
    descending id order (all of it, if shorter; after the last comes the
    first, which for a single row is the row itself). Null texts are empty;
    an empty text has the fingerprint of length 0 and likeness 1 only with
    another empty text. Columns beyond the two are not read.

    prefix_edited, suffix_edited, prefix_next and suffix_next are the exact numbers of code
    points that the text shares with the start and the end of the other one,
    found by longest common extensions over the prefix hashes of both.
    """

    def run(batches):
        bucket, held = None, None
        for batch in batches:
            done: list[tuple] = []
            for row_bucket, guest, doc, body in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if row_bucket != bucket:
                    bucket, held = row_bucket, None
                if guest and held is None:
                    continue
                now = (doc, s := Sketcher(body), fingerprint(s))
                if held is not None:
                    done.append(_row(held, now))
                held = None if guest else now
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), _types)], _names)

    return neighbours(docs, doc_id, text).select("bucket", "guest", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "prefix_edited long, suffix_edited long, prefix_next long, suffix_next long"
    )


_names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "prefix_edited", "suffix_edited", "prefix_next", "suffix_next"]
_types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), *[pa.int64()] * 4]


def _row(held: tuple, following: tuple) -> tuple:
    (doc, s, own), (_, other, theirs) = held, following
    n = len(s.text)
    keep, taken = n - n // 2, min(n // 2, len(other.text))
    edited = s.text[:keep] + other.text[:taken]
    changed = edited_fingerprint(s, keep, other, taken)
    a, b = s.hash, other.hash
    prefix = keep + min(common_extension(a, keep, b, 0), taken)
    # the edited text ends with other[:taken], before that with s[:keep]
    suffix = min(common_extension(a, n, b, taken, back=True), taken)
    if suffix == taken:
        suffix += common_extension(a, n - taken, a, keep, back=True)
    shared = prefix, suffix, common_extension(a, 0, b, 0), common_extension(a, n, b, b.n, back=True)
    return doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, likeness(own, changed), likeness(own, theirs), *shared
