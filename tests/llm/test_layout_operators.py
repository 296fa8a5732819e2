"""Mixing, vectors, packing, and the pipeline."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.llm_words import words
from unveil.llm import mixing, packing, vectors
from unveil.llm.shared import stored


def copies_of(doc_id, rate):
    u = int(hashlib.md5(f"mix-1|{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    p = total = math.exp(-rate)
    k = 0
    while u >= total and k < 10_000:
        k += 1
        p *= rate / k
        total += p
    return k


def test_copies_follow_the_inverse_distribution(spark):
    rows = [(i, "t" * (1 + i % 5), "big" if i % 3 else "small") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    total = sum(len(t) for _, t, _ in rows)
    got = mixing.mix(docs, weights, size=2.0).collect()
    chars = {s: sum(len(t) for _, t, x in rows if x == s) for s in ("big", "small")}
    rate = {s: w / 4 * total * 2 / chars[s] for s, w in (("big", 1), ("small", 3))}
    want = {i: copies_of(i, rate[s]) for i, _, s in rows}
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.copy_no)
    assert {i: sorted(c) for i, c in found.items()} == {i: list(range(1, k + 1)) for i, k in want.items() if k}
    share = sum(len(r.text) for r in got if r.source == "small") / sum(len(r.text) for r in got)
    assert abs(share - 0.75) < 0.03
    keys = [r.shuffle_key for r in got]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_mixing_hostile_rows(hostile, empty, spark):
    out = mixing.mix(hostile, size=3.0)
    assert out.columns == [c for c in hostile.columns if c != "copy_no"] + ["copy_no", "n_copies", "shuffle_key"]
    ids = {}
    for r in out.collect():
        ids.setdefault((r.doc_id, r.source), set()).add(r.n_copies)
    assert ids and all(len(x) == 1 for x in ids.values())
    assert mixing.mix(empty).collect() == []
    only_a = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(hostile, only_a, size=5.0).collect()} == {"a"}


def brute_nearest(rows, k, d):
    good = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            best = {}
            for j, v in good:
                if j != i:
                    s = float(np.cumsum(np.array(q, np.float64) * np.array(v, np.float64))[-1])
                    best[j] = max(best.get(j, -math.inf), s)
            out[i] = sorted(((-s, j) for j, s in best.items()))[:k]
    return out


def test_vectors_match_brute_force_and_recall(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(2000)]
    rows += [(5000 + i, rows[7][1]) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want, hits, total = brute_nearest(rows, 20, 16), 0, 0
    got = {}
    for r in vectors.nearest(df, df.vec_id % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        hits += len({x[1] for x in found} & {j for _, j in want[q]})
        total += 20
    assert hits / total > 0.97


def test_vectors_hostile(spark):
    nan, inf = float("nan"), float("inf")
    vs = [[1.0, 2.0], [2.0, 1.0], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [], [1.0, 2.0], [-1.0, 0.5]]
    rows = [(i * 10, v) for i, v in enumerate(vs)] + [(10, [2.0, 1.0]), (None, [1.0, 1.0]), (90, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", vectors.F.lit("x"))
    got = {}
    for r in vectors.nearest(df, df.vec_id % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest([r for r in rows], 20, 2)
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted((j, -s) for s, j in x) for q, x in want.items()}
    assert vectors.nearest(df.where("false"), df.vec_id % 20 == 0).collect() == []


def test_packing_places_every_byte_once(hostile, empty):
    rows = packing.pack(hostile).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.length, r.bin_capacity))
    for parts in bins.values():
        parts.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[0][0] == 0
        fill, capacity = sum(p[1] for p in parts), parts[0][2]
        assert capacity == min(c for c in packing.CAPACITIES if c >= fill) and {p[2] for p in parts} == {capacity}
    docs = {}
    for r in rows:
        docs.setdefault((r.doc_id, r.copy), []).append((r.start, r.length))
    got = sorted(sum(n for _, n in p) for p in docs.values())
    assert all(sorted(p)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:])) for p in docs.values()) or len(docs) < hostile.count()
    assert sum(got) == sum(len((r.text or "").encode()) + 1 for r in hostile.collect())
    assert packing.pack(empty).collect() == []


def greedy(lengths, capacities, least, choose):
    """Best fit retyped: a list of open bins, the size of each found by filling it from the pieces to come."""
    room, bins, openings = [], [], []
    for k, n in enumerate(lengths):
        fits = [(left - n, b) for b, left in enumerate(room) if left >= n]
        if not fits:
            sizes = [c for c in capacities if c >= max(n, least)]
            rates = []
            for c in sizes:
                held = n
                for later in lengths[k + 1 :]:
                    held += later if held + later <= c else 0
                rates.append((Fraction(min(x for x in sizes if x >= held) + packing.OVERHEAD, held), c))
            openings.append(min(rates)[1] if choose else sizes[0])
            room.append(openings[-1])
        b = min(fits)[1] if fits else len(room) - 1
        room[b] -= n
        bins.append(b)
    fill = [sum(n for n, x in zip(lengths, bins) if x == b) for b in range(len(room))]
    final = [min(c for c in capacities if c >= f) for f in fill]
    return sum(c + packing.OVERHEAD for c in final), bins, final, openings


def optimum(lengths, capacities):
    """Least cost over all partitions."""
    best = [10**9]

    def place(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(min(c for c in capacities if c >= f) + packing.OVERHEAD for f in bins))
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacities[-1]:
                place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_best_fit_against_brute_force():
    rng = random.Random(10)
    capacities, mixed = (8, 16, 32), 0
    for _ in range(200):
        lengths = sorted((rng.randint(1, 32) for _ in range(rng.randint(1, 40))), reverse=True)
        tried = [greedy(lengths, capacities, least, choose) for choose in (True, False) for least in capacities]
        cost, want, sizes, _ = min(tried, key=lambda t: t[0])
        bins, _, final = packing.pack_shard(lengths, capacities)
        assert (bins, final) == (want, sizes)
        mixed += len(set(tried[0][3])) > 1
    assert mixed > 10  # some shards open bins of several sizes (the overhead favours the largest)


def test_packing_stays_close_to_the_optimum():
    rng = random.Random(11)
    capacities, total, least = (8, 16, 32), 0, 0
    for _ in range(60):
        lengths = sorted((rng.randint(1, 32) for _ in range(rng.randint(1, 8))), reverse=True)
        cost = sum(c + packing.OVERHEAD for c in packing.pack_shard(lengths, capacities)[2])
        best = optimum(lengths, capacities)
        assert best <= cost <= 1.5 * best
        total, least = total + cost, least + best
    assert total <= 1.05 * least


def test_repeated_rows_spread_over_shards(spark):
    df = spark.createDataFrame([(1, "same text")] * 500 + [(2, "x")], "doc_id bigint, text string")
    rows = packing.pack(df, shard=50).collect()
    assert len(rows) == 501 and len({r.bin_id.split(":")[0] for r in rows}) > 5


@pytest.fixture(scope="module")
def stage_outputs(spark, small_docs):
    docs, out = small_docs, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), f"test-{name}")
        out.append(docs)
    return out


def test_pipeline_stages(spark, small_docs, stage_outputs):
    named, unique, clean, mixed, packed = stage_outputs
    columns = small_docs.columns
    assert all(df.columns == columns for df in (named, unique, clean, mixed))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "personal_data", "source_mix", "best_fit"]
    letters = {r.doc_id for r in small_docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in named.collect()} == letters
    from unveil.llm.near_dedup import near_duplicates

    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in near_duplicates(named, 80).where("kept").collect()}
    assert unique.count() == unique.select("doc_id").distinct().count()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect()}
    from unveil.llm.personal_data import base_spans

    assert not any(base_spans(r.text) for r in clean.collect())
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(texts[r.doc_id] == r.text for r in mixed.collect())
    assert sum(r.length for r in packed.collect()) == sum(len(r.text.encode()) + 1 for r in mixed.collect())


def test_near_dedup_stage_keeps_clean_versions_of_an_id(spark):
    rng = random.Random(18)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    rows = [(3, a), (7, a + " end"), (7, b), (7, b), (7, None), (7, "x"), (9, b + " end"), (5, c), (5, c + " end"), (2, d), (None, d), (11, e), (11, ""), (12, d)]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert [x for x in got if x[0] == 5] in ([(5, c)], [(5, c + " end")])
    want = [(3, a), (7, b), (7, None), (7, "x"), (2, d), (None, d), (11, e), (11, "")]
    assert sorted(map(str, (x for x in got if x[0] != 5))) == sorted(map(str, want))


def test_near_dedup_stage_links_from_80_percent(spark):
    """Two words changed of 100 leave 86 of 106 shingles; three leave 81 of 111."""
    rng = random.Random(33)
    rows = []
    for k, changed in enumerate([1, 2, 2, 3, 4]):
        w = words(rng, 100).split()
        other = list(w)
        for j in range(changed):
            other[15 + 20 * j] = f"new{k}{j}"
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(other))]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 10, 20, 30, 31, 40, 41]


def test_source_mix_stage_gives_clashing_columns_back(spark, hostile):
    own = hostile.select("*", F.lit(7).alias("n_copies"), F.lit("mine").alias("shuffle_key"))
    out = dict(corpus_pipeline.STAGES)["source_mix"](spark, own, "")
    assert out.columns == own.columns
    assert {(r.copy_no, r.n_copies, r.shuffle_key) for r in out.collect()} == {(1, 7, "mine")}


def test_language_stage_without_any_language_keeps_texts_with_a_letter(spark):
    rows = [(1, "some words", None), (2, "12 345", None), (3, None, None), (4, "日本語", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, "")
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[3]]


def test_run_equals_the_stages(spark, stage_outputs):
    key = lambda r: (r.doc_id, r.copy, r.piece, r.length, r.bin_id, r.bin_offset)
    assert sorted(map(key, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())) == sorted(map(key, stage_outputs[-1].collect()))


def test_stages_take_hostile_and_empty_tables(spark, hostile, empty):
    for source in (hostile, empty):
        docs = source.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, ""), f"hostile-{name}")
        assert (docs.count() == 0) == (source is empty)
