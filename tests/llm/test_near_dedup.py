import random
import re

import numpy as np
import pytest

from llm.llm_words import words
from unveil.llm.components import components
from unveil.llm.near_dedup import MISS, banding, densified, near_duplicates

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, threshold=85):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is None or j is None or not s or not t:
                continue
            both = len(s & t)
            if i == j or 100 * both >= threshold * (len(s) + len(t) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((str(i), len(s), str(root(i) if i is not None and s else i), i is None or not s or root(i) == i) for i, s in sets)


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def test_hostile_rows_match_brute_force(hostile):
    assert result(near_duplicates(hostile)) == brute([(r.doc_id, r.text) for r in hostile.collect()])


def test_empty_table(empty):
    assert near_duplicates(empty).collect() == []


def test_family_of_edited_copies_loses_no_link(spark):
    """Many copies with one to four edits each: links that the star around the least id does not see."""
    rng = random.Random(7)
    base = words(rng, 120).split()
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
        rows.append((rng.randrange(10**12), " ".join(copy)))
    rows += [(10**13 + i, words(rng, 50)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_duplicates(df)) == brute(rows)


def test_leftovers_of_chained_buckets(spark):
    """Families of either kind: one text with many edits, and small buckets in a chain."""
    rng = random.Random(9)
    rows = []
    text = words(rng, 100).split()
    for i in range(120):  # neighbours share much, the ends nothing; most pairs stay below the threshold
        rows.append((5000 + i, " ".join(text)))
        for _ in range(rng.choice([1, 2, 3])):
            text[rng.randrange(100)] = f"w{rng.random()}"
    base = words(rng, 110).split()
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            copy[rng.randrange(110)] = f"e{rng.random()}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_duplicates(df)) == brute(rows)


def test_chain_of_copies(spark):
    """Each differs a little from the one before: one class although the ends differ much."""
    rng = random.Random(8)
    current, rows = words(rng, 150).split(), []
    for i in range(30):
        rows.append((1000 - i, " ".join(current)))
        current[(i * 37) % 150] = f"new{i}"
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_duplicates(df)) == brute(rows)


def test_densified_fills_every_bin_from_the_set():
    for n in (1, 2, 5, 40, 1000):
        ordered = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        values = densified(ordered)
        assert np.isin(values, ordered).all() and (values == densified(ordered)).all()


def test_bands_follow_the_threshold():
    assert banding(85) == (6, 25) and banding(80) == (5, 30)
    for threshold in range(1, 101):
        rows, bands = banding(threshold)
        assert (1 - (threshold / 100) ** rows) ** bands <= MISS
    for wrong in (0, 101):
        with pytest.raises(ValueError):
            banding(wrong)


def test_lower_thresholds_lose_no_link(spark):
    rng = random.Random(12)
    rows = []
    for i in range(150):  # one edit each takes away five of 24 to 76 shingles
        text = words(rng, rng.randint(28, 80)).split()
        rows.append((2 * i, " ".join(text)))
        for _ in range(rng.choice([1, 2, 3])):
            text[rng.randrange(len(text))] = f"edit{rng.random()}"
        rows.append((2 * i + 1, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for threshold in (80, 40, 5):
        assert result(near_duplicates(df, threshold)) == brute(rows, threshold)


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 400), (400, 300), (7, 7), (900, 901), (901, 900)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.component for r in components(df).collect()}
    assert found == {**{i: 0 for i in range(101)}, 300: 300, 400: 300, 500: 300, 900: 900, 901: 900}
