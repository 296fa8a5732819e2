"""Language mixtures, toxicity and context trees."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import unveil.llm.context_tree as ct
from llm.llm_words import words
from unveil.llm import languages, toxicity
from unveil.llm.queries import op1, op6, op7
from unveil.llm.shared import id_fold
from unveil.llm.textblocks import buffers

SF = "/root/testdata/sf0.01"


def test_language_of_hostile_rows(hostile, empty):
    model = languages.learn(hostile)
    out = languages.identify(hostile, model)
    assert out.columns == [c for c in hostile.columns if c not in ("score", "lang_pred")] + ["lang_pred", "score", "languages"]
    rows = out.collect()
    assert len(rows) == hostile.count()
    for r in rows:
        none = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == none and 0 <= r.score <= 1 and (r.score == 0) == none
    assert languages.identify(empty, model).collect() == []
    blank = languages.learn(empty)
    assert {r.lang_pred for r in languages.identify(hostile, blank).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op7(spark, SF).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97


def test_mixed_text_names_both_languages(make_docs, spark):
    rng = random.Random(3)
    one = lambda n: words(rng, n, ("ba", "do", "ki", "lu"))
    two = lambda n: words(rng, n, ("sch", "tze", "ung", "ver"))
    rows = [(i, one(40), "x") for i in range(30)] + [(100 + i, two(40), "y") for i in range(30)]
    model = languages.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    test = make_docs([one(30) + " " + two(12), one(30), two(25) + " " + one(10)])
    got = {r.doc_id: r for r in languages.identify(test, model).collect()}
    assert got[0].languages == ["x", "y"] and got[1].languages == ["x"] and got[2].languages == ["y", "x"]
    assert abs(got[0].score - 30 / 42) < 0.05 and got[1].score == 1.0


def test_text_in_many_languages_names_them_all(make_docs, spark):
    rng = random.Random(16)
    sounds = {"a": ("ba", "do"), "b": ("sch", "tze"), "c": ("lli", "ppo"), "d": ("qua", "xin"), "e": ("ngw", "mbe"), "f": ("ryk", "vaz")}
    text = {x: lambda n, s=s: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(n)) for x, s in sounds.items()}
    rows = [(i, text[x](40), x) for x in sounds for i in range(10)]
    model = languages.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    mixes = [dict(zip(sounds, (45, 40, 35, 30, 25, 20))), dict(zip("bcde", (40, 30, 25, 20))), {"f": 30}]
    test = make_docs([" ".join(text[x](n) for x, n in mix.items()) for mix in mixes])
    got = {r.doc_id: r for r in languages.identify(test, model).collect()}
    for i, mix in enumerate(mixes):
        assert got[i].languages == list(mix) and abs(got[i].score - max(mix.values()) / sum(mix.values())) < 0.05


def test_bound_leaves_out_no_better_set():
    """Against all nested sizes, one row at a time: the chosen set has the best penalised likelihood."""
    rng = np.random.default_rng(17)
    logs, n = [], []
    for _ in range(150):  # words of one to five of six languages, from clear to doubtful
        share = rng.dirichlet(np.full(6, rng.choice([0.1, 0.5, 2.0])))
        n.append(int(rng.integers(2, 200)))
        own = rng.choice(6, n[-1], p=share)
        logs.append(rng.normal(0, 1, (n[-1], 6)) + rng.choice([0.5, 2.0, 6.0]) * np.eye(6)[own])
    got = languages.mixtures(np.concatenate(logs).astype(np.float32), np.concatenate([[0], np.cumsum(n)]))
    late = 0
    for one, found in zip(logs, got):
        best = one.max(axis=1, keepdims=True)
        p = np.exp(np.maximum(one - best, -60)).astype(np.float32)
        first = np.array([0, len(p)])
        share, _ = languages._em(p, first, np.full((1, 6), 1 / 6, np.float32), languages.ROUNDS)
        alone = np.maximum(one - best, -60).sum(axis=0)
        share[0, alone.argmax()] += 1
        order = np.argsort(-share[0], kind="stable")
        values = [alone.max()]
        for size in range(2, 7):
            _, value = languages._em(p[:, order[:size]] + np.float32(1e-30), first, np.full((1, size), 1 / size, np.float32), languages.ROUNDS)
            values.append(value[0] - (size - 1) * (0.5 * np.log(len(p)) + 3))
        late += np.argmax(values) > 2 or any(a > b and max(values[i:]) > a for i, (a, b) in enumerate(zip(values, values[1:])))
        assert values[len(found) - 1] >= max(values) - 0.01
    assert late  # some rows need a fourth language, or a size after one without gain


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op1(spark, SF).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    good, bad = [r.score for r in rows if r.toxic == 0], [r.score for r in rows if r.toxic == 1]
    wins = np.mean([b > g for b in bad for g in good])
    assert wins > 0.9 and all((r.score >= 0.5) == (r.predicted == 1) for r in rows)


def test_toxicity_of_hostile_rows(hostile, empty, spark):
    labels = spark.createDataFrame([(0, 1), (0, 1), (6, 1), (9, 0), (None, 1), (12, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(hostile, labels)
    rows = toxicity.score(hostile, model).collect()
    assert len(rows) == hostile.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, model).collect() == []
    none = toxicity.learn(empty, labels.where("toxic = 7"))
    assert {(r.score, r.predicted) for r in toxicity.score(hostile, none).collect()} == {(0.0, 0)}


def test_feature_counts_cover_all_positives(spark):
    """A cue of few toxic documents is a feature, however small the sample of the fit is."""
    rng = random.Random(15)
    rows = [(i, f"{words(rng, 30)} zzyx{'q' if i % 10 else 'rarecue'}") for i in range(300)] + [(1000 + i, words(rng, 30)) for i in range(900)]
    docs = spark.createDataFrame([*rows, (None, words(rng, 30))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _ in rows], "doc_id bigint, toxic int")
    counts = {r.slot: (r.in_positive, r.in_all) for r in toxicity.feature_counts(docs.select((F.col("doc_id") < 300).alias("positive"), "text")).collect()}
    column = pa.array(["zzyxrarecue"])
    keys, _, _ = toxicity.doc_slots(*buffers(column))
    assert counts[int(keys[np.argmin([counts[int(k)][1] for k in keys])])] == (30, 30)
    small, whole = (toxicity.learn(docs, labels, positives=n) for n in (20, 20_000))
    assert small.slots.tolist() == whole.slots.tolist() and set(keys.tolist()) <= set(small.slots.tolist())


def test_nnpu_separates_and_stays_non_negative():
    rng = np.random.default_rng(1)

    def side(n, share):
        toxic = rng.random(n) < share
        at = np.where(toxic, 0, 1 + rng.integers(0, 4, n))
        return (np.arange(n), at, np.ones(n), np.zeros(n), n), toxic

    (positive, _), (unlabelled, truth) = side(200, 1.0), side(4000, 0.1)
    w = toxicity.fit_nnpu(positive, unlabelled, 5, 0.1)
    z = w[unlabelled[1]] + w[-1]
    assert (z[truth] > 0).all() and (z[~truth] < 0).all()


def naive_tree(train, test, depth):
    """Context-tree weighting from its definition: recursive, one decision node at a time."""
    counts = {}
    for s in train:
        padded = bytes([ct.END_BYTE] * depth) + s
        for i in range(depth, len(padded)):
            for k in range(8):
                node = (1 << k) | (padded[i] >> (8 - k))
                bit = (padded[i] >> (7 - k)) & 1
                for d in range(depth + 1):
                    counts.setdefault((node, padded[i - d : i][::-1]), [0, 0])[bit] += 1

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)

    children = {}
    for node, c in counts:
        if c:
            children.setdefault((node, c[:-1]), []).append((node, c))
    memo = {}

    def weighted(x):
        if x not in memo:
            own = kt(*counts[x])
            memo[x] = own if len(x[1]) == depth else math.log(0.5) + np.logaddexp(own, sum(weighted(c) for c in children[x]))
        return memo[x]

    def predict(node, context, d=0):
        x = (node, context[:d])
        if x not in counts:
            return None
        n0, n1 = counts[x]
        own = (n1 + 0.5) / (n0 + n1 + 1)
        longer = predict(node, context, d + 1) if d < depth else None
        if longer is None:
            return own
        stop = math.exp(math.log(0.5) + kt(n0, n1) - weighted(x))
        return stop * own + (1 - stop) * longer

    out = []
    for s in test:
        padded, total = bytes([ct.END_BYTE] * depth) + s, 0.0
        for i in range(depth, len(padded)):
            for k in range(8):
                p = predict((1 << k) | (padded[i] >> (8 - k)), padded[i - depth : i][::-1])
                p = 0.5 if p is None else p
                total += math.log10(p if (padded[i] >> (7 - k)) & 1 else 1 - p)
        out.append(total)
    return out


def canonical(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", low)).encode() + b"\n"


@pytest.mark.parametrize("small_head", [False, True])
def test_scores_match_the_definition(spark, make_docs, monkeypatch, small_head):
    if small_head:  # nearly every n-gram and word takes the join
        monkeypatch.setattr(ct, "HEAD_GRAMS", 20)
        monkeypatch.setattr(ct, "HEAD_WORDS", 3)
    rng = random.Random(5)
    texts = [words(rng, rng.randint(0, 12)) for _ in range(40)] + ["Ünïcode  TEXT\n", "", None, "zzz zzz"]
    docs = make_docs(texts)
    fold = id_fold(F.col("doc_id"), 10) != 0
    rows = {r.doc_id: r for r in ct.score_texts(docs, fold).collect()}
    raw = [canonical(t) for t in texts]
    train = [raw[i] for i in rows if rows[i].is_train]
    assert 0 < len(train) < len(texts)
    expected = naive_tree(train, raw, ct.DEPTH)
    for i, want in enumerate(expected):
        assert rows[i].score == pytest.approx(want, rel=1e-9)
    seen = Counter(w for s in train for w in [*s.split(b" "), b"\n"] if w.strip(b"\n") or w == b"\n")
    seen = Counter()
    for s in train:
        seen.update(s[:-1].split())
        seen[b"\n"] += 1
    n, v = sum(seen.values()), len(seen)
    for i, s in enumerate(raw):
        tokens = [*s[:-1].split(), b"\n"]
        assert rows[i].n_tokens == len(tokens) and rows[i].n_known == sum(t in seen for t in tokens) and rows[i].train_tokens == n
        assert rows[i].base_score == pytest.approx(sum(math.log10((seen[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel=1e-9)


def test_scores_of_hostile_rows(hostile, empty):
    rows = ct.score_texts(hostile, F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == hostile.count() and all(r.score < 0 and r.base_score < 0 and r.n_tokens >= 1 for r in rows)
    assert ct.score_texts(empty, F.lit(True)).collect() == []
    untrained = ct.score_texts(hostile.where("doc_id = 12"), F.lit(False)).first()
    assert untrained.train_tokens == 0 and untrained.n_known == 0 and untrained.score == pytest.approx(8 * math.log10(0.5))


def test_model_beats_chance_and_probabilities_sum_to_one(spark):
    rows = op6(spark, SF).where("held_out").collect()
    assert sum(r.score for r in rows) > 1.05 * sum(r.base_score for r in rows)
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 48, 200))
    context = keys[0] & ~np.int64(255)
    every = np.concatenate([keys, context | np.arange(256)])
    count = np.concatenate([np.arange(200) % 5, np.zeros(256, np.int64)])
    assert (10 ** ct.log10_probabilities(every, count, [])[200:]).sum() == pytest.approx(1.0)
