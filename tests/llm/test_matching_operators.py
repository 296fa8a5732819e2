"""Suffix-array decontamination, hard negatives and token alignment against plain versions."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.llm_words import words
from unveil.llm import alignment, context_tree, decontamination, hard_negatives, textblocks, token_files
from unveil.llm.near_dedup import near_duplicates

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
UPPER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(UPPER))


def plain_decontamination(text, items, window=10):
    """n_words, n_hit, ids, longest and its place."""
    w, hit, ids, best = split(text), set(), set(), (0, 0)
    for name, t in items:
        v = split(t)
        k = min(window, len(v))
        for s in range(len(v) - k + 1) if v else ():
            for p in range(len(w) - k + 1):
                if w[p : p + k] == v[s : s + k]:
                    hit |= set(range(p, p + k))
                    ids.add(name)
                    n = k
                    while s + n < len(v) and p + n < len(w) and v[s + n] == w[p + n]:
                        n += 1
                    best = max(best, (n, -p))
    return len(w), len(hit), ids, best[0], -best[1] if best[0] else None


def digest(ids):
    return hashlib.sha256(",".join(sorted(str(x) for x in ids if x is not None)).encode()).hexdigest()


def decontamination_case():
    rng = random.Random(11)
    items = [(i, words(rng, rng.choice([3, 9, 10, 11, 40]))) for i in range(12)] + [(12, None), (13, " .,- "), (3, "Repeated id of three"), (None, words(rng, 12))]
    items.append((14, items[4][1]))
    texts = [words(rng, 60), "", None, "one", items[0][1].upper() + "!", "x" * 5000]
    for name, t in items:
        if t:
            w = t.split()
            texts.append(words(rng, 8) + ", " + t + ". " + words(rng, 5))
            texts.append(words(rng, 8) + "-" + "--".join(w[1:10]) + " " + words(rng, 5))  # one word short of a window
    texts += [t for t in texts[6:10]]
    return [(i // 2 if i % 9 == 0 else i, t) for i, t in enumerate(texts)], items


def test_decontamination_is_brute_force(spark, monkeypatch):
    docs, items = decontamination_case()
    want = Counter()
    for i, t in docs:
        n, hit, ids, best, at = plain_decontamination(t, items)
        want[(i, n, hit, len(ids - {None}), digest(ids), hit > 0, best, at)] += 1
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for slice_words in (1 << 20, 60):  # one slice of the tests, and several
        monkeypatch.setattr(decontamination, "SLICE_WORDS", slice_words)
        got = Counter(tuple(r)[:8] for r in decontamination.report(d, b).collect())
        assert got == want
    kept = [(i, t) for i, t in docs if plain_decontamination(t, items)[1] == 0]
    clash = d.select("*", F.lit(1).alias("n_words"), F.lit("x").alias("item_id"), F.lit(None).cast("string").alias("contaminated"))
    out = decontamination.decontaminate(clash, b)
    assert out.columns == clash.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(kept)
    places = decontamination.matches(d, b).collect()
    by_item = dict((str(i), split(t)) for i, t in items if i != 3)
    assert {r.doc_id for r in places} == {i for i, t in docs if plain_decontamination(t, items)[1]}
    for r in places:
        if r.item_id in by_item:
            found = by_item[r.item_id][r.item_at : r.item_at + r.n_words]
            assert any(split(t)[r.doc_at : r.doc_at + r.n_words] == found for i, t in docs if i == r.doc_id)


def test_long_texts_are_cut_without_loss(monkeypatch):
    """A shard limit of a few bytes cuts texts inside windows and inside words."""
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 25)
    rng = random.Random(2)
    for _ in range(40):
        stems = ["a", "B", "cé", "d" * 13]
        items = [(str(i), " ".join(rng.choice(stems) for _ in range(rng.randint(1, 9)))) for i in range(3)]
        text = " ".join(rng.choice(stems) for _ in range(60))
        rows = [(n, 0, min(4, len(split(t))), len(split(t)), " ".join(split(t)).encode()) for n, t in items]
        tests = decontamination.gather(pa.table([pa.array(c) for c in zip(*rows)], names=["item", "at", "width", "n", "words"]))
        data, offsets = textblocks.buffers(pa.array([text]))
        (found,) = decontamination.scan(data, offsets, tests)
        n, hit, ids, best, at = plain_decontamination(text, items, 4)
        assert (found.n_words, int(found.hits.sum()), found.items) == (n, hit, ids)
        assert not hit or found.best[:2] == (best, at)


def test_decontamination_of_odd_tables(hostile, empty, spark):
    items = spark.createDataFrame([(1, "twice 4111 1111 1111 1111")], "item_id int, text string")
    got = decontamination.report(hostile, items).collect()
    assert len(got) == hostile.count() and sum(r.contaminated for r in got) == 1
    assert decontamination.report(empty, items).collect() == []
    assert not any(r.contaminated for r in decontamination.report(hostile, items.where("false")).collect())
    assert decontamination.matches(empty, items).collect() == []


# ------------------------------------------------------------- hard negatives


def plain_negatives(rows, anchor, k=5):
    good = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = tuple(int(np.floor(256 * x)) for x in v)
        good[i] = min(good.get(i, (label, ints)), (label, ints))
    out = []
    for a in filter(anchor, good):
        scored = sorted((-sum(x * y for x, y in zip(good[a][1], v)), i) for i, (_, v) in good.items() if i != a)
        for p, pid in [s for s in scored if good[s[1]][0] == good[a][0]][:k]:
            fits = [(-s, i) for s, i in scored if good[i][0] != good[a][0] and 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(a, pid, n + 1, i, -p, s) for n, (s, i) in enumerate(fits)]
    return sorted(out)


def negative_rows():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 12))
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(6)] + 0.2 * rng.standard_normal(12)).tolist()) for i in range(400)]
    rows += [(i, i % 4, rows[7][2]) for i in range(400, 460)]  # a hot vector
    rows += [(500, None, rows[0][2]), (501, 1, None), (502, 1, [float("nan")] + [0.0] * 11), (503, 2, [None] + [1.0] * 11), (504, 3, [0.0] * 12)]
    rows += [rows[3], (3, 0, rows[5][2]), (None, 1, rows[1][2]), (600, 1, [float("inf")] + [0.0] * 11), (20, 3, [1e-9] * 12)]
    return rows


def test_hard_negatives_are_brute_force(spark, monkeypatch):
    rows = negative_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, code string, rank int").repartition(5)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert want
    for block in (16_384, 13):  # one block of anchors, and several
        monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block)
        got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect()
        assert sorted(tuple(r) for r in got) == want
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(df.where("vec_id = 20"), F.col("vec_id") % 10 == 0).collect() == []
    huge = spark.createDataFrame([(0, 0, [1e300, 1.0]), (10, 0, [1.0, 1.0]), (11, 0, [1.0, 1.0]), (12, 1, [1.0, 0.9])], "vec_id long, label int, embedding array<double>")
    assert [tuple(r)[:4] for r in hard_negatives.mine(huge, F.col("vec_id") % 10 == 0).collect()] == [(10, 11, 1, 12)]


def test_intervals_hold_every_inner_product():
    """Also for vectors of very different lengths, zero vectors, and lengths that are no multiple of 64."""
    rng = np.random.default_rng(3)
    for d in (1, 3, 64, 70):
        vecs = np.floor(256 * rng.standard_normal((300, d)) * 10.0 ** rng.integers(-3, 5, (300, 1))).astype(np.int64)
        vecs[5] = 0
        codes, align, residual = hard_negatives.codes_of(vecs.astype(np.float64), hard_negatives.rotation(d))
        rows = hard_negatives.Rows(np.arange(300), np.zeros(300, np.int64), vecs, codes, align, residual)
        low, high = hard_negatives.Anchors(rows, d).interval(slice(0, 300), rows)
        true = vecs @ vecs.T
        assert (low <= true).all() and (true <= high).all()


def test_intervals_leave_candidates_out():
    """The filter is of use: most pairs of clustered vectors need no exact score."""
    rng = np.random.default_rng(4)
    vecs = np.floor(256 * (rng.standard_normal((40, 64))[rng.integers(40, size=600)] + 0.3 * rng.standard_normal((600, 64)))).astype(np.int64)
    codes, align, residual = hard_negatives.codes_of(vecs.astype(np.float64), hard_negatives.rotation(64))
    rows = hard_negatives.Rows(np.arange(600), np.zeros(600, np.int64), vecs, codes, align, residual)
    _, high = hard_negatives.Anchors(rows, 64).interval(slice(0, 600), rows)
    assert (high >= 0.8 * (vecs @ vecs.T).diagonal()[:, None]).mean() < 0.5


# ------------------------------------------------------------ token alignment


def plain_tokens(text, tokenizer, pieces):
    """Ids and byte ends of both sides, or None."""
    chars = {c: b for c, b in alignment.byte_of().items()}
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = pieces.encode(text)
    raw_a = [bytes(chars[c] for c in tokenizer.id_to_token(i)) for i in a]
    raw_b = []
    for i in b:
        p = pieces.id_to_piece(i)
        raw_b.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
    if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return None
    return a, np.cumsum([len(x) for x in raw_a]).tolist(), b, np.cumsum([len(x) for x in raw_b]).tolist()


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    docs, count = [], Counter()
    for text in texts:
        found = plain_tokens(text, tokenizer, pieces) if text else None
        if not found:
            docs.append((0, 0, [], []))
            continue
        a, ends_a, b, ends_b = found
        shared = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a.index(e)], b[ends_b.index(e)]) for e in shared]
        groups, last = [], 0
        for e in shared:
            own = [",".join(str(t) for t, z in zip(ids, ends) if last < z <= e) for ids, ends in ((a, ends_a), (b, ends_b))]
            groups.append("|".join(own))
            last = e
        docs.append((len(a), len(b), groups, links))
        count.update(links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for n_a, n_b, groups, links in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out


def alignment_texts():
    rng = random.Random(6)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(40)]
    texts += ["", None, " ", "  two  blanks ", "Tabs\tand\r\nlines\n\nhere", "日本語 と 한국어 🙂 naïve", "<|endoftext|> <s> </s> <unk> plain", "a▁b", "\x00nul", "ﬁne ½", "x" * 3000, "don't stop; it's 12,345.67!"]
    return texts + texts[:5]


def test_alignment_is_brute_force(spark):
    texts = alignment_texts()
    want = Counter((i, *r) for i, r in enumerate(plain_alignment(texts)))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n_a int, uid int").repartition(4)
    for held in (1 << 20, 40, 0):  # all pairs in the table, some, none
        assert Counter(tuple(r) for r in alignment.report(df, A, B, held=held).collect()) == want


def test_links_are_counted_in_bounded_memory(monkeypatch):
    """A batch of 24 MB of links takes a few blocks of memory, and rows cut anywhere give the same sums."""
    rng = np.random.default_rng(5)
    links = rng.integers(0, 300, (3 << 20, 2)).astype("<u4")
    cuts = np.sort(rng.integers(0, len(links) + 1, 4000))
    cuts[[0, -1]] = 0, len(links)
    n = len(cuts) - 1
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), token_files._binaries(links.view(np.uint8).ravel(), 8 * cuts)], ["uid", "links"])
    key = links[:, 1].astype(np.int64) << 32 | links[:, 0]
    keys, count = np.unique(key, return_counts=True)
    table = keys[::2], count[::2], np.arange(len(keys))[::2] % 2
    place = np.searchsorted(keys, key)
    found = np.where(place % 2 == 0, count[place], 0)
    row = np.repeat(np.arange(n), np.diff(cuts))
    for size in (alignment.LINK_BYTES, 4096):
        monkeypatch.setattr(alignment, "LINK_BYTES", size)
        tracemalloc.start()
        pairs, sums = [*alignment.counted([batch])], [*alignment.summed([batch], *table)]
        rare = sum(b.num_rows for b in alignment.beyond([batch], table[0]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 48 << 20
        got = Counter()
        for b in pairs:
            for x, y, k in zip(*(c.to_pylist() for c in b.columns)):
                got[y << 32 | x] += k
        assert got == dict(zip(keys.tolist(), count.tolist()))
        assert pa.Table.from_batches(sums)["count_sum"].to_pylist() == np.bincount(row, found, n).astype(int).tolist()
        assert rare == int((place % 2 == 1).sum())


def test_windows_with_a_known_hash_are_compared(monkeypatch):
    """With a hash of four values windows clash, and the groups are the same."""
    pair = alignment.Pair(A, B)
    texts = [" " + (t or "") for t in alignment_texts()]
    column = pa.array(texts)
    block = (column, *textblocks.buffers(column))
    want = pair.align(*block)
    again = pair.align(*block)  # all windows known
    real = alignment.span_hashes
    monkeypatch.setattr(alignment, "span_hashes", lambda *a, **k: real(*a, **k) & np.uint64(3 << 62))
    pair._clear()
    for got in (again, pair.align(*block), pair._apart(*block)):
        assert [bytes(g) for g in got[2]] == [bytes(g) for g in want[2]]
        assert all((x == y).all() for k in (0, 1, 3, 4) for x, y in [(got[k], want[k])])


def test_alignment_of_odd_tables(hostile, empty):
    got = alignment.report(hostile, A, B).collect()
    assert len(got) == hostile.count()
    assert all((r.groups_sha256 == "") == (r.n_a == 0) == (r.n_links == 0) for r in got)
    assert alignment.report(empty, A, B).collect() == []


def test_long_texts_reach_the_piece_tokenizer_in_parts(monkeypatch):
    pair = alignment.Pair(A, B)
    assert pair.cuttable
    rng = random.Random(9)
    monkeypatch.setattr(alignment, "LONG_TEXT", 7)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", " ", " ", "  ", "é", "▁", "\n", "word"]) for _ in range(rng.randint(1, 30)))
        assert pair.pieces(text) == pair.b.encode(text), text


# ------------------------------------------------------------ words and units that regular hashes confuse


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_complementary_words_stay_apart(spark, n):
    one, two = thue_morse(n)
    docs = spark.createDataFrame([(0, one), (1, two), (10, one), (3, " ".join([two, one, "tail"]))], "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert found[1].component_id == 1 and found[0].component_id == found[10].component_id == 0
    ids = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.report(docs, A).collect()}
    plain = token_files.WordwiseTokenizer(A, literal=False).tokenizer
    for r in docs.collect():
        own = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        assert ids[r.doc_id] == (len(own), zlib.crc32(own.tobytes()))
    known = {r.doc_id: r.n_known for r in context_tree.score_texts(docs, F.col("doc_id") == 0).collect()}
    assert known == {0: 2, 1: 1, 10: 2, 3: 2}


def test_units_with_a_known_hash_are_compared(monkeypatch):
    """With a hash of 64 values for units of over eight bytes they nearly all clash; the ids are the library's all the same."""
    real = token_files.span_hashes

    def weak(data, starts, ends, fold=True):
        h = real(data, starts, ends, fold)
        return np.where(ends - starts > 8, h & np.uint64(63 << 58), h)

    monkeypatch.setattr(token_files, "span_hashes", weak)
    tok, rng = token_files.WordwiseTokenizer(A, literal=False), random.Random(1)
    stems = ("abcd", "efgh", "ijkl", "mé")
    texts = [words(rng, 20, stems) + rng.choice([".", ",", ""]) + " " + words(rng, 5, stems) for _ in range(30)]
    column = pa.array(texts)
    ids, n = tok.encode(column, *textblocks.buffers(column))
    want = [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
