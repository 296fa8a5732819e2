"""Fingerprints, personal data, token files."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.llm_words import words
from unveil.llm import fingerprints as fp
from unveil.llm import huffman, personal_data, token_files
from unveil.llm.textblocks import buffers

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def expected_edits(rows):
    """rows in descending id order -> what the report must hold, from the texts alone."""
    out = []
    for i, (doc, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        prints = [fp.fingerprint(fp.Sketcher(t)) for t in (text, edited, other)]
        shared = [len(os.path.commonprefix([text[::way], t[::way]])) for t in (edited, other) for way in (1, -1)]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints[:2], fp.likeness(*prints[:2]), fp.likeness(prints[0], prints[2]), *shared))
    return out


def test_fingerprints_match_texts(spark, small_docs):
    rows = [(r.doc_id, r.text or "") for r in small_docs.select("doc_id", "text").orderBy(F.desc("doc_id")).collect()]
    got = sorted(tuple(r) for r in fp.edit_report(small_docs).collect())
    assert got == sorted(expected_edits(rows))


def test_shared_ends_are_exact(make_docs):
    rng = random.Random(15)
    texts = []
    for _ in range(60):
        unit = rng.choice(["a", "ab", "aab", "xyz"]) * rng.randint(0, 12)
        texts.append(unit + rng.choice(["", "q", unit]) + rng.choice(["", "b"]))
    rows = list(enumerate(texts))[::-1]
    assert sorted(tuple(r) for r in fp.edit_report(make_docs(texts)).collect()) == sorted(expected_edits(rows))


def test_fingerprints_of_hostile_rows(hostile, empty, make_docs):
    got = fp.edit_report(hostile).collect()
    assert len(got) == hostile.count()
    by_text = {}
    texts = {(r.doc_id, len(r.text or "")): r.text or "" for r in hostile.collect()}
    for r in got:
        by_text.setdefault(texts[r.doc_id, r.n_chars], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({next(iter(x)) for x in by_text.values()}) == len(by_text)
    assert fp.edit_report(empty).collect() == []
    alone = fp.edit_report(make_docs(["abcdef"])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and alone.near_next == 1.0
    nulls = fp.edit_report(hostile.where("doc_id is null")).collect()
    assert len(nulls) == 2


def test_prefix_hash_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        b = a[rng.randint(0, len(a)) :] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 20)))
        x, y = fp.PrefixHash(fp.codes_of(a)), fp.PrefixHash(fp.codes_of(b))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert fp.common_extension(x, i, y, j) == want
        assert fp.common_extension(x, i, y, j, back=True) == len(os.path.commonprefix([a[:i][::-1], b[:j][::-1]]))
        assert x.all_spans(3).tolist() == [x.span(k, k + 3) for k in range(max(0, len(a) - 2))]


def test_likeness_grows_with_what_is_shared():
    rng = random.Random(2)
    a, b = words(rng, 300), words(rng, 300)
    near = a[:400] + "X" + a[401:]
    prints = [fp.fingerprint(fp.Sketcher(t)) for t in (a, near, a[: len(a) // 2] + b, b)]
    scores = [fp.likeness(prints[0], p) for p in prints]
    assert scores[0] == 1.0 and 1.0 > scores[1] > 0.8 > scores[2] > 0.2 > scores[3]


def luhn(s):
    total = 0
    for i, c in enumerate(s[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15]
    return out


def test_base_spans_match_the_forms():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("1234567890@.+- ()aZ%25") for _ in range(rng.randint(0, 60)))
        assert [(personal_data.KINDS[k], s, e) for k, s, e in personal_data.base_spans(t)] == brute_spans(t)
    for unit in ("1", "a@", "1.", "+1", "1 ", "a.", "1-", "1.2.3.4 "):  # long runs stay linear
        personal_data.instances(unit * 50_000, personal_data.base_spans(unit * 50_000))


def test_runs_of_identifiers_offer_their_parts():
    text = "call 0171 5550123 0171 5550199 or 5551234 2024"
    found = {text[s:e] for _, s, e in personal_data.instances(text, [])}
    assert {"0171 5550123", "0171 5550199", "5551234", "5551234 2024"} <= found
    began = time.time()
    for unit in (" @a.b", "@a.b", "a@b", "12 ", "(1) ", "1 2-3.", "1234567,"):
        t = unit * 200_000
        personal_data.instances(t, personal_data.base_spans(t))
    assert time.time() - began < 30
    far = "one two" + " " * 5_000 + "5551234"
    assert personal_data.patterns(far, len(far) - 7, len(far)) == ["two\t", "one two\t", "two\t"]
    assert personal_data.patterns("w" * 90 + " 5551234", 91, 98)[0] == "w" * 90 + "\t"


def brute_trusted(texts):
    """The pattern-instance graph in plain Python: seeds, then rounds until nothing is added."""
    places, seeds = {}, set()
    for t in texts:
        base = personal_data.base_spans(t)
        both = [(k, 1 << k, s, e) for k, s, e in base] + [(-1, m, s, e) for m, s, e in personal_data.instances(t, base)]
        for k, m, s, e in both:
            share = personal_data.PLACE // sum(x[2] == s for x in both)
            for kind in range(4):
                if m >> kind & 1:
                    if k >= 0:
                        seeds.add((t[s:e].lower(), kind))
                    for p in set(personal_data.patterns(t, s, e)):
                        members = places.setdefault((p, kind), {})
                        members[t[s:e].lower()] = members.get(t[s:e].lower(), 0) + share
    trusted, rounds = set(seeds), 0
    while True:
        more = set()
        for (_, kind), members in places.items():
            held = [i for i in members if (i, kind) in trusted]
            if len(held) >= personal_data.SUPPORT and sum(members[i] for i in held) >= personal_data.TRUST * (sum(members.values()) + personal_data.PLACE):
                more |= {(i, kind) for i in members} - trusted
        if not more:
            return trusted, rounds
        trusted |= more
        rounds += 1


def test_bootstrapping_follows_contexts_to_the_end(make_docs):
    """Contexts chain: each one is learned from identifiers that the one before it found."""
    rng = random.Random(14)
    number = lambda: f"{rng.randint(200, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}"
    texts = [f"{words(rng, 4)} alpha +1 (555) {rng.randint(100, 999)}-{rng.randint(1000, 9999)} {words(rng, 3)}" for _ in range(40)]
    chain = [f"link{c * 3}" for c in "abcde"]
    before = "alpha"
    for name in chain:
        bridge = [number() for _ in range(7)]
        texts += [f"{words(rng, 4)} {before} {x} {words(rng, 3)}" for x in bridge]
        texts += [f"{words(rng, 4)} {name} {x} {words(rng, 3)}" for x in bridge * 6]
        before = name
    last = number()
    texts += [f"{words(rng, 4)} {before} {last} end", f"{words(rng, 4)} order {number()} end", "", f"{before} 0171 5550123 0171 5550199"]
    trusted, rounds = brute_trusted(texts)
    assert rounds > 4 and (last, 3) in trusted
    rows = {r.doc_id: r.spans for r in personal_data.report(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        base = personal_data.base_spans(t)
        best = {}
        for item, kind in trusted:
            best[item] = min(kind, best.get(item, 9))
        more, at = [], -1
        for s, e, k in sorted(((s, e, best[t[s:e].lower()]) for _, s, e in personal_data.instances(t, base) if t[s:e].lower() in best), key=lambda x: (x[0], -x[1])):
            if s >= at:
                more.append((k, s, e))
                at = e
        assert rows[i] == ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for k, s, e in sorted([*base, *more])), t


def test_report_digests(spark, small_docs):
    rows = {r.doc_id: r for r in personal_data.report(small_docs).collect()}
    for d in small_docs.select("doc_id", "text").collect():
        spans = brute_spans(d.text or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in spans) for x in personal_data.KINDS)
        assert set(text.split(",")) <= set(r.spans.split(","))


def test_patterns_discover_identifiers_that_no_form_matches(make_docs):
    rng = random.Random(4)
    seeds = [f"{words(rng, 8)} reach phone: +1 (555) {rng.randint(100, 999)}-{rng.randint(1000, 9999)} {words(rng, 5)}" for _ in range(30)]
    unseen = f"{words(rng, 8)} reach phone: 555 867 5309 {words(rng, 5)}"
    elsewhere = f"{words(rng, 8)} 555 867 5309 {words(rng, 5)}"  # the same instance without the pattern
    other = f"{words(rng, 8)} order 1234567 {words(rng, 5)}"
    docs = make_docs([*seeds, unseen, elsewhere, other])
    rows = {r.doc_id: r for r in personal_data.report(docs).collect()}
    for i, t in ((30, unseen), (31, elsewhere)):
        at = t.index("555 867")
        assert rows[i].spans == f"phone:{at}:{at + 12}" and rows[i].n_phone == 0
    assert rows[32].spans == ""
    clean = {r.doc_id: r.text for r in personal_data.redact(docs).collect()}
    assert "867" not in clean[30] and "[phone]" in clean[31] and clean[32] == other and all("555" not in clean[i] for i in range(30))


def test_personal_data_of_hostile_rows(hostile, empty):
    rows = personal_data.report(hostile).collect()
    assert len(rows) == hostile.count() and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) == 4
    before, after = hostile.collect(), personal_data.redact(hostile)
    assert after.columns == hostile.columns
    changed = [r for r in after.collect() if r.doc_id == 36][0]
    assert changed.text == "mail [email] and [ip] or [phone] twice [card]" and changed.n_chars == len(changed.text)
    same = lambda rows: sorted(str(r) for r in rows if r.doc_id != 36)
    assert same(before) == same(after.collect())
    assert personal_data.report(empty).collect() == [] and personal_data.redact(empty).collect() == []


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [[*e.ids, 0] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_wordwise_ids_equal_the_tokenizers():
    rng = random.Random(5)
    parts = ["a", "B", " ", "\n", "\t", "'s", "é", "1", "  ", "!", "\x1c", "日", "'ll", "\r", "x,", "…", "<|endoftext|>", " ", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    tok = token_files.WordwiseTokenizer(VOCABULARY)
    column = pa.array(texts)
    ids, n = tok.encode(column, *buffers(column))
    want = plain_ids(texts)
    cuts = np.cumsum(n)
    assert all(w[:-1] == ids[c - k : c].tolist() for w, c, k in zip(want, cuts, n))


def test_words_and_marks_are_units_of_their_own():
    """40 words with each of 32 marks behind them are 72 units and no 1,280; the ids are the library's."""
    marks = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    stems = sorted(set(words(random.Random(16), 400, ("ran", "é", "to", "ß", "Ü")).split()))[:40]
    tok = token_files.WordwiseTokenizer(VOCABULARY, literal=False)
    column = pa.array(["", " " + " ".join(w + m for w in stems for m in marks), None])
    ids, n = tok.encode(column, *buffers(column))
    assert tok.numbers.n == len(stems) + len(marks) == 72
    assert n[0] == n[2] == 0 and ids.tolist() == tok.tokenizer.encode(column[1].as_py(), add_special_tokens=False).ids
    rng = random.Random(17)
    parts = ["a", "Ž", "ÿ", "×", "÷", "é", "e\u0301", "日", "7", "\x7f", " ", "\n", "\n\n", "'", "'s", "'ve,", *marks]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(10_000)]
    column = pa.array(texts)
    ids, n = tok.encode(column, *buffers(column))
    want = [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_token_files_round_trip(hostile, empty, small_docs):
    for docs in (small_docs, hostile):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.select("doc_id", "text").collect())
        want = plain_ids([t for _, t in rows])
        got = token_files.read_tokens(*token_files.write_tokens(docs, VOCABULARY)).orderBy("start").collect()
        assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
        assert [((r.doc_id is not None, r.doc_id or 0)) for r in got] == [k for k, _ in rows]
        back = sorted(((r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in got)
        assert back == sorted((k, w) for (k, _), w in zip(rows, want))
        crcs = {r.doc_id: r.ids_crc32 for r in token_files.report(docs, VOCABULARY).collect()}
        assert all(crcs[r.doc_id] == zlib.crc32(r.ids) or docs is hostile for r in got)
    assert token_files.report(empty, VOCABULARY).collect() == []


def test_ids_are_those_of_the_plain_library_call(make_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    assert library.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rng = random.Random(14)
    parts = ["a", " ", "\n", "é", "x,", "<|endoftext|>", "<|endof", "text|>", "<|", "1", "日"]
    texts = ["", "a <|endoftext|> b", "", "<|endof", "text|> split over rows", "plain words", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000))]
    want = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    rows = token_files.report(make_docs(texts), VOCABULARY).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(w) for w in want]
    assert [r.start for r in rows] == [0, *np.cumsum([len(w) for w in want])[:-1].tolist()]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]


def test_huffman_codes():
    rng = np.random.default_rng(6)
    for counts, limit in ((np.array([0, 5, 0]), 18), (np.array([1, 1]), 18), (2 ** np.arange(30), 8), (rng.integers(0, 1000, 5000), 13)):
        lengths = huffman.code_lengths(counts, limit)
        used = lengths[counts > 0]
        assert (used >= 1).all() and used.max() <= limit and (2.0**-used).sum() <= 1 and (lengths[counts == 0] == 0).all()
        ids = rng.choice(np.flatnonzero(counts), 3000).astype(np.uint32)
        first = np.array([0, 0, 10, 1500, 3000])
        payload, starts, at = huffman.encode(ids, first, lengths, huffman.canonical(lengths))
        runs = np.array([0, 10, 700, 1500])
        back = huffman.decode(payload, at[runs], np.diff(np.append(runs, 3000)), huffman.decode_table(lengths))
        assert (back == ids).all() and len(payload) == starts[-1]
    # optimal where the limit does not bind: as good as the entropy bound allows for dyadic weights
    assert huffman.code_lengths(np.array([8, 4, 2, 1, 1])).tolist() == [1, 2, 3, 4, 4]


def test_null_text_is_the_end_alone(make_docs):
    rows = token_files.report(make_docs([None, "", "a"]), VOCABULARY).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens) for r in rows] == [(0, 1), (1, 1), (2, 2)]


def test_buckets_follow_the_ids(spark, monkeypatch):
    from unveil.llm import ordered

    monkeypatch.setattr(ordered, "CUTS", 8)
    rng = random.Random(11)
    ids = sorted({int(rng.random() ** 4 * 10**12) - 500 for _ in range(3000)})
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id bigint")
    for parts in (1, 5, 8, 50):
        cuts = ordered.id_cuts(df, "doc_id", parts)
        got = [(r.doc_id, r.b) for r in df.select("doc_id", ordered.bucket_of(F.col("doc_id"), cuts, parts).alias("b")).collect()]
        assert dict(got)[None] == 0
        buckets = [b for _, b in sorted(x for x in got if x[0] is not None)]
        assert buckets == sorted(buckets) and buckets[0] == 0 and len(set(buckets)) > parts // 3
    monkeypatch.setattr(ordered, "buckets_for", lambda df: 50)
    monkeypatch.setattr(fp, "buckets_for", lambda df: 50)
    docs = spark.createDataFrame([(i, f"text {i} {i % 7}") for i in ids[:400]], "doc_id bigint, text string")
    want = expected_edits([(i, f"text {i} {i % 7}") for i in reversed(ids[:400])])
    assert sorted(tuple(r) for r in fp.edit_report(docs).collect()) == sorted(want)
