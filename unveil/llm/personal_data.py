"""Personal data by bootstrapped contextual extraction.

Seeds are spans of four fixed forms (e-mail, IP address, payment card, phone).
The words around a seed induce lexical patterns. Every identifier-like span of
the corpus that is no seed (an @ between two runs, or a group of at least
seven digits) is an instance that patterns may vouch for. A run of groups
between blanks is offered whole and in every sequence of up to six of them that fits a kind. Patterns and
instances form a graph that Spark scores in rounds: a pattern's confidence is
the share of trusted instances among the instances of that kind it surrounds,
and it vouches for all of them once that share and the number of different trusted
instances suffice. What it vouches for is trusted in the next round, so that contexts
that no seed has can follow; rounds end when nothing is added. Trusted
instances join the seeds wherever they stand; where some overlap, the
leftmost and then the longest stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unveil.llm.shared import stored, text_of
from unveil.llm.textblocks import blocks, per_row, span_hashes

KINDS = ("email", "ip", "card", "phone")
TRUST = 0.8
SUPPORT = 5
PLACE = 720_720  # weight of one place, shared by the sequences that start there

# FIXED VALUES: the four base forms. An address part ends at its own class, so
# possessive repeats change no match and keep long digit runs linear.
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

GROUP = re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9\x20().\-/:]*[0-9](?![0-9A-Za-z])")
PART = re.compile(r"[^\x20]+")
AT = re.compile(r"@[^\s@]+")
WORD = re.compile(r"\w+")
MOST_DIGITS = 19
MOST_PARTS = 6  # of a sequence that is not its whole run


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the seeds, by kind and start; code points, end exclusive."""
    out = []
    before = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        # a match starts at the first local-part character of the run before the @
        run = text[before : m.start()]
        size = len(run) - len(run.rstrip(LOCAL_PART))
        if size:
            out.append((0, m.start() - size, m.end()))
        # without a local part, a later one may begin behind this @
        before = m.end() if size else m.start() + 1
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _kinds(span: str, n: int) -> int:
    """The kinds that a group of ``n`` digits may be, as a bit mask."""
    dotted = 4 <= n <= 12 and re.fullmatch(r"[0-9]+(?:[.:-][0-9]+){3}", span)
    return (2 if dotted else 0) | (4 if 12 <= n <= MOST_DIGITS else 0) | (8 if 7 <= n <= 15 else 0)


def _sequences(run: str) -> Iterator[tuple[int, int, int]]:
    """(kinds, start, end) of the sequences of a run's parts that fit a kind, cut to the digits (or bracket) at their ends."""
    parts = []
    for m in PART.finditer(run):
        inside = re.search(r"\(?[0-9](?:.*[0-9])?", m.group())
        if inside:
            parts.append((m.start() + inside.start(), m.start() + inside.end(), len(_digits(inside.group()))))
    if len(parts) > MOST_PARTS and (kinds := _kinds(run, sum(n for _, _, n in parts))):
        yield kinds, 0, len(run)
    for i, (start, _, _) in enumerate(parts):
        n = 0
        for _, end, digits in parts[i : i + MOST_PARTS]:
            n += digits
            if n > MOST_DIGITS:
                break
            if kinds := _kinds(run[start:end], n):
                yield kinds, start, end


def instances(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kinds as a bit mask, start, end) of identifier-like spans that touch no seed."""
    found = []
    before = 0
    for m in AT.finditer(text) if "@" in text else ():
        run = text[before : m.start()]
        size = len(run) - len(run.rstrip(LOCAL_PART))
        end = m.start() + len(m.group().rstrip(".,;:!?)]}>'\""))
        if size and end > m.start() + 1:
            found.append((1, m.start() - size, end))
        before = m.end()
    for m in GROUP.finditer(text):
        at = m.start()
        found += [(kinds, at + s, at + e) for kinds, s, e in _sequences(m.group())]
    taken = sorted((s, e) for _, s, e in seeds)
    at = np.array([s for s, _ in taken])
    out = []
    for kinds, s, e in found:
        i = int(np.searchsorted(at, e)) - 1 if len(at) else -1
        if i < 0 or taken[i][1] <= s:
            out.append((kinds, s, e))
    return out


def _words(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The two words before a span and the one after it, whole, '' where there is none."""
    size, left, right = 64, [], []
    while len(left) < 3 and (size == 64 or start > size // 4):
        left = WORD.findall(text, max(0, start - size), start)  # the first may be cut
        size *= 4
    m = WORD.search(text, end)
    right = [m.group()] if m else []
    return ["", "", *left][-2:], [*right, ""][:1]


def patterns(text: str, start: int, end: int) -> list[str]:
    """The contexts of a span: one word before; two words before; one before and one after. Digits count as 0."""
    left, right = (["".join("0" if "0" <= c <= "9" else c for c in w.lower()) for w in words] for words in _words(text, start, end))
    return [f"{left[-1]}\t", f"{left[-2]} {left[-1]}\t", f"{left[-1]}\t{right[0]}"]


def _hashes(items: list[str]) -> np.ndarray:
    raw = [x.encode() for x in items]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), cuts[:-1], cuts[1:]).view(np.int64)


FOUND = "array<struct<kind:int,start:long,stop:long>>"
SLOTS = "array<struct<seed:int,kinds:int,start:long,stop:long,n:long,item:long,ctx:array<long>>>"


_SPAN = [("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]
_SLOT = [("seed", pa.int32()), ("kinds", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("n", pa.int64()), ("item", pa.int64()), ("ctx", pa.list_(pa.int64()))]


def _listed(ends: list[int], rows: list[tuple], fields: list[tuple], *more: pa.Array) -> pa.Array:
    """Lists of structs: the fields of ``rows``, then whole columns, cut at ``ends``."""
    made = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields[: len(fields) - len(more)])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([*made, *more], [n for n, _ in fields]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), base spans and the slots of the graph, for rows (doc_id, mark, text)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                hint = ((data >= 48) & (data <= 57)) | (data == 64)
                some = per_row(hint, offsets) > 0
                base, slots, n_base, n_slots = [], [], [0], [0]
                items, contexts = [], []
                for i, has in enumerate(some):
                    if has:
                        text = rows.column(2)[i].as_py()
                        seeds = base_spans(text)
                        both = [(k, 1 << k, s, e) for k, s, e in seeds] + [(-1, k, s, e) for k, s, e in instances(text, seeds)]
                        starts = Counter(s for _, _, s, _ in both)
                        base += seeds
                        slots += [(k, m, s, e, PLACE // starts[s]) for k, m, s, e in both]
                        items.append(_hashes([text[s:e].lower() for _, _, s, e in both]))
                        contexts.append(_hashes([p for _, _, s, e in both for p in patterns(text, s, e)]))
                    n_base.append(len(base))
                    n_slots.append(len(slots))
                joined = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (items, contexts)]
                ctx = pa.ListArray.from_arrays(pa.array(range(0, 3 * len(slots) + 1, 3), pa.int32()), joined[1])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), _listed(n_base, base, _SPAN), _listed(n_slots, slots, _SLOT, joined[0], ctx)], ["doc_id", "mark", "base", "slots"]
                )

    return docs.mapInArrow(run, f"doc_id long, mark long, base {FOUND}, slots {SLOTS}")


def pattern_graph(slots: DataFrame) -> DataFrame:
    """(pattern, kind, item, n, is_seed) from rows (doc_id, mark, seed, kinds, start, item, ctx).

    Occurrences are folded by a partial aggregate, so a pattern around a third
    of all slots costs one row for each distinct item. ``n`` counts places in
    units of PLACE: sequences that start at one place share it.
    """
    kinds = F.array(*[F.when(F.col("kinds").bitwiseAND(1 << k) != 0, F.lit(k)) for k in range(len(KINDS))])
    each = slots.select("item", "n", (F.col("seed") >= 0).alias("is_seed"), F.explode(F.array_compact(kinds)).alias("kind"), "ctx")
    return each.select("item", "n", "is_seed", "kind", F.explode(F.array_distinct("ctx")).alias("pattern")).groupBy("pattern", "kind", "item").agg(
        F.sum("n").alias("n"), F.max("is_seed").alias("is_seed")
    )


def trusted_instances(slots: DataFrame, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """(item, kind) of instances that are seeds somewhere or that patterns vouch for.

    A pattern vouches for the instances of a kind that it surrounds if at least ``support``
    different ones are trusted and their places are ``trust`` of all
    its places, one more counted against it. Sums are whole numbers, so
    the outcome does not hang on their order. Rounds run until none adds an item.
    """
    graph = stored(pattern_graph(slots), "pattern-graph")
    known = stored(graph.where("is_seed").select("item", "kind").distinct(), "trusted")
    fresh = known
    # per pattern: all its places; trusted ones are added as items become trusted
    total = stored(graph.groupBy("pattern", "kind").agg(F.sum("n").alias("n")), "pattern-places")
    held = None
    while True:
        gained = graph.join(fresh, ["item", "kind"], "left_semi").groupBy("pattern", "kind").agg(F.sum("n").alias("n_held"), F.count("*").alias("items"))
        held = gained if held is None else held.unionByName(gained).groupBy("pattern", "kind").agg(F.sum("n_held").alias("n_held"), F.sum("items").alias("items"))
        held = stored(held, "pattern-trust")
        good = held.where(F.col("items") >= support).join(total, ["pattern", "kind"]).where(F.col("n_held") >= trust * (F.col("n") + PLACE))
        reached = graph.join(good.select("pattern", "kind"), ["pattern", "kind"], "left_semi").select("item", "kind").distinct()
        fresh = stored(reached.join(known, ["item", "kind"], "left_anti"), "newly-trusted")
        if fresh.isEmpty():
            break
        known = stored(known.unionByName(fresh), "trusted")
    # one item, one kind: the one listed first
    return known.groupBy("item").agg(F.min("kind").alias("kind"))


def _leftmost(spans: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, more) with the spans of ``more`` that overlap none before them."""
    schema = spans.schema

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for row in batch.column(2).to_pylist():
                out, at = [], -1
                for s in sorted(row, key=lambda s: (s["start"], -s["stop"], s["kind"])):
                    if s["start"] >= at:
                        out.append(s)
                        at = s["stop"]
                kept.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, batch.schema.field(2).type)], batch.schema.names)

    return spans.mapInArrow(run, schema)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark, base (spans), found (all spans), for every row of ``docs``.

    Null and empty texts have no span. ``mark`` is the xxhash64 of the text;
    rows that repeat both id and text get the same spans. Null ids are kept.
    Columns beyond the two are not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).alias("text"))
    seen = stored(scan(rows), "pii-scan")
    slots = seen.select("doc_id", "mark", F.explode("slots").alias("s")).select("doc_id", "mark", "s.*")
    trusted = trusted_instances(slots)
    more = slots.where("seed < 0").join(trusted, "item").select("doc_id", "mark", F.struct("kind", "start", "stop").alias("span"))
    per_doc = _leftmost(more.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("more")))
    a, b = seen.select("doc_id", "mark", "base").alias("a"), per_doc.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.mark") == F.col("b.mark")), "left")
    return joined.select("a.doc_id", "a.mark", "a.base", F.concat("a.base", F.coalesce("b.more", F.array().cast(FOUND))).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans written out."""
    spans = extract(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets.

    Overlapping spans are replaced by one mark, that of the span that starts
    first. A null text stays null; ``n_chars``, where present, is set anew for
    the texts that change.
    """
    found = extract(docs, doc_id, text).where(F.size("found") > 0).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.array_sort(F.transform("found", lambda s: F.struct(s["start"], s["stop"], s["kind"]))).alias("__spans"))
    once = found.dropDuplicates(["__id", "__mark"]).hint("merge")
    joined = docs.join(once, F.col(doc_id).cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(text_of(text)) == F.col("__mark")), "left")
    place = docs.columns.index(text)
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            spans = batch.column(len(docs_names))
            bodies, columns = batch.column(place), list(batch.columns[: len(docs_names)])
            at = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                texts = bodies.to_pylist()
                for i in at:
                    texts[i] = _replaced(texts[i], spans[int(i)].as_py())
                columns[place] = pa.array(texts, bodies.type)
                if sized is not None:
                    sizes = columns[sized].to_pylist()
                    for i in at:
                        sizes[i] = len(texts[i])
                    columns[sized] = pa.array(sizes, columns[sized].type)
            yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = docs.columns
    return joined.select(*[docs[c] for c in docs.columns], "__spans").mapInArrow(run, docs.schema)


def _replaced(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{KINDS[s['kind']]}]"]
        at = max(at, s["stop"])
    return "".join([*out, text[at:]])
