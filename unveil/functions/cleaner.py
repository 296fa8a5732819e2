r"""Cleaner (C0-C15) as Spark column expressions.

``clean(df, "text")`` appends ``cleaned_text``, ``removed`` (ordered
``array<struct<seq, category, n, payload>>``) and ``removed_items`` (the
rendered ``category:detail`` strings). The stages run in a fixed order;
each one is gated by a cheap test (``contains``, or for C4 to C6 one search
for any character that they act on) so text that
carries nothing is not rewritten. Each stage is a step of its own that
Catalyst does not merge with the next, so no regex is inlined and repeated.
``\b`` and ``\w`` of the fixed patterns are spelled out as Python reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unveil.functions import fixed
from unveil.functions.udfs import hidden_if_any, nfkc_if_changed, python_repr_all
from unveil.functions.unicode_sets import carrier_class, nfkc_suspects
from unveil.session import ship_package

ENTRY_TYPE = "struct<category:string,n:bigint,payload:string>"
LOG_TYPE = f"array<{ENTRY_TYPE}>"


def _empty_log() -> Column:
    return F.array().cast(LOG_TYPE)


def _empty_strings() -> Column:
    return F.array().cast("array<string>")

# Payload characters the native repr renders exactly like Python's repr;
# anything else (non-ASCII, other controls) goes to the Python fallback.
_NOT_SIMPLE = r"[^\x{20}-\x{7E}\t\n\r]"

# A word character as Python's \w has it: letters, numbers and the underscore, no combining marks.
_WORD = r"[\p{L}\p{N}_]"


def python_words(pattern: str) -> str:
    r"""A Java pattern with Python's reading of ``\b`` and ``\w``."""
    edge = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
    return pattern.replace(r"\b", edge).replace(r"\w", _WORD)


IMAGE_ALT, ALT_GATE, ROLE_LABEL = (python_words(p) for p in (fixed.IMAGE_ALT, fixed.ALT_GATE, fixed.ROLE_LABEL))
HIDDEN_STYLED_GATE = python_words(fixed.HIDDEN_STYLED_GATE)


# --------------------------------------------------------------------------
# small column helpers
# --------------------------------------------------------------------------

def py_strip(col: Column) -> Column:
    """str.strip(): remove Python whitespace from both ends."""
    return F.btrim(col, F.lit(fixed.WHITESPACE_CHARS))


def count_entry(category: str, n: Column) -> Column:
    """One-element log when n > 0, else an empty log."""
    entry = F.struct(
        F.lit(category).alias("category"),
        n.cast("bigint").alias("n"),
        F.lit(None).cast("string").alias("payload"),
    )
    return F.when(n > 0, F.array(entry)).otherwise(_empty_log())


def payload_entries(category: str, payloads: Column) -> Column:
    return F.transform(
        payloads,
        lambda p: F.struct(
            F.lit(category).alias("category"),
            F.lit(None).cast("bigint").alias("n"),
            p.alias("payload"),
        ),
    )


def flag_entry(category: str, flag: Column) -> Column:
    entry = F.struct(
        F.lit(category).alias("category"),
        F.lit(None).cast("bigint").alias("n"),
        F.lit(None).cast("string").alias("payload"),
    )
    return F.when(flag, F.array(entry)).otherwise(_empty_log())


def _extract_all(col: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def _deleted_count(before: Column, after: Column) -> Column:
    return F.length(before) - F.length(after)


def native_repr(p: Column) -> Column:
    """Python repr() for strings of printable ASCII plus tab/newline/CR."""
    use_double = p.contains("'") & ~p.contains('"')
    body = F.replace(p, F.lit("\\"), F.lit("\\\\"))
    body = F.when(use_double, body).otherwise(F.replace(body, F.lit("'"), F.lit("\\'")))
    for ch, esc in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(ch), F.lit(esc))
    quote = F.when(use_double, F.lit('"')).otherwise(F.lit("'"))
    return F.concat(quote, body, quote)


# --------------------------------------------------------------------------
# stages: each takes the current text column, returns (text, log)
# --------------------------------------------------------------------------

def _after_last_close(t: Column) -> Column:
    """What follows the last ``-->`` (all of ``t`` without one): no comment ends there."""
    return F.substring_index(t, "-->", -1)


def _up_to_last_close(t: Column) -> Column:
    """The part in which comments can lie; every open in it but those in its last bytes has a close."""
    return F.left(t, F.length(t) - F.length(_after_last_close(t)))


def c1_count(t: Column) -> Column:
    return F.when(t.contains("<!--"), F.regexp_count(_up_to_last_close(t), F.lit(fixed.HTML_COMMENT))).otherwise(F.lit(0))


def c1_text(t: Column, n: Column) -> Column:
    cut = F.regexp_replace(_up_to_last_close(t), fixed.HTML_COMMENT, "")
    return F.when(n > 0, F.concat(cut, _after_last_close(t))).otherwise(t)


def c1_html_comments(t: Column) -> tuple[Column, Column]:
    n = c1_count(t)
    return c1_text(t, n), count_entry(fixed.CAT_HTML_COMMENTS, n)


def _may_hide(t: Column) -> Column:
    """Necessary for a hidden styled element; linear, with the pattern's own flags."""
    return t.contains("</") & t.rlike(fixed.CLOSE_TAG_GATE) & t.rlike(HIDDEN_STYLED_GATE)


def c2_found(t: Column) -> Column:
    """Text without hidden styled elements and their contents; nulls if there are none."""
    return hidden_if_any(F.when(_may_hide(t), t))


def c3_alts(t: Column) -> Column:
    gate = t.contains("<") & t.rlike(fixed.IMAGE_GATE) & t.rlike(ALT_GATE)
    return F.when(gate, _extract_all(t, IMAGE_ALT, 1)).otherwise(_empty_strings())


def nonblank(arr: Column) -> Column:
    return F.filter(arr, lambda a: py_strip(a) != F.lit(""))


def may_carry(t: Column) -> Column:
    """Whether C4, C5 or C6 can act on ``t``: one search, and none in ASCII text."""
    return (F.octet_length(t) != F.length(t)) & t.rlike(carrier_class())


def c4_zero_width(t: Column, odd: Column) -> tuple[Column, Column]:
    """``odd``: the row's ``may_carry``."""
    out = F.when(odd, F.translate(t, fixed.ZERO_WIDTH_CHARS, "")).otherwise(t)
    return out, count_entry(fixed.CAT_ZERO_WIDTH, _deleted_count(t, out))


def c5_invisible_controls(t: Column, odd: Column) -> tuple[Column, Column]:
    out = F.when(odd, F.translate(t, fixed.INVISIBLE_CONTROL_CHARS, "")).otherwise(t)
    return out, count_entry(fixed.CAT_INVISIBLE_CONTROL, _deleted_count(t, out))


def c6_nfkc_changed(t: Column, odd: Column) -> Column:
    """NFKC text or null if unchanged.

    Only rows holding an NFKC-suspect character (quick-check No/Maybe or a
    combining mark; see ``unicode_sets``) reach Python; the test is one JVM
    ``translate`` pass over rows that ``may_carry`` admits. Everything else is
    provably already normalised.
    """
    suspect = odd & (F.length(F.translate(t, nfkc_suspects(), "")) != F.length(t))
    return nfkc_if_changed(F.when(suspect, t))


def c7_labels(t: Column) -> Column:
    """Every label holds a colon or a number sign."""
    return F.when(t.contains(":") | t.contains("#"), _extract_all(t, ROLE_LABEL, 0)).otherwise(_empty_strings())


def c8_brackets(t: Column) -> Column:
    return F.when(t.contains("["), _extract_all(t, fixed.ROLE_BRACKET, 0)).otherwise(_empty_strings())


def c9_line_ends(t: Column) -> Column:
    return F.when(t.contains(" \n") | t.contains("\t\n"), F.regexp_replace(t, fixed.TRAILING_BLANKS_LINEAR, "\n")).otherwise(t)


def c9_tidy(t: Column) -> Column:
    """Of text that has been through ``c9_line_ends``."""
    return py_strip(F.when(t.contains("\n\n\n"), F.regexp_replace(t, fixed.BLANK_RUN, "\n\n")).otherwise(t))


def _replace_if(t: Column, found: Column, pattern: str) -> Column:
    return F.when(F.size(found) > 0, F.regexp_replace(t, pattern, "")).otherwise(t)


# --------------------------------------------------------------------------
# the chain
# --------------------------------------------------------------------------

def _stage(d: DataFrame, *added: Column) -> DataFrame:
    """``d`` and the columns of a stage, made once each.

    As plain projections the stages would be merged into one, with the
    text of every stage repeated wherever a later one reads it; ``result_barrier``
    says why a one-row generator keeps them apart.
    """
    return d.select("*", F.inline(F.array(F.struct(*added))))


def clean(df: DataFrame, text_col: str = "text", keep_stages: bool = False, render: bool = True) -> DataFrame:
    """C0..C11 + C12 over ``text_col``; adds cleaned_text, removed, removed_items.

    With ``keep_stages`` the per-stage text columns ``_t0``..``_t8`` stay in
    the output (used by the per-operator queries). ``render=False`` leaves
    out removed_items and the repr UDF behind it.
    """
    ship_package(df.sparkSession)
    src = F.col(text_col)
    base = df.columns
    d = _stage(
        df,
        F.coalesce(src, F.lit("")).alias("_t0"),
        flag_entry(fixed.CAT_INPUT_WAS_NONE, src.isNull()).alias("_l0"),
    )
    d = _stage(d, c1_count(F.col("_t0")).alias("_n1"))
    d = _stage(
        d,
        c1_text(F.col("_t0"), F.col("_n1")).alias("_t1"),
        count_entry(fixed.CAT_HTML_COMMENTS, F.col("_n1")).alias("_l1"),
    )
    d = d.select("*", c2_found(F.col("_t1")).alias("_f2"))
    d = _stage(
        d,
        F.coalesce(F.col("_f2.text"), F.col("_t1")).alias("_t2"),
        payload_entries(fixed.CAT_HIDDEN_STYLED, F.coalesce(F.col("_f2.payloads"), _empty_strings())).alias("_l2"),
    )
    d = _stage(d, c3_alts(F.col("_t2")).alias("_p3"))
    d = _stage(
        d,
        _replace_if(F.col("_t2"), F.col("_p3"), IMAGE_ALT).alias("_t3"),
        payload_entries(fixed.CAT_IMAGE_ALT, nonblank(F.col("_p3"))).alias("_l3"),
    )
    d = _stage(d, may_carry(F.col("_t3")).alias("_odd"))
    t4, l4 = c4_zero_width(F.col("_t3"), F.col("_odd"))
    d = _stage(d, t4.alias("_t4"), l4.alias("_l4"))
    t5, l5 = c5_invisible_controls(F.col("_t4"), F.col("_odd"))
    d = _stage(d, t5.alias("_t5"), l5.alias("_l5"))
    d = d.select("*", c6_nfkc_changed(F.col("_t5"), F.col("_odd")).alias("_n6"))
    d = _stage(
        d,
        F.coalesce(F.col("_n6"), F.col("_t5")).alias("_t6"),
        flag_entry(fixed.CAT_UNICODE_NORMALIZED, F.col("_n6").isNotNull()).alias("_l6"),
    )
    d = _stage(d, c7_labels(F.col("_t6")).alias("_p7"))
    d = _stage(
        d,
        _replace_if(F.col("_t6"), F.col("_p7"), ROLE_LABEL).alias("_t7"),
        payload_entries(fixed.CAT_FAKE_ROLE, F.transform("_p7", py_strip)).alias("_l7"),
    )
    d = _stage(d, c8_brackets(F.col("_t7")).alias("_p8"))
    d = _stage(
        d,
        _replace_if(F.col("_t7"), F.col("_p8"), fixed.ROLE_BRACKET).alias("_t8"),
        payload_entries(fixed.CAT_FAKE_ROLE, F.col("_p8")).alias("_l8"),
    )
    log = F.concat(*[F.col(f"_l{i}") for i in range(9)])
    d = _stage(d, c9_line_ends(F.col("_t8")).alias("_t9"))
    d = _stage(
        d,
        c9_tidy(F.col("_t9")).alias("cleaned_text"),
        F.transform(
            log,
            lambda e, i: F.struct(
                (i + 1).alias("seq"), e["category"].alias("category"),
                e["n"].alias("n"), e["payload"].alias("payload"),
            ),
        ).alias("removed"),
    )
    stages = [f"_t{i}" for i in range(9)] if keep_stages else []
    # Materialise the chain before the repr UDF reads the log; otherwise the
    # UDF's input projection re-evaluates the inlined stage expressions.
    d = d.select(*base, result_barrier(["cleaned_text", "removed", *stages]))
    if not render:
        return d
    d = with_rendered_items(d)
    return d.select(*base, result_barrier(["cleaned_text", "removed", "removed_items", *stages]))


def result_barrier(cols: list[str]) -> Column:
    """Emit derived columns through a one-row generator.

    Predicate pushdown moves a filter below a Project by inlining the alias
    definitions; over a ten-stage chain where each stage reads the previous
    text several times that inlining grows exponentially and drags the
    Python UDFs below any exchange. A filter on a generator's output cannot
    move below the generator, while filters on pass-through columns still
    reach the scan. ``inline`` of a one-element array is a cheap barrier.
    """
    return F.inline(F.array(F.struct(*[F.col(c) for c in cols])))


def with_rendered_items(d: DataFrame, log_col: str = "removed") -> DataFrame:
    """``removed_items`` as ``category:detail`` strings, Python repr for payloads."""
    log = F.col(log_col)
    needs_python = F.exists(log, lambda e: e["payload"].rlike(_NOT_SIMPLE))
    d = d.select(
        "*",
        python_repr_all(
            F.when(needs_python, F.transform(log, lambda e: e["payload"]))
        ).alias("_py_repr"),
    )

    def render(e: Column, i: Column) -> Column:
        cat = e["category"]
        detail = (
            F.when(cat == fixed.CAT_INPUT_WAS_NONE, F.lit(None))
            .when(cat == fixed.CAT_UNICODE_NORMALIZED, F.lit("NFKC"))
            .when(e["n"].isNotNull(), e["n"].cast("string"))
            .when(F.col("_py_repr").isNotNull(), F.element_at(F.col("_py_repr"), i + 1))
            .otherwise(native_repr(e["payload"]))
        )
        return F.when(detail.isNull(), cat).otherwise(F.concat(cat, F.lit(":"), detail))

    return d.select("*", F.transform(log, render).alias("removed_items")).drop("_py_repr")


# --------------------------------------------------------------------------
# C13-C15
# --------------------------------------------------------------------------

def category_of(item: Column) -> Column:
    """Text before the first ':' of a rendered entry."""
    return F.substring_index(item, ":", 1)


def conclusive_items(items: Column) -> Column:
    """C14 over rendered entries."""
    return F.filter(items, lambda x: category_of(x).isin(*fixed.CONCLUSIVE_CATEGORIES))


def advisory_items(items: Column) -> Column:
    """C15 over rendered entries."""
    return F.filter(items, lambda x: category_of(x).isin(*fixed.ADVISORY_CATEGORIES))


def is_conclusive(removed: Column) -> Column:
    return F.exists(removed, lambda e: e["category"].isin(*fixed.CONCLUSIVE_CATEGORIES))
