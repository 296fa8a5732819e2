"""The four Arrow-batched Python helpers.

Spark has no NFKC normalisation, no Python ``repr``, no JSON parser with
Python's strictness and no matching of nested tags in linear time, so these run as Arrow UDFs, one value
at a time and without pandas, which would take 45 MB of each worker. Callers mask the input to
null on rows that cannot need them (ASCII text, simple payloads), so the
Python side mostly sees nulls and returns nulls.
"""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unveil.functions.hidden import hidden_elements


@F.arrow_udf(T.StringType())
def nfkc_if_changed(texts: pa.Array) -> pa.Array:
    """NFKC form of each text, or null when normalisation changes nothing."""

    def one(t):
        if t is None or unicodedata.is_normalized("NFKC", t):
            return None
        out = unicodedata.normalize("NFKC", t)
        return None if out == t else out

    return pa.array((one(t.as_py()) for t in texts), pa.string())


HIDDEN_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("payloads", T.ArrayType(T.StringType()))])


@F.arrow_udf(HIDDEN_SCHEMA)
def hidden_if_any(texts: pa.Array) -> pa.Array:
    """Text without hidden styled elements, and their contents; nulls where there are none."""
    found = [(hidden_elements(t.as_py()) if t.is_valid else None) or (None, None) for t in texts]
    columns = [pa.array((f[0] for f in found), pa.string()), pa.array((f[1] for f in found), pa.list_(pa.string()))]
    return pa.StructArray.from_arrays(columns, ["text", "payloads"])


@F.arrow_udf(T.ArrayType(T.StringType()))
def python_repr_all(payloads: pa.Array) -> pa.Array:
    """Python ``repr`` of every element; null elements stay null."""

    def one(arr):
        if arr is None:
            return None
        return [None if p is None else repr(p) for p in arr]

    return pa.array((one(p.as_py()) for p in payloads), pa.list_(pa.string()))


MALFORMED = (False, True, None)


def strict_verdict(body: str | None) -> tuple[bool, bool, str | None]:
    """(well_formed, detected, category_text) of one reply without its fence.

    Python's strict JSON decoder and truthiness are the rule here; everything
    that is not an object with a verdict key, or that the decoder refuses, is
    malformed. A category that UTF-8 cannot carry (a lone surrogate) keeps its
    other characters: labels compare by letters and digits only.
    """
    try:
        found = json.loads(body or "")
        if not isinstance(found, dict):
            return MALFORMED
        label = str(found.get("category", "")).encode("utf-8", "ignore").decode()
        return True, bool(found["injection_detected"]), label
    except Exception:  # noqa: BLE001 -- one reply must not fail a job
        return MALFORMED


VERDICT_SCHEMA = T.StructType(
    [
        T.StructField("well_formed", T.BooleanType()),
        T.StructField("detected", T.BooleanType()),
        T.StructField("category_text", T.StringType()),
    ]
)


@F.arrow_udf(VERDICT_SCHEMA)
def parse_verdict(raw: pa.Array) -> pa.Array:
    rows = [strict_verdict(r.as_py()) for r in raw]
    kinds = (pa.bool_(), pa.bool_(), pa.string())
    return pa.StructArray.from_arrays([pa.array((r[k] for r in rows), kind) for k, kind in enumerate(kinds)], ["well_formed", "detected", "category_text"])
