"""Model replies: hooks that plug a scorer or a reply table into the pipeline.

A *scorer* is a function prepared -> prepared with reply columns. It can be
passed to ``screen``, ``screen_and_record`` and both streams.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from unveil.operators.pipeline import attach_replies
from unveil.session import ship_package

Model = Callable[[pd.DataFrame], pd.Series]
MODEL_BYTES = 4 << 20


def score_with(prompts: DataFrame, model: Model) -> DataFrame:
    """The reply table (evidence_id, kind, response) that ``model`` gives for a prompt table.

    ``model`` maps a batch of prompts to a Series of replies. It runs where
    the prompts are, on parts of Arrow batches of
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows that hold about MODEL_BYTES.
    """
    ship_package(prompts.sparkSession)
    names = prompts.columns

    def run(batches):
        for batch in batches:
            step = max(1, batch.num_rows * MODEL_BYTES // max(1, batch.nbytes))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                replies = [None if pd.api.types.is_scalar(x) and pd.isna(x) else x for x in model(part.to_pandas())]
                kept = [part.column(names.index(c)) for c in ("evidence_id", "kind")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(replies, pa.string())], ["evidence_id", "kind", "response"])

    return prompts.mapInArrow(run, "evidence_id string, kind string, response string")


def model_scorer(model: Model) -> Callable[[DataFrame], DataFrame]:
    """A scorer that asks ``model`` for both replies of each row in place, without a shuffle."""

    def score(prepared: DataFrame) -> DataFrame:
        ship_package(prepared.sparkSession)
        names = prepared.columns
        text = T.StringType()
        schema = T.StructType([*prepared.schema.fields, T.StructField("detection_response", text), T.StructField("canary_response", text)])

        def run(batches):
            for batch in batches:
                ids = batch.column(names.index("evidence_id")).to_pylist()
                replies = []
                for kind in ("detection", "canary"):
                    prompts = batch.column(names.index(f"{kind}_prompt")).to_pylist()
                    asked = model(pd.DataFrame({"evidence_id": ids, "kind": kind, "prompt": prompts}))
                    replies.append(pa.array([None if x is None else str(x) for x in asked], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *replies], [*names, "detection_response", "canary_response"])

        return prepared.mapInArrow(run, schema)

    return score


def table_scorer(folded: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A scorer that reads a folded reply table (``replies_by_evidence``, written once)."""
    return lambda prepared: attach_replies(prepared, folded)
