"""What the Python workers hold: no pandas for the cleaner and the reply reader, bounded parts for a model."""

import subprocess
import sys
from pathlib import Path

import pandas as pd

from unveil.operators import responses as R


def test_helpers_import_no_pandas():
    said = "import sys; import unveil.functions.udfs; print('pandas' in sys.modules)"
    root = Path(__file__).resolve().parent.parent
    assert subprocess.run([sys.executable, "-c", said], cwd=root, capture_output=True, text=True, check=True).stdout.strip() == "False"


def test_a_model_gets_bounded_parts(spark):
    rows = spark.range(400, numPartitions=1).selectExpr("cast(id as string) evidence_id", "'detection' kind", "if(id = 7, null, repeat(cast(id as string), 20000)) prompt")

    def model(pdf: pd.DataFrame) -> pd.Series:
        size = sum(len(x or "") for x in pdf["prompt"])
        return pd.Series([None if x is None else str(size) for x in pdf["prompt"]], index=pdf.index, dtype=object)

    got = {r.evidence_id: r.response for r in R.score_with(rows, model).collect()}
    assert len(got) == 400 and got["7"] is None
    assert max(int(x) for x in got.values() if x) <= 2 * R.MODEL_BYTES
