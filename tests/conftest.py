import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from unveil.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[*]", shuffle_partitions=8, **{"spark.driver.memory": "8g", "spark.unveil.input.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture()
def clean_rows(spark):
    """texts -> list of (cleaned_text, removed_items) through the native chain."""
    from unveil.functions.cleaner import clean

    def run(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "evidence_id int, text string")
        rows = clean(df).orderBy("evidence_id").collect()
        return [(r.cleaned_text, list(r.removed_items)) for r in rows]

    return run
