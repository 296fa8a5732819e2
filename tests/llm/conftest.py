import random

import pytest
from pyspark.sql import functions as F

from llm.llm_words import words

COLUMNS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, copy_no int, bucket string, "
    "hub int, n int, kind string, row string, mark string, ids string, lang_pred string, predicted string, rank int, shard int"
)


def hostile_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(4)
    base = words(rng, 60)
    texts = [
        base, base, base + " tail", words(rng, 40), "", None, " \t\n ", "one", "12 345", "two words here", "x" * 300_000,
        words(rng, 60_000), "mail a.b@c.de and 10.0.0.1 or +1 (555) 123-4567 twice 4111 1111 1111 1111", "日本語 の テキスト", " odd space  twice ",
    ]
    rows = [(i * 3, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3]) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, None, None), (None, None, "en", "a"), (3, "another version of three", "en", "a"), (-7, base, "fr", "b")]
    return [(*r, None if r[1] is None else len(r[1]), "s", 1, "b", 2, 3, "k", "r", "m", "i", "l", "p", 4, 5) for r in rows]


@pytest.fixture(scope="session")
def hostile(spark):
    return spark.createDataFrame(hostile_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, **more):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        for k, v in more.items():
            df = df.withColumn(k, F.lit(v))
        return df

    return make
