"""Registered queries against their DuckDB SQL twins at sf0.001 (a fast subset)."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF001
from unveil.plans.registry import REGISTRY
from unveil.sources.tables import TABLES

FAST = ["c1_html_comments", "c10_clean", "c12_rendered_log", "e2_detection_matrix", "j7_parse_response",
        "p4_check", "p4_check_reply_table", "p6_panel_acceptance", "p2_reply_cache", "s1_strict_corpus", "j8_verdict", "l2_screen_and_record", "e6_parity_diff", "r2_conformance", "r4_vote_tally", "e8_removal_census"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join("<null>" if r[i] is None else str(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_every_query_has_a_twin():
    assert all(q.sql is not None for q in REGISTRY.values())


@pytest.mark.parametrize("name", FAST)
def test_matches_duckdb(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)
