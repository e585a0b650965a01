"""Registered queries against DuckDB on the smallest given tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="given tables not present")
TABLES = ("events", "lineitem")
COMPARED = (
    "filter_counts",
    "drift_scales",
    "activity_spells",
    "event_scores",
    "alloc_cap",
    "decide_hierarchical_cap",
    "summary_modes",
    "detect_drift_cusum",
    "adaptive_uniform_drift_sync",
    "recovery_episodes",
    "spearman",
    "stream_batches",
    "stream_rollup",
    "stream_thresholds",
    "stream_late",
)


def rows_of(columns, rows):
    def plain(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return None
        return round(float(value), 5) if isinstance(value, float) else value

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def test_every_statement_has_a_query():
    assert set(entries.oracle_sql()) <= set(entries.queries())


@pytest.mark.parametrize("name", COMPARED)
def test_agrees_with_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = entries.queries()[name](spark, DATA)
    answer = connection.execute(entries.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(got.columns) == sorted(columns)
    want = rows_of(columns, answer.fetchall())
    found = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert found == want


def test_entry(spark):
    frame = entries.entry(spark)
    assert frame.count() == 18 and "transmission_ratio" in frame.columns
