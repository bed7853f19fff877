"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
CHOSEN = [
    "align_diaries", "derive_cycles", "ilp_flag", "participant_summary", "windows_calendar", "windows_cycle_runs", "window_base_fields", "pooled_adsf_and_ratios", "label_A_windowed", "label_B", "label_C", "label_A_exact",
    "historical_all", "cycle_labels", "summarize_windows", "summarize_reasons", "diff_runs", "age_band_metrics", "subphase_medians", "waveform_metrics", "bootstrap", "medication_mix", "read_summary_csv",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, DIR)
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
