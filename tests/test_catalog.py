"""Every registered query against its SQL, on the smallest test tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from caseflow.plans import catalog

from conftest import ordered, plan

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_point.queries(), entry_point.oracle_sql()

# FIXED: the query keys of the coverage list.
KEYS = """
src_csv_roundtrip src_csv_strings src_parquet_roundtrip src_document_roundtrip src_json_roundtrip jsonl_compact
sink_partitioned_csv wide_to_long std_long std_single combine_sources combine_sorted_head latest_nonnull
missing_summary missing_by_column missing_ratio schema_profile unique_countries unique_states
unique_states_nonnull unique_counts lag_prev daily_new_dropnull daily_new_clipped daily_new_signed
world_daily_anomaly world_daily_cases_deaths country_daily country_daily_dropnull country_cumulative
world_cumulative country_anomaly latest_by_year yearly_cumulative global_totals active_countries_daily
countries_with_data world_cum_anomaly growth_rate top20_cumulative top20_latest valid_country_filter
country_series box_stats anomaly_points box_outliers
""".split()

ORDERED = {
    "combine_sorted_head": "country NULLS FIRST, state NULLS FIRST, date NULLS FIRST, source",
    "unique_countries": "country NULLS FIRST",
    "unique_states": "state NULLS FIRST",
    "unique_states_nonnull": "state",
    "top20_cumulative": "cum_confirmed DESC NULLS LAST, country",
    "top20_latest": "confirmed DESC NULLS LAST, country",
    "countries_with_data": "country",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def test_the_coverage_list_is_registered():
    assert set(KEYS) <= set(QUERIES)
    assert set(ORACLE) <= set(QUERIES)


def test_entry_gives_rows(spark):
    assert entry_point.entry(spark).columns == ["date", "daily_new", "roll_mean", "anomaly"]


@pytest.mark.parametrize("key", [k for k in QUERIES if k in ORACLE])
def test_query_equals_sql(spark, duck, key):
    df = QUERIES[key](spark, SF)
    columns = sorted(df.columns)
    names = ", ".join(columns)
    order = f" ORDER BY {ORDERED[key]}" if key in ORDERED else ""
    ours = [tuple(r) for r in df.select(columns).collect()]
    theirs = [tuple(map(plain, r)) for r in duck.execute(f"SELECT {names} FROM ({ORACLE[key]}){order}").fetchall()]
    full = duck.execute(ORACLE[key])
    assert sorted(c[0] for c in full.description) == columns
    assert ours, key
    assert (ours if order else ordered(ours)) == (theirs if order else ordered(theirs))


# these read back what they or a first job wrote
STORED = ("src_", "jsonl", "sink", "wide_", "combine", "feed_", "box_", "csv_", "json_")
LAZY = [k for k in catalog.QUERIES if not k.startswith((*STORED, "events_"))]


@pytest.mark.parametrize("key", LAZY)
def test_plan_reads_the_orders_once_and_stays_in_the_jvm(spark, key):
    df = QUERIES[key](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = plan(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in text
    scans = [line for line in text.splitlines() if "FileScan" in line and "o_custkey" in line]
    assert len(scans) == 1, scans
    assert "o_totalprice" not in scans[0]


def test_raw_rows_are_shuffled_once_for_the_lag(spark):
    out = QUERIES["events_lag"](spark, SF)
    out.collect()
    text = plan(out)
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 3 and "date" in exchanges[0] and "Join" not in text
    # under the second and third there is one row per place and day
    below = text[text.index(exchanges[2]) :]
    assert "partial_max" in below


def test_raw_rows_are_not_sorted_for_the_latest_values(spark):
    out = QUERIES["events_latest"](spark, SF)
    out.collect()
    lines = plan(out).splitlines()
    raw = next(n for n, line in enumerate(lines) if "FileScan" in line and "props" in line)
    sort = max(n for n, line in enumerate(lines[:raw]) if "Sort" in line)
    assert any("BroadcastHashJoin" in line for line in lines[sort:raw])
