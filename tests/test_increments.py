from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from caseflow import operators as op
from caseflow.functions import previous_values
from caseflow.schema import CANON

from conftest import day, ordered, plan, rows


def by_day(df, *columns):
    return rows(df.orderBy("date", "state", "source"), *columns)


@pytest.fixture(scope="module")
def null_state(make):
    return make((1, "A", None, 10, 1, "L"), (2, "A", None, 15, 2, "L"), (1, "A", "x", 1, 0, "W"), (2, "A", "x", 4, 1, "W"))


def test_null_state_is_a_group_of_its_own(null_state):
    out = op.lag_prev(null_state)
    assert by_day(out, "state", "prev_confirmed", "prev_deaths") == [
        (None, None, None), ("x", None, None), (None, 10, 1.0), ("x", 1, 0.0)]


def test_null_state_can_be_dropped(null_state):
    out = op.daily_new(null_state, null_keys="drop")
    assert by_day(out, "state", "prev_confirmed", "daily_new_cases", "daily_new_deaths") == [
        (None, None, 0, 0.0), ("x", None, 0, 0.0), (None, None, 0, 0.0), ("x", 1, 3, 1.0)]


def test_unknown_null_rule_is_refused(null_state):
    with pytest.raises(ValueError):
        op.lag_prev(null_state, null_keys="other")


def test_correction_clipped_and_signed(make):
    df = make((1, "A", None, 5, None, "L"), (2, "A", None, 9, None, "L"), (3, "A", None, 7, None, "L"), (4, "A", None, None, None, "L"))
    assert by_day(op.daily_new(df), "daily_new_cases") == [(0,), (4,), (0,), (0,)]
    assert by_day(op.daily_new(df, clip=False), "daily_new_cases") == [(0,), (4,), (-2,), (0,)]


def test_a_null_total_is_the_next_rows_previous_value(make):
    df = make((1, "A", None, 5, None, "L"), (2, "A", None, None, None, "L"), (3, "A", None, 7, None, "L"))
    assert by_day(op.daily_new(df), "prev_confirmed", "daily_new_cases") == [(None, 0), (5, 0), (None, 0)]


def test_feeds_of_one_place_follow_each_other_by_source(make):
    df = make((1, "A", None, 10, None, "N"), (1, "A", None, 8, None, "L"), (2, "A", None, 11, None, "L"), (2, "A", None, 14, None, "N"))
    together = rows(op.lag_prev(df).orderBy("date", "source"), "source", "prev_confirmed")
    assert together == [("L", None), ("N", 8), ("L", 10), ("N", 11)]
    apart = rows(op.lag_prev(df, per_source=True).orderBy("date", "source"), "source", "prev_confirmed")
    assert apart == [("L", None), ("N", None), ("L", 8), ("N", 10)]


def test_result_does_not_depend_on_the_input_partitions(make):
    df = make(*[(d, "A", None, d * 7 % 5 + i, i, s) for d in range(1, 6) for i, s in enumerate("LMLM")])
    first = ordered(rows(op.daily_new(df)))
    assert ordered(rows(op.daily_new(df.repartition(5)))) == first
    assert ordered(rows(op.daily_new(df.orderBy(F.desc("confirmed"))))) == first


def test_clipped_is_the_positive_part_of_signed(make):
    df = make(*[(d, c, None, d * 13 % 7, d * 5 % 3, "L") for d in range(1, 12) for c in "AB"])
    clipped = ordered(rows(op.daily_new(df), "date", "country", "daily_new_cases", "daily_new_deaths"))
    signed = ordered(rows(op.daily_new(df, clip=False), "date", "country", "daily_new_cases", "daily_new_deaths"))
    assert any(s[2] < 0 for s in signed)
    assert clipped == ordered((d, c, max(x, 0), max(y, 0.0)) for d, c, x, y in signed)


case = st.tuples(
    st.one_of(st.none(), st.integers(1, 4)),
    st.sampled_from(["A", "B", None]),
    st.sampled_from(["x", None]),
    st.one_of(st.none(), st.integers(0, 6)),
    st.one_of(st.none(), st.integers(0, 3)),
    st.sampled_from(["L", "W", None]),
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(case, max_size=25))
def test_split_lag_equals_one_window(spark, cases):
    full = [(None if d is None else day(d), c, s, n, None if x is None else float(x), None, src) for d, c, s, n, x, src in cases]
    df = spark.createDataFrame(full, CANON)
    whole = ordered(rows(op.lag_prev(df, pieces=())))
    assert ordered(rows(op.lag_prev(df))) == whole
    assert ordered(rows(op.lag_prev(df, pieces=(("date", "source"), ("date",))))) == whole
    assert ordered(rows(op.lag_prev(df.repartition(4), copies=3))) == whole


def test_split_lag_on_raw_rows_of_a_few_hot_keys(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("day", F.to_date("ts"))
    split, whole = (
        previous_values(events, {"before": "event_id"}, keys=["event_type"], order_by=["day", "ts", "event_id"], pieces=p)
        for p in ([["day"]], [])
    )
    columns = ("event_id", "before")
    assert ordered(rows(split, *columns)) == ordered(rows(whole, *columns))


def test_copies_are_spread_over_tasks(make):
    df = make(*[(1, "A", None, 5, 1, "L")] * 40, (2, "A", None, 7, 2, "L"), (1, "A", None, 1, 0, "K")).repartition(8)
    out = op.daily_new(df, copies=8)
    assert ordered(rows(out, "confirmed", "prev_confirmed", "daily_new_cases")) == ordered(
        [(1, None, 0), (5, 1, 4), *[(5, 5, 0)] * 39, (7, 5, 2)])
    exchanges = [line for line in plan(op.daily_new(df, copies=8)).splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 3 and "_salt" in exchanges[-1]


def test_one_shuffle_carries_the_rows_and_the_key_is_split_by_day(make):
    df = make((1, "A", None, 1, 1, "L")).withColumn("note", F.lit("x").cast("string"))
    out = op.lag_prev(df.withColumn("note", F.concat("country", F.lit("!"))))
    text = plan(out)
    assert text.count("Window [") <= 2
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    # the rows by key and day; the last row of each day, combined before it moves; the days by key
    assert len(exchanges) == 3 and "partial_max" in text
    assert "date" in exchanges[0] and "country" in exchanges[0] and "state" in exchanges[0]
    assert text.count("concat(") == 1  # whatever else a row has is in one branch alone


def test_lag_of_the_ordering_column_itself(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 1, 2), ("A", 3, 1), ("B", 2, 1), ("A", None, 9)], "k string, d int, e int")
    out = previous_values(df, {"pd": "d", "pe": "e", "pk": "k"}, keys=["k"], order_by=["d", "e"], pieces=[["d"]])
    assert ordered(rows(out)) == ordered([
        ("A", None, 9, None, None, None), ("A", 1, 1, None, 9, "A"), ("A", 1, 2, 1, 1, "A"), ("A", 3, 1, 1, 2, "A"), ("B", 2, 1, None, None, None)])


def test_a_country_filter_passes_below_the_windows(make, spark, tmp_path):
    path = str(tmp_path / "cases")
    make((1, "A", None, 1, 1, "L"), (1, "B", None, 1, 1, "L")).write.parquet(path)
    stored = spark.read.parquet(path)
    text = plan(op.one_country(op.daily_new(stored), "A"))
    assert "EqualTo(country,A)" in text
