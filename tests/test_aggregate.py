from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseflow import operators as op
from caseflow.schema import CANON

from conftest import day, ordered, plan, rows


def test_falling_total_has_a_maximum_that_is_not_the_latest(make):
    df = make((1, "A", None, 5, 1, "L"), (2, "A", None, 9, 2, "L"), (3, "A", None, 7, 3, "L"))
    assert rows(op.cumulative_max(df)) == [("A", 9, 3.0)]
    assert rows(op.latest_nonnull(df), "confirmed", "deaths") == [(7, 3.0)]


def test_latest_may_mix_dates(make):
    df = make((1, "A", "x", 5, 1, "L"), (2, "A", None, 9, None, "L"), (3, "A", None, None, None, "M"))
    assert rows(op.latest_nonnull(df)) == [("A", day(3), "x", 9, 1.0, None, "M")]


def test_latest_breaks_ties_by_state_then_source_then_value(make):
    df = make((1, "A", None, 5, None, "Z"), (1, "A", "x", 6, None, "L"), (1, "A", "x", 7, None, "M"), (1, "A", "x", 8, None, "M"))
    for shape in (df, df.repartition(4), df.orderBy(F.desc("confirmed")).coalesce(1)):
        assert rows(op.latest_nonnull(shape), "confirmed") == [(8,)]


def test_latest_does_not_sort_the_raw_rows(make, spark, tmp_path):
    make(*[(d, c, None, d, None, "L") for d in range(1, 20) for c in "AB"]).write.parquet(str(tmp_path / "cases"))
    out = op.latest_nonnull(spark.read.parquet(str(tmp_path / "cases")))
    out.collect()
    text = plan(out)
    raw = next(line for line in text.splitlines() if "FileScan" in line and "confirmed" in line)
    above = text[: text.index(raw)].splitlines()
    # between the scan and the first sort or shuffle, the last dates have been joined and the other rows left
    below_sort = above[max(i for i, line in enumerate(above) if "Sort" in line) :]
    assert any("BroadcastHashJoin" in line for line in below_sort) and "Window [" not in text


def test_latest_without_dates_or_values(spark):
    data = [(None, "A", "x", 5, None, None, "L"), (None, "A", "y", 4, None, None, "L"), (day(2), "B", None, None, None, None, None),
            (None, "B", None, 3, None, None, "L"), (None, None, None, 7, 1.0, None, "L"), (day(3), None, None, None, 2.0, None, "L"),
            (None, "C", None, None, None, None, None)]
    df = spark.createDataFrame(data, CANON)
    assert ordered(rows(op.latest_nonnull(df, columns=("date", "state", "confirmed", "deaths")))) == ordered(
        [("A", None, "y", 4, None), ("B", day(2), None, 3, None), (None, day(3), None, 7, 2.0), ("C", None, None, None, None)])


def test_sums_of_nothing_are_zero(make):
    df = make((1, "A", None, None, None, "L"))
    assert rows(op.cumulative_by_date(df)) == [(day(1), 0, 0.0)]
    assert rows(op.world_daily_cases_deaths(op.daily_new(df))) == [(day(1), 0, 0.0)]
    latest = op.latest_by_year(df)
    assert rows(op.yearly_cumulative(latest)) == [(2021, 0, 0.0)]
    assert rows(op.global_totals(op.latest_nonnull(df))) == [(0, 0, "2021-01-01", "0", "0")]


def test_years_are_taken_apart_and_add_up(make):
    df = make((1, "A", None, 5, 1, "L"), (400, "A", None, 9, None, "L"), (401, "B", None, 1, 2, "L"))
    latest = op.latest_by_year(df)
    assert ordered(rows(latest, "country", "year", "confirmed", "deaths")) == ordered([("A", 2021, 5, 1.0), ("A", 2022, 9, None), ("B", 2022, 1, 2.0)])
    assert ordered(rows(op.yearly_cumulative(latest))) == [(2021, 5, 1.0), (2022, 10, 2.0)]


def test_global_totals_show_thousands(make):
    df = make((1, "A", None, 1234567, 1, "L"), (3, "B", None, 1, 999.7, "L"))
    assert rows(op.global_totals(op.latest_nonnull(df))) == [(1234568, 1000, "2021-01-03", "1,234,568", "1,000")]


def test_world_from_country_days_is_the_world_from_rows(make):
    df = op.daily_new(make(*[(d, c, None, d * d % 11, d, "L") for d in range(1, 9) for c in "ABC"]))
    direct = ordered(rows(op.world_daily(df)))
    assert ordered(rows(op.world_daily(op.country_daily(df), value="daily_new"))) == direct


def test_top_k(make):
    df = op.cumulative_max(make((1, "C", None, 5, 1, "L"), (1, "B", None, 5, 1, "L"), (1, "A", None, None, 1, "L"), (1, "D", None, 9, 1, "L")))
    top = op.top_k(df, 3)
    assert [c for (c,) in rows(top, "country")] == ["D", "B", "C"]
    assert "TakeOrderedAndProject" in plan(top)
    assert [c for (c,) in rows(op.top_k(df, 9), "country")] == ["D", "B", "C", "A"]


@pytest.mark.parametrize("sort", [True, False])
def test_a_sort_before_the_maximum_costs_nothing(make, sort):
    df = make((1, "A", None, 5, 1, "L"))
    text = plan(op.cumulative_max(df.orderBy("date") if sort else df))
    assert "rangepartitioning" not in text
