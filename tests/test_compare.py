from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from caseflow import operators as op, sources as src

from conftest import day, ordered, plan, rows


def test_correlation_is_over_days_not_rows(make):
    left = make(*[(d, "A", s, d * d, None, "W") for d in range(1, 6) for s in ("x", "y")], (1, "B", None, 1, None, "W"))
    right = make(*[(d, "A", None, 10 * d, None, "L") for d in range(2, 9)], (1, "B", None, 1, None, "L"), (1, "C", None, 1, None, "L"))
    out = {c: (n, r) for c, n, r in rows(op.correlate(left, right, left_value="confirmed", right_value="confirmed"))}
    expected = np.corrcoef([2 * d * d for d in range(2, 6)], [10 * d for d in range(2, 6)])[0, 1]
    assert out == {"A": (4, pytest.approx(expected)), "B": (1, None)}


def test_growth_before_and_after(spark, make):
    growth = op.growth_rate(make(*[(d, "A", None, t, None, "L") for d, t in ((1, 10), (2, 20), (3, 30), (4, 60))], (1, "B", None, 1, None, "L")))
    events = spark.createDataFrame([("A", day(3)), ("B", day(1))], "country string, event_date date")
    out = rows(op.growth_around(growth, events), "country", "growth_before", "growth_after")
    assert ordered(out) == ordered([("A", 0.5, 0.75), ("B", None, 0.0)])


def test_copies_and_conflicts_leave_one_row(make):
    df = make(*[(1, "A", None, 5, 1, "L")] * 4, (1, "A", None, 9, None, "K"), (2, "A", None, 6, 1, "L"), (1, "A", "x", 1, 1, "L"))
    out = op.one_per_key(df)
    assert out.columns == df.columns
    assert ordered(rows(out, "date", "state", "confirmed", "source")) == ordered([(day(1), None, 5, "L"), (day(2), None, 6, "L"), (day(1), "x", 1, "L")])
    assert "partial_max" in plan(op.one_per_key(df)) and "Window" not in plan(op.one_per_key(df))


def test_regional_and_national_totals(make):
    df = make((1, "A", "x", 3, None, "W"), (1, "A", "y", 4, None, "W"), (1, "A", None, 10, None, "L"), (1, "A", None, 99, None, "S"),
              (2, "A", "x", 5, None, "W"), (3, "A", None, 6, None, "L"), (4, "A", "x", None, None, "W"))
    out = op.subnational_gap(df, national_source="L")
    assert ordered(rows(out)) == ordered([("A", day(1), 7, 10, -3), ("A", day(2), 5, None, None), ("A", day(3), None, 6, None)])
    assert "Join" not in plan(out)


def test_three_wide_files_meet_on_place_and_date(spark):
    def wide(*cells):
        return spark.createDataFrame(cells, "`Province/State` string, `Country/Region` string, Lat double, Long double, `1/1/21` int, `1/2/21` int")

    out = src.std_wide_measures(
        confirmed=wide((None, "A", 1.0, 1.0, 5, 6), ("x", "B", 1.0, 1.0, 1, None)),
        deaths=wide((None, "A", 1.0, 9.0, 0, 1)),
        recovered=wide((None, "C", 1.0, 1.0, 2, 3)),
        source="W",
    )
    a, b = dt.date(2021, 1, 1), dt.date(2021, 1, 2)
    assert ordered(rows(out)) == ordered([
        (a, "A", None, 5, 0.0, None, "W"), (b, "A", None, 6, 1.0, None, "W"),
        (a, "B", "x", 1, None, None, "W"), (b, "B", "x", None, None, None, "W"),
        (a, "C", None, None, None, 2.0, "W"), (b, "C", None, None, None, 3.0, "W")])
