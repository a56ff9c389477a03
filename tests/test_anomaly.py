from __future__ import annotations

import pytest

from caseflow import operators as op

from conftest import day, plan, rows


def test_mean_covers_rows_not_days(make):
    days = [1, 2, 3, 4, 6, 7, 8, 9, 10]
    totals = [0, 1, 3, 6, 10, 15, 21, 28, 98]
    df = make(*[(d, "A", None, t, None, "L") for d, t in zip(days, totals)])
    out = rows(op.world_daily_anomaly(op.daily_new(df)).orderBy("date"))
    new = [0, 1, 2, 3, 4, 5, 6, 7, 70]
    means = [sum(new[max(0, i - 6): i + 1]) / len(new[max(0, i - 6): i + 1]) for i in range(9)]
    assert out == [(day(d), n, pytest.approx(m), n > 1.5 * m) for d, n, m in zip(days, new, means)]
    assert [r[3] for r in out][-1]


def test_the_two_world_anomalies_differ_when_a_feed_skips_a_day(make):
    df = make(*[(d, "A", None, 100, None, "L") for d in (1, 2, 3)], (1, "B", None, 50, None, "L"), (3, "B", None, 50, None, "L"))
    summed = rows(op.world_daily_anomaly(op.daily_new(df)).orderBy("date"), "daily_new", "anomaly")
    assert summed == [(0, False)] * 3
    from_total = rows(op.world_cum_anomaly(df).orderBy("date"), "confirmed", "prev", "daily_new", "roll_mean", "anomaly")
    assert from_total == [(150, None, None, None, False), (100, 150, 0, 0.0, False), (150, 100, 50, 25.0, True)]
    assert rows(op.anomaly_points(op.world_cum_anomaly(df)), "date") == [(day(3),)]


def test_each_country_by_itself(make):
    df = make(*[(d, c, s, d * k, None, "L") for d in (1, 2, 3) for c, k in (("A", 1), ("B", 10)) for s in ("x", "y")], (1, None, None, 1, None, "L"))
    out = rows(op.country_anomaly(df).orderBy("country", "date"), "country", "confirmed", "daily_new", "roll_mean")
    assert out == [("A", 2, None, None), ("A", 4, 2, 2.0), ("A", 6, 2, 2.0), ("B", 20, None, None), ("B", 40, 20, 20.0), ("B", 60, 20, 20.0)]


def test_window_without_keys_sees_one_row_per_date(make):
    text = plan(op.world_daily_anomaly(op.daily_new(make((1, "A", None, 1, 1, "L")))))
    assert text.count("Exchange SinglePartition") == 1 and "rangepartitioning" not in text
    single = next(i for i, line in enumerate(text.splitlines()) if "SinglePartition" in line)
    assert "HashAggregate(keys=[date" in text.splitlines()[single + 1]


def test_growth_by_date_state_and_source(make):
    df = make((1, "A", "x", 20, None, "W"), (1, "A", None, 10, None, "L"), (2, "A", None, 30, None, "L"), (2, "B", None, 5, None, "L"), (3, "B", None, 0, None, "L"), (4, "B", None, 5, None, "L"))
    out = rows(op.growth_rate(df).orderBy("country", "date", "state"), "country", "confirmed", "growth_rate", "growth_pct")
    assert out == [("A", 10, 0.0, 0.0), ("A", 20, 1.0, 100.0), ("A", 30, 0.5, 50.0), ("B", 5, 0.0, 0.0), ("B", 0, -1.0, -100.0), ("B", 5, 0.0, 0.0)]
    apart = rows(op.growth_rate(df, per_source=True).where("country = 'A'").orderBy("date", "state"), "growth_rate")
    assert apart == [(0.0,), (0.0,), (2.0,)]
    whole = rows(op.growth_rate(df, pieces=()).orderBy("country", "date", "state"), "country", "confirmed", "growth_rate", "growth_pct")
    assert whole == out
