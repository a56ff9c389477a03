from __future__ import annotations

import pytest

from caseflow import operators as op

from conftest import day, ordered, plan, rows


@pytest.fixture(scope="module")
def aliases(make):
    return make((1, "US", None, 5, None, "W"), (1, "United States", None, 6, None, "L"), (1, "World", None, 99, None, "L"), (1, None, None, 1, None, "L"), (2, "US", None, 0, None, "W"), (3, "US", None, None, None, "W"))


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("US",), ("US",), ("Peru",)], "name string")


@pytest.fixture(scope="module")
def inactive(make):
    return op.country_daily(op.daily_new(make(
        (1, "flat", None, 5, None, "L"), (2, "flat", None, 5, None, "L"),
        (1, "mixed", None, 5, None, "L"), (2, "mixed", None, 9, None, "L"), (3, "mixed", None, 1, None, "L")), clip=False))


def test_valid_names_match_exactly_and_do_not_multiply(aliases, names):
    assert ordered(rows(op.valid_countries(aliases, names), "country", "date")) == [("US", day(1)), ("US", day(2)), ("US", day(3))]
    assert rows(op.reported(aliases, names), "country", "confirmed") == [("US", 5)]


def test_excluded_names(aliases, spark):
    groups = spark.createDataFrame([("World",)], "name string")
    assert ordered(set(rows(op.exclude_names(aliases, groups), "country"))) == ordered([("US",), ("United States",), (None,)])


def test_names_are_broadcast_only_below_the_size_threshold(spark, aliases, names):
    small = plan(op.valid_countries(aliases, names))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = op.valid_countries(aliases, names)
        assert "SortMergeJoin" in plan(large) and large.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftSemi" in small


def test_sum_above_zero_and_any_above_zero_are_different_tests(inactive):
    assert rows(op.active_countries(inactive)) == []
    assert rows(op.countries_with_data(inactive, value="daily_new")) == [("mixed",)]


def test_keep_active_is_the_semi_join_with_the_active_names(make):
    daily = op.country_daily(op.daily_new(make(
        (1, "A", None, 5, None, "L"), (2, "A", None, 9, None, "L"), (1, "B", None, 5, None, "L"), (2, "B", None, 4, None, "L"),
        (1, None, None, 1, None, "L"), (2, None, None, 3, None, "L"))))
    semi = daily.join(op.active_countries(daily), "country", "left_semi")
    assert ordered(rows(op.keep_active(daily))) == ordered(rows(semi, *daily.columns)) == ordered([("A", day(1), 0), ("A", day(2), 4)])


def test_simple_filters(aliases):
    assert op.positive(aliases).count() == 4
    assert op.non_negative(aliases, "confirmed").count() == 5
    assert op.one_country(aliases, "US").count() == 3
