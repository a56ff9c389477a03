from __future__ import annotations

import pytest

from caseflow import operators as op

from conftest import plan, rows


@pytest.fixture(scope="module")
def df(make):
    return make((1, "B", None, 1, None, "L"), (2, "A", "x", None, None, "W"), (2, "A", "w", 4, 0, "W"))


def test_summary_is_one_row_from_one_aggregate(df):
    out = op.missing_summary(df)
    assert [r.asDict() for r in out.collect()] == [
        dict(date=0, country=0, state=1, confirmed=1, deaths=2, recovered=3, source=0, total_rows=3)]
    assert plan(out).count("Scan") == 1


def test_counts_add_up(df):
    listed = dict(rows(op.missing_by_column(df)))
    profile = {c: n for _, c, _, n in rows(op.schema_profile(df))}
    assert all(listed[c] + profile[c] == 3 for c in df.columns)


def test_ratio_has_two_decimals(df):
    assert dict(rows(op.missing_ratio(df, ["state", "deaths", "date"]))) == {"state": 33.33, "deaths": 66.67, "date": 0.0}


def test_ratio_of_an_empty_table_is_unknown(df):
    assert rows(op.missing_ratio(df.limit(0), ["state"])) == [("state", None)]


def test_schema_profile(df):
    assert rows(op.schema_profile(df))[:4] == [
        (1, "date", "date", 3), (2, "country", "string", 3), (3, "state", "string", 2), (4, "confirmed", "bigint", 2)]


def test_unique_values(df):
    assert rows(op.unique_values(df, "state")) == [(None,), ("w",), ("x",)]
    assert rows(op.unique_values(df, "state", keep_null=False)) == [("w",), ("x",)]
    assert rows(op.unique_values(df, "country")) == [("A",), ("B",)]
    assert rows(op.unique_counts(df)) == [(2, 2)]
