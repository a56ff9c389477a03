"""Totals per day, country and year. Sums and maxima combine before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caseflow.functions.scalars import or_zero, with_thousands
from caseflow.sources.scratch import stage


def _sum_or_zero(column: str) -> Column:
    """A group without any value sums to 0, not null."""
    return or_zero(F.sum(column)).alias(column)


# -- increments ---------------------------------------------------------------

def country_daily(df: DataFrame, *, value: str = "daily_new_cases", out: str = "daily_new") -> DataFrame:
    return df.groupBy("country", "date").agg(F.sum(value).alias(out))


def world_daily(df: DataFrame, *, value: str = "daily_new_cases", out: str = "daily_new") -> DataFrame:
    """Also takes ``country_daily`` output (``value="daily_new"``): sums of sums are the same."""
    return df.groupBy("date").agg(F.sum(value).alias(out))


def world_daily_cases_deaths(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(_sum_or_zero("daily_new_cases"), _sum_or_zero("daily_new_deaths"))


# -- cumulative values ----------------------------------------------------------

def cumulative_max(df: DataFrame) -> DataFrame:
    """The largest total per country: right for series that never fall."""
    return df.groupBy("country").agg(
        F.max("confirmed").alias("cum_confirmed"), F.max("deaths").alias("cum_deaths")
    )


def cumulative_by_date(
    df: DataFrame, *, keys: Sequence[str] = (), values: Sequence[str] = ("confirmed", "deaths")
) -> DataFrame:
    """Sum of the totals per date, over the world or per ``keys``."""
    return df.groupBy(*keys, "date").agg(*[_sum_or_zero(v) for v in values])


def latest_nonnull(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("country",),
    columns: Sequence[str] = ("date", "state", "confirmed", "deaths", "recovered", "source"),
) -> DataFrame:
    """Each column's last non-null value per key; one row may so mix dates.

    "Last" is by date, state (null before any), source and the value itself. First the
    last date of every key and column is found, by a hash aggregate over dates alone, in
    a job of its own. Joined back, it leaves the rows of those dates; the maximum over
    (order, value), which has to sort what it groups, sees only these.
    """
    day = {c: f"_day_{n}" for n, c in enumerate(columns)}
    last_days = stage(df.groupBy(*keys).agg(*[F.max(F.when(F.col(c).isNotNull(), F.col("date"))).alias(d) for c, d in day.items()]))
    last_days = last_days.withColumnsRenamed({k: f"_key_{n}" for n, k in enumerate(keys)})
    same_key = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{n}")) for n, k in enumerate(keys)])
    on_last_day = reduce(Column.__or__, [F.col(c).isNotNull() & F.col("date").eqNullSafe(F.col(d)) for c, d in day.items()])
    rows = df.join(last_days, same_key).where(on_last_day)

    def last(name: str) -> Column:
        candidate = F.struct(
            F.col("date").alias("d"),
            F.coalesce("state", F.lit("")).alias("st"),
            F.col("source").alias("so"),
            F.col(name).alias("value"),
        )
        return F.max(F.when(F.col(name).isNotNull(), candidate))["value"].alias(name)

    # a key without any value in the columns still has its row
    found = rows.groupBy(*keys).agg(*[last(c) for c in columns]).withColumnsRenamed({k: f"_found_{n}" for n, k in enumerate(keys)})
    same = reduce(Column.__and__, [F.col(f"_key_{n}").eqNullSafe(F.col(f"_found_{n}")) for n in range(len(keys))])
    named = [F.col(f"_key_{n}").alias(k) for n, k in enumerate(keys)]
    return last_days.join(found, same, "left").select(*named, *columns)


def latest_by_year(df: DataFrame, **options) -> DataFrame:
    """The last non-null values per country and year."""
    return latest_nonnull(df.withColumn("year", F.year("date")), keys=("country", "year"), **options)


def yearly_cumulative(latest: DataFrame) -> DataFrame:
    """World totals per year, from ``latest_by_year``."""
    return latest.groupBy("year").agg(_sum_or_zero("confirmed"), _sum_or_zero("deaths"))


def global_totals(latest: DataFrame) -> DataFrame:
    """One row from ``latest_nonnull``: totals, their display text, and the last date as text."""
    totals = latest.agg(
        or_zero(F.sum("confirmed")).cast("bigint").alias("total_confirmed"),
        or_zero(F.sum("deaths")).cast("bigint").alias("total_deaths"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("latest_date"),
    )
    return totals.withColumns(
        {
            "total_confirmed_text": with_thousands(F.col("total_confirmed")),
            "total_deaths_text": with_thousands(F.col("total_deaths")),
        }
    )


def top_k(
    df: DataFrame, k: int = 20, *, by: str = "cum_confirmed", tie: Sequence[str] = ("country",)
) -> DataFrame:
    """The ``k`` largest rows, nulls last, ties in name order."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in tie]).limit(k)
