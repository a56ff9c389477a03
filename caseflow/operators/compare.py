"""Comparisons between feeds, and around an event day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from caseflow.schema import PLACE


def correlate(
    left: DataFrame,
    right: DataFrame,
    *,
    left_value: str,
    right_value: str,
    on: Sequence[str] = ("country", "date"),
    by: str = "country",
) -> DataFrame:
    """(by, n_days, correlation) of two measures that share place and date.

    Each side is first summed to one row per ``on``, so the join is one to one
    whatever the number of rows behind a day. Null where a measure never changes.
    """
    a = left.groupBy(*on).agg(F.sum(left_value).cast("double").alias("_a"))
    b = right.groupBy(*on).agg(F.sum(right_value).cast("double").alias("_b"))
    both = a.join(b, list(on)).where("_a IS NOT NULL AND _b IS NOT NULL")
    # corr() itself divides by zero under ANSI mode where a measure never changes
    spread = F.stddev_pop("_a") * F.stddev_pop("_b")
    return both.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_days"), F.try_divide(F.covar_pop("_a", "_b"), spread).alias("correlation")
    )


def growth_around(growth: DataFrame, events: DataFrame, *, rate: str = "growth_rate") -> DataFrame:
    """Mean growth before and from the event day on, per (country, event_date) of ``events``.

    Growth is summed per country and day before the join, which so sees at most the
    calendar per country. An event of a country without rows has null means.
    """
    before = F.col("date") < F.col("event_date")
    daily = growth.groupBy("country", "date").agg(F.sum(rate).alias("_sum"), F.count(rate).alias("_n"))

    def mean(when):
        return F.try_divide(F.sum(F.when(when, F.col("_sum"))), F.sum(F.when(when, F.col("_n"))))

    return (
        events.join(daily, "country", "left")
        .groupBy("country", "event_date")
        .agg(mean(before).alias("growth_before"), mean(~before).alias("growth_after"))
    )


def one_per_key(
    df: DataFrame, *, keys: Sequence[str] = (*PLACE, "date"), prefer: Sequence[str] = ("source",)
) -> DataFrame:
    """One row per key where rows repeat or conflict: the largest by ``prefer``, then by the rest.

    A maximum over whole rows instead of a ranking window: copies shrink to one
    before the shuffle, however many there are.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*prefer, *[c for c in rest if c not in prefer])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"_best.{c}") for c in df.columns])


def subnational_gap(df: DataFrame, *, value: str = "confirmed", national_source: str | None = None) -> DataFrame:
    """Per country and date: the states' sum, the national total, and the difference.

    A day only one side has is kept. Both sides come from one grouping, not a join.
    ``national_source`` picks the feed where several report the nation.
    """
    national = F.col("state").isNull()
    if national_source is not None:
        national &= F.col("source") == national_source
    return (
        df.groupBy("country", "date")
        .agg(
            F.sum(F.when(F.col("state").isNotNull(), F.col(value))).alias("regional"),
            F.sum(F.when(national, F.col(value))).alias("national"),
        )
        .where("regional IS NOT NULL OR national IS NOT NULL")
        .withColumn("gap", F.col("regional") - F.col("national"))
    )
