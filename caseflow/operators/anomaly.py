"""Rolling means, anomaly flags, growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from caseflow.functions.scalars import at_least_zero, tie_break
from caseflow.functions.windows import ROLLING_ROWS, previous_values, trailing_mean
from caseflow.operators.aggregate import cumulative_by_date, world_daily

ANOMALY_FACTOR = 1.5


def flag_anomalies(
    df: DataFrame,
    *,
    value: str = "daily_new",
    keys: Sequence[str] = (),
    rows: int = ROLLING_ROWS,
    factor: float = ANOMALY_FACTOR,
) -> DataFrame:
    """Add ``roll_mean`` and ``anomaly``: the value exceeds ``factor`` trailing means.

    Takes one row per date (and key). The window counts rows, so missing dates
    stretch it. An unknown comparison is no anomaly.
    """
    rolled = df.withColumn("roll_mean", trailing_mean(value, keys=keys, order_by=tie_break("date"), rows=rows))
    return rolled.withColumn("anomaly", F.coalesce(F.col(value) > F.col("roll_mean") * factor, F.lit(False)))


def world_daily_anomaly(increments: DataFrame, *, value: str = "daily_new_cases") -> DataFrame:
    """Anomalies of the world's summed increments."""
    return flag_anomalies(world_daily(increments, value=value))


def cumulative_anomaly(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Anomalies of the increments of the summed totals, for the world or per ``keys``.

    Not the same as summing increments: a feed that skips a day makes the summed
    total fall and rise again. The first date has no increment. Windows run over the
    daily sums, so a key has at most one row per calendar day.
    """
    daily = cumulative_by_date(df, keys=keys, values=("confirmed",))
    by_date = Window.partitionBy(*keys).orderBy(*tie_break("date"))
    steps = daily.withColumn("prev", F.lag("confirmed").over(by_date)).withColumn(
        "daily_new", at_least_zero(F.col("confirmed") - F.col("prev"))
    )
    return flag_anomalies(steps, keys=keys)


def world_cum_anomaly(df: DataFrame) -> DataFrame:
    return cumulative_anomaly(df)


def country_anomaly(df: DataFrame) -> DataFrame:
    """All countries at once."""
    return cumulative_anomaly(df.where(F.col("country").isNotNull()), keys=("country",))


def anomaly_points(flagged: DataFrame) -> DataFrame:
    return flagged.where("anomaly")


def growth_rate(df: DataFrame, *, value: str = "confirmed", per_source: bool = False, **split) -> DataFrame:
    """Add ``growth_rate`` (value over the country's previous row, less 1) and ``growth_pct``.

    States and feeds of a country follow each other by date, state and source unless
    ``per_source``. The first row grows by 0. ``split`` goes to :func:`previous_values`.
    """
    keys = ["country", "source"] if per_source else ["country"]
    lagged = previous_values(
        df.withColumn("_state", F.coalesce("state", F.lit(""))),
        {"_prev": value},
        keys=keys,
        order_by=["date", "_state", "source", value],
        **split,
    )
    rate = F.coalesce(F.try_divide(F.col(value).cast("double"), F.col("_prev")) - 1, F.lit(0.0))
    return (
        lagged.withColumn("growth_rate", rate)
        .withColumn("growth_pct", F.col("growth_rate") * 100)
        .drop("_prev", "_state")
    )
