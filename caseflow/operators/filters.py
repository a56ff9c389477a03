"""Row filters and semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def valid_countries(df: DataFrame, names: DataFrame, *, column: str = "country", name: str = "name") -> DataFrame:
    """Keep rows whose country is in the caller's table of names, exact match.

    No broadcast is forced: Spark broadcasts the names while they are below its size
    threshold, and otherwise joins by shuffle with skewed partitions split.
    """
    return df.join(names.select(F.col(name).alias(column)), column, "left_semi")


def exclude_names(df: DataFrame, names: DataFrame, *, column: str = "country", name: str = "name") -> DataFrame:
    """Drop rows whose country is in ``names`` (continents, income groups)."""
    return df.join(names.select(F.col(name).alias(column)), column, "left_anti")


def positive(df: DataFrame, column: str = "confirmed") -> DataFrame:
    return df.where(F.col(column) > 0)


def non_negative(df: DataFrame, column: str = "daily_new_cases") -> DataFrame:
    return df.where(F.col(column) >= 0)


def one_country(df: DataFrame, country: str) -> DataFrame:
    """Applied to a stored table this reaches the scan; above a per-country window it passes below it."""
    return df.where(F.col("country") == country)


def reported(df: DataFrame, names: DataFrame) -> DataFrame:
    """The dashboard's base filter: a valid country with a positive total."""
    return valid_countries(positive(df), names)


def active_countries(daily: DataFrame, *, value: str = "daily_new") -> DataFrame:
    """Countries whose increments sum to more than 0."""
    return daily.groupBy("country").agg(F.sum(value).alias("total")).where("total > 0").select("country")


def keep_active(daily: DataFrame, *, value: str = "daily_new") -> DataFrame:
    """Rows of active countries, from ``country_daily`` output.

    The same as a semi-join with :func:`active_countries`, but the input is computed
    once. One row per country and day keeps each window small.
    """
    total = F.sum(value).over(Window.partitionBy("country"))
    return daily.withColumn("_total", total).where((F.col("_total") > 0) & F.col("country").isNotNull()).drop("_total")


def countries_with_data(df: DataFrame, *, value: str = "daily_new_cases") -> DataFrame:
    """Countries with at least one increment above 0, in order."""
    return df.where(F.col(value) > 0).select("country").distinct().orderBy(F.col("country").asc_nulls_first())
