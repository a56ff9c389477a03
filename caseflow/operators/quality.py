"""Data-quality profile: counts, missing values, types, distinct names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: nulls per column and ``total_rows``, from a single pass."""
    names = list(columns or df.columns)
    return df.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in names],
        F.count(F.lit(1)).alias("total_rows"),
    )


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, missing): the summary turned on its side."""
    names = list(columns or df.columns)
    return _listed(missing_summary(df, names), names, F.col, "column_name", "missing")


def missing_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, missing_pct): percentage of nulls, two decimals; null for an empty table."""
    names = list(columns or df.columns)

    def percentage(c: str) -> Column:
        return F.round(F.try_divide(100 * F.col(c), F.col("total_rows")), 2)

    return _listed(missing_summary(df, names), names, percentage, "column_name", "missing_pct")


def schema_profile(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, non_null) of every column."""
    types = dict(df.dtypes)
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    cells = [
        part
        for i, c in enumerate(df.columns, 1)
        for part in (F.lit(i), F.lit(c), F.lit(types[c]), F.col(c))
    ]
    return counts.select(
        F.stack(F.lit(len(df.columns)), *cells).alias("position", "column_name", "data_type", "non_null")
    )


def unique_values(df: DataFrame, column: str, *, keep_null: bool = True) -> DataFrame:
    """The distinct values of a column in order, null first or left out."""
    values = df.select(column)
    if not keep_null:
        values = values.where(F.col(column).isNotNull())
    return values.distinct().orderBy(F.col(column).asc_nulls_first())


def unique_counts(df: DataFrame, columns: Sequence[str] = ("country", "state")) -> DataFrame:
    """One row: the number of distinct non-null values per column, as ``n_<column>``."""
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def _listed(one_row: DataFrame, names: Sequence[str], cell, *aliases: str) -> DataFrame:
    cells = [part for c in names for part in (F.lit(c), cell(c))]
    return one_row.select(F.stack(F.lit(len(names)), *cells).alias(*aliases))
