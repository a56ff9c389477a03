"""Bring differently shaped feeds to the canonical table and append them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from caseflow.functions.scalars import cast_sql, literal, parse_date, quoted, tie_break
from caseflow.schema import CANON, CANON_NAMES, enforce

# Fixed values of the wide feed's layout.
WIDE_IDS = ("Province/State", "Country/Region", "Lat", "Long")
WIDE_DATE_PATTERN = "M/d/yy"


def value_columns(df: DataFrame, ids: Sequence[str] = WIDE_IDS) -> list[str]:
    """The columns that hold values: all but the ids. The wide feed gains one a day."""
    return [c for c in df.columns if c not in ids]


def wide_to_long(
    df: DataFrame,
    *,
    ids: Sequence[str] = WIDE_IDS,
    name: str = "date",
    value: str = "confirmed",
    value_type: T.DataType = CANON["confirmed"].dataType,
) -> DataFrame:
    """One row per id and value column, null cells kept.

    A map-side ``stack``: no shuffle, and for a thousand columns several times
    faster than ``unpivot``. Without value columns there are no rows. Values are cast to one type first because ``stack``
    takes only one; text that is no number becomes null.
    """
    found = {f.name: f.dataType for f in df.schema}
    if not value_columns(df, ids):
        none = {name: F.lit(None).cast("string"), value: F.lit(None).cast(value_type)}
        return df.where(F.lit(False)).select(*[quoted(c) for c in ids], *[column.alias(c) for c, column in none.items()])
    cells = [f"{literal(c)}, {cast_sql(c, found[c], value_type)}" for c in value_columns(df, ids)]
    stacked = f"stack({len(cells)}, {', '.join(cells)}) AS ({quoted(name)}, {quoted(value)})"
    return df.selectExpr(*[quoted(c) for c in ids], stacked)


def standardise(
    df: DataFrame,
    *,
    renames: Mapping[str, str],
    constants: Mapping[str, str],
    date: Column | None = None,
) -> DataFrame:
    """Rename, add constants, parse the date, and project to the canonical columns."""
    named = df.withColumnsRenamed(dict(renames)).withColumns({k: F.lit(v) for k, v in constants.items()})
    day = parse_date(F.col("date").cast("string")) if date is None else date
    return enforce(named.withColumn("date", day), CANON)


def std_wide(df: DataFrame, *, source: str, date_pattern: str = WIDE_DATE_PATTERN) -> DataFrame:
    """The wide feed: confirmed only, by country and state."""
    return standardise(
        wide_to_long(df),
        renames={"Country/Region": "country", "Province/State": "state"},
        constants={"source": source},
        date=parse_date(F.col("date"), date_pattern),
    )


def std_wide_measures(
    *, confirmed: DataFrame, deaths: DataFrame | None = None, recovered: DataFrame | None = None, source: str, date_pattern: str = WIDE_DATE_PATTERN
) -> DataFrame:
    """Up to three wide files of one layout, one per measure, as one canonical table.

    A full outer join on place and date, done by appending and grouping, so that null
    states match. Dates are parsed first: ``01/22/20`` meets ``1/22/20``. Where a file
    repeats a place and date, its rows are numbered by value, null last, and the first
    meets the other files' first: no row is lost. One shuffle, by place and date.
    """
    given = {"confirmed": confirmed, "deaths": deaths, "recovered": recovered}
    files = {name: df for name, df in given.items() if df is not None}
    ids = ["Province/State", "Country/Region", "date"]
    parts = [
        wide_to_long(df, value=name, value_type=CANON[name].dataType)
        .select(*ids, name, F.lit(name).alias("_file"))
        .withColumn("date", parse_date(F.col("date"), date_pattern))
        for name, df in files.items()
    ]
    numbered = Window.partitionBy(*ids, "_file").orderBy(F.coalesce(*[F.col(f).cast("double") for f in files]).asc_nulls_last())
    cells = combine(*parts).repartition(*ids).withColumn("_n", F.row_number().over(numbered))
    return standardise(
        cells.groupBy(*ids, "_n").agg(*[F.max(name).alias(name) for name in files]),
        renames={"Country/Region": "country", "Province/State": "state"},
        constants={"source": source},
        date=F.col("date"),
    )


def std_long(df: DataFrame, *, source: str) -> DataFrame:
    """The long multi-indicator feed: four of its columns are used, none has a state."""
    return standardise(
        df.select("date", "location", "total_cases", "total_deaths"),
        renames={"location": "country", "total_cases": "confirmed", "total_deaths": "deaths"},
        constants={"source": source},
    )


def std_single(df: DataFrame, *, country: str, source: str) -> DataFrame:
    """The long feed of one country, which the caller names."""
    return standardise(
        df.select("date", "cases", "deaths"),
        renames={"cases": "confirmed"},
        constants={"country": country, "source": source},
    )


def combine(*feeds: DataFrame) -> DataFrame:
    """Append by column name; duplicates stay, missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def sort_cases(df: DataFrame, *, nulls: str = "first") -> DataFrame:
    """By country, state and date, then by the rest so that the order is total.

    The further columns also let the range shuffle cut inside a country that holds
    much of the data, and the place a row was read from, as the last of them, lets it
    cut inside the copies of one row.
    """
    rest = [c for c in CANON_NAMES if c not in ("country", "state", "date")]
    names = ["country", "state", "date", "source", *[c for c in rest if c != "source"]]
    order = [F.col(c).asc_nulls_last() for c in names] if nulls == "last" else tie_break(*names)
    return df.withColumn("_read", F.monotonically_increasing_id()).orderBy(*order, "_read").drop("_read")


def preview(df: DataFrame, rows: int = 20, *, nulls: str = "first") -> DataFrame:
    """The first rows in that order: a distributed top-k, not a full sort."""
    return sort_cases(df, nulls=nulls).limit(rows)
