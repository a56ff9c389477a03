"""Small column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def at_least_zero(value: Column) -> Column:
    """Clip below at 0; a null stays null (``greatest`` alone would turn it into 0)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0)))


def parse_date(text: Column, pattern: str | None = None) -> Column:
    """Text to date. Unreadable text gives null instead of failing the job under ANSI mode."""
    return F.try_to_date(text, pattern) if pattern else F.try_to_date(text)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cast_sql(name: str, found: T.DataType, wanted: T.DataType) -> str:
    """The cast of a column, as SQL: a table of a thousand columns is one parse, not
    thousands of calls. What does not fit gives null: unreadable text, numbers out of
    range, and for whole numbers any fraction (``5.0`` is 5, ``5.7`` is not cut to 5),
    NaN and infinity.
    """
    column, target = quoted(name), wanted.simpleString()
    if found == wanted:
        return column
    if isinstance(found, T.FractionalType) and isinstance(wanted, T.IntegralType):
        return f"CASE WHEN {column} % 1 = 0 THEN try_cast({column} AS {target}) END"
    if not isinstance(found, T.StringType):
        cast = "try_cast" if isinstance(wanted, T.IntegralType) else "CAST"
        return f"{cast}({column} AS {target})"
    if isinstance(wanted, T.IntegralType):
        exact = f"try_cast({column} AS decimal(38,18))"  # digits a double would lose
        return f"coalesce(try_cast({column} AS {target}), CASE WHEN {exact} % 1 = 0 THEN try_cast({exact} AS {target}) END)"
    return f"try_cast({column} AS {target})"


def with_thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def tie_break(*names: str) -> list[Column]:
    """Ascending order over ``names`` with the null placement spelled out."""
    return [F.col(n).asc_nulls_first() for n in names]
