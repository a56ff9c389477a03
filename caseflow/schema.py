"""The canonical case table and the column names every operator defaults to."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from caseflow.functions.scalars import cast_sql, quoted

CANON = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("country", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("confirmed", T.LongType()),
        T.StructField("deaths", T.DoubleType()),
        T.StructField("recovered", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)
CANON_NAMES = CANON.fieldNames()

# One row is one observation of a place on a day by one feed.
PLACE = ("country", "state")

ENRICHED = T.StructType(
    CANON.fields
    + [
        T.StructField("prev_confirmed", T.LongType()),
        T.StructField("prev_deaths", T.DoubleType()),
        T.StructField("daily_new_cases", T.LongType()),
        T.StructField("daily_new_deaths", T.DoubleType()),
    ]
)


def all_strings(schema: T.StructType) -> T.StructType:
    """The same columns, every one of them text."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def enforce(df: DataFrame, schema: T.StructType = CANON) -> DataFrame:
    """Project to ``schema``: right order, right types, absent columns as typed nulls.

    Columns outside the schema (a store's own id, further indicators) are dropped,
    so the scan below only reads what the schema names.
    """
    found = {f.name: f.dataType for f in df.schema}
    return df.selectExpr(
        *[
            f"{cast_sql(f.name, found[f.name], f.dataType)} AS {quoted(f.name)}"
            if f.name in found
            else f"CAST(NULL AS {f.dataType.simpleString()}) AS {quoted(f.name)}"
            for f in schema
        ]
    )
