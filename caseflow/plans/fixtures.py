"""Case-count feeds derived from the test tables: cumulative orders per nation.

The heavy part, orders joined with customers, is read and joined once per query and
counted straight into two grouping sets. What follows runs on the counts, whose
number depends on nations, segments and the calendar, not on the number of orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Given schemas spare the footer-reading job before each query.
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

SINGLE_COUNTRY = "NATION_0"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


# Orders per (nation, day) and per (nation, segment, month) come from one pass. Nations
# join customers first, the smaller side. No join is forced: Spark broadcasts below
# its size threshold, else sort-merges and splits the partitions of busy customers.
#
# The WIDE feed has a cell for every month any order was placed in. The months are
# collected over its counts (nations x segments x months) while the LONG rows spread by
# country, and each series' first row adds the months the series lacks. Both windows
# share that partitioning.
_CASES = """
WITH places AS (
  SELECT c_custkey, n_nationkey AS nk, n_name AS country, c_mktsegment AS state
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey),
placed AS (
  SELECT nk, country, state, CAST(o_orderdate AS date) AS day, trunc(o_orderdate, 'month') AS month,
         o_orderstatus = 'P' AS pending, o_orderstatus = 'F' AS filled
  FROM {orders} JOIN places ON o_custkey = c_custkey),
counts AS (
  SELECT nk, country, state, coalesce(month, day) AS date, grouping(month) = 0 AS is_wide,
         CASE WHEN grouping(month) = 1 THEN country END AS spread,
         count(1) AS n, count_if(pending) AS pending, count_if(filled) AS filled
  FROM placed
  GROUP BY GROUPING SETS ((nk, country, day), (country, state, month))),
calendar AS (
  SELECT *, collect_set(CASE WHEN is_wide THEN date END) OVER (PARTITION BY is_wide, spread) AS months
  FROM counts),
series AS (
  SELECT nk, country, state, date, is_wide, pending, months,
         sum(n) OVER up_to_here AS total,
         CAST(nullif(sum(filled) OVER up_to_here, 0) AS double) AS gone,
         row_number() OVER up_to_here = 1 AS opens,
         collect_set(CASE WHEN is_wide THEN date END) OVER (PARTITION BY is_wide, spread, country, state) AS own_months
  FROM calendar
  WINDOW up_to_here AS (PARTITION BY is_wide, spread, country, state ORDER BY date)),
cells AS (
  SELECT country, state, gone, inline(CASE
    WHEN is_wide AND opens THEN concat(
      array(named_struct('date', date, 'confirmed', total, 'source', 'WIDE')),
      transform(array_except(months, own_months),
                month -> named_struct('date', month, 'confirmed', CAST(NULL AS bigint), 'source', 'WIDE')))
    WHEN is_wide THEN array(named_struct('date', date, 'confirmed', total, 'source', 'WIDE'))
    WHEN nk = 0 THEN array(named_struct('date', date, 'confirmed', total - 2 * pending, 'source', 'LONG'),
                           named_struct('date', date, 'confirmed', total - 2 * pending + 1, 'source', 'SINGLE'))
    ELSE array(named_struct('date', date, 'confirmed', total - 2 * pending, 'source', 'LONG'))
  END)
  FROM series)
SELECT date, country, state, confirmed, CASE WHEN source <> 'WIDE' THEN gone END AS deaths,
       CAST(NULL AS double) AS recovered, source
FROM cells
"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical table with three feeds.

    WIDE: per nation, segment and month, with a null where a month has no order.
    LONG: per nation and day, less a correction. SINGLE: nation 0 again, one higher.
    """
    tables = {name: read_table(spark, sf_dir, name) for name in ("orders", "customer", "nation")}
    return spark.sql(_CASES, **tables)


def iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The official names: most of the nations."""
    nation = read_table(spark, sf_dir, "nation")
    return nation.where(F.col("n_nationkey") % 10 != 3).select(F.col("n_name").alias("name"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event day per country: (country, event_date)."""
    nation = read_table(spark, sf_dir, "nation")
    day = F.expr("add_months(DATE'1997-01-01', n_nationkey)")
    return nation.select(F.col("n_name").alias("country"), day.alias("event_date"))


# -- the three feeds in the shape their publishers use ---------------------------

def as_wide_feed(staged: DataFrame, value: str = "confirmed") -> DataFrame:
    """One column per month, named like ``1/1/15`` (dates move 20 years, see below).

    Takes a stored table: the column names are read from it before the pivot, as a
    file's header would be.
    """
    wide = staged.where(F.col("source") == "WIDE")
    months = [r["date"] for r in wide.select("date").distinct().orderBy("date").collect()]
    # two-digit years always read as 20xx, and the test dates start in 1995
    names = [f"{m.month}/{m.day}/{(m.year + 20) % 100:02d}" for m in months]
    label = F.date_format(F.add_months("date", 240), "M/d/yy")
    return (
        wide.select(
            F.col("state").alias("Province/State"),
            F.col("country").alias("Country/Region"),
            F.lit(0.0).alias("Lat"),
            F.lit(0.0).alias("Long"),
            label.alias("label"),
            F.expr(value).alias("value"),
        )
        .groupBy("Province/State", "Country/Region", "Lat", "Long")
        .pivot("label", names)
        .agg(F.max("value"))
    )


def as_long_feed(staged: DataFrame) -> DataFrame:
    """Date text, location, totals, and an indicator nobody asks for."""
    return staged.where(F.col("source") == "LONG").select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("country").alias("location"),
        F.col("confirmed").alias("total_cases"),
        F.col("deaths").alias("total_deaths"),
        F.lit(1.0).alias("positive_rate"),
    )


def as_single_feed(staged: DataFrame) -> DataFrame:
    return staged.where(F.col("source") == "SINGLE").select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("confirmed").alias("cases"), "deaths"
    )


# -- raw rows, not counts: as many as there are events ---------------------------

def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of five busy places: a day, a place (the type), a part of it
    (the user), a value and a source."""
    return read_table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("country"),
        F.col("user_id").cast("string").alias("state"),
        "ts",
        "event_id",
        "value",
        F.col("props").alias("source"),
    )
