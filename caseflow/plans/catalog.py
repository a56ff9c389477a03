"""Every registered query: (spark, folder of test tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caseflow import operators as op, sources as src
from caseflow.plans import fixtures
from caseflow.functions import previous_values
from caseflow.schema import CANON, PLACE, enforce

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Rows of a top report and of a preview, and the country a single-country view shows.
TOP = 20
PREVIEW_ROWS = 100
SHOWN_COUNTRY = "NATION_7"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _reported(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return op.reported(df, fixtures.iso(spark, d))


def _kept(*columns: str) -> list[str | Column]:
    return ["date", "country", "state", "source", *columns]


# -- sources and sinks ------------------------------------------------------------

@query
def src_csv_roundtrip(spark, d):
    path = src.scratch_dir(spark)
    src.write_csv(fixtures.cases(spark, d), path)
    return src.read_csv(spark, path, CANON)


@query
def src_csv_strings(spark, d):
    path = src.scratch_dir(spark)
    src.write_csv(fixtures.cases(spark, d), path)
    return enforce(src.read_csv_strings(spark, path, CANON))


@query
def src_parquet_roundtrip(spark, d):
    path = src.scratch_dir(spark)
    src.write_parquet(fixtures.cases(spark, d), path)
    return src.read_parquet(spark, path)


@query
def src_document_roundtrip(spark, d):
    options = {"path": src.scratch_dir(spark)}
    src.write_documents(fixtures.cases(spark, d), "json", options)
    return src.read_documents(spark, "json", options)


@query
def src_json_roundtrip(spark, d):
    path = src.scratch_dir(spark)
    src.write_jsonl(fixtures.cases(spark, d), path, max_files=16)
    return src.read_jsonl(spark, path)


@query
def jsonl_compact(spark, d):
    parts, compacted = src.scratch_dir(spark), src.scratch_dir(spark)
    src.write_jsonl(fixtures.cases(spark, d), parts)
    src.compact_jsonl(spark, parts, compacted)
    return src.read_jsonl(spark, compacted)


@query
def sink_partitioned_csv(spark, d):
    daily = country_daily(spark, d)
    path = src.scratch_dir(spark)
    src.write_csv(daily, path, partition_by=["country"])
    return src.read_csv(spark, path, daily.schema).select(daily.columns)


_TEXTS = {"documents": ("doc_id", "lang"), "conversations": ("conv_id", "role")}
_TEXT_SCHEMA = "id bigint, turn bigint, kind string, text string"


def _texts(spark, d, name: str) -> DataFrame:
    ident, kind = _TEXTS[name]
    table = spark.read.parquet(f"{d}/{name}.parquet")
    turn = F.col("turn") if "turn" in table.columns else F.lit(None).cast("bigint")
    return table.select(F.col(ident).alias("id"), turn.alias("turn"), F.col(kind).alias("kind"), "text")


def _texts_again(spark, d, write, read) -> DataFrame:
    """All long texts, whatever is in them, written and read back, with where they came from."""
    found = []
    for name in _TEXTS:
        path = src.scratch_dir(spark)
        write(_texts(spark, d, name), path)
        found.append(read(path).select(F.lit(name).alias("origin"), "*"))
    return src.combine(*found)


@query
def csv_text_roundtrip(spark, d):
    schema = T.StructType.fromDDL(_TEXT_SCHEMA)
    return _texts_again(spark, d, src.write_csv, lambda path: src.read_csv(spark, path, schema, multi_line=True))


@query
def json_text_roundtrip(spark, d):
    schema = T.StructType.fromDDL(_TEXT_SCHEMA)
    return _texts_again(spark, d, src.write_jsonl, lambda path: src.read_jsonl(spark, path, schema))


# -- reshape, standardise, combine ------------------------------------------------

@query
def wide_to_long(spark, d):
    feed = fixtures.as_wide_feed(src.stage(fixtures.cases(spark, d)))
    return src.std_wide(feed, source="WIDE").select("date", "country", "state", "confirmed")


@query
def std_long(spark, d):
    return src.std_long(fixtures.as_long_feed(fixtures.cases(spark, d)), source="LONG")


@query
def std_single(spark, d):
    feed = fixtures.as_single_feed(fixtures.cases(spark, d))
    return src.std_single(feed, country=fixtures.SINGLE_COUNTRY, source="SINGLE")


def _combined(spark, d):
    staged = src.stage(fixtures.cases(spark, d))
    return src.combine(
        src.std_wide(fixtures.as_wide_feed(staged), source="WIDE").withColumn("date", F.add_months("date", -240)),
        src.std_long(fixtures.as_long_feed(staged), source="LONG"),
        src.std_single(fixtures.as_single_feed(staged), country=fixtures.SINGLE_COUNTRY, source="SINGLE"),
    )


@query
def combine_sources(spark, d):
    return _combined(spark, d)


@query
def combine_sorted_head(spark, d):
    return src.preview(_combined(spark, d), PREVIEW_ROWS)


# -- profile ------------------------------------------------------------------------

@query
def missing_summary(spark, d):
    return op.missing_summary(fixtures.cases(spark, d))


@query
def missing_by_column(spark, d):
    return op.missing_by_column(fixtures.cases(spark, d))


@query
def missing_ratio(spark, d):
    return op.missing_ratio(fixtures.cases(spark, d))


@query
def schema_profile(spark, d):
    return op.schema_profile(fixtures.cases(spark, d))


@query
def unique_countries(spark, d):
    return op.unique_values(fixtures.cases(spark, d), "country")


@query
def unique_states(spark, d):
    return op.unique_values(fixtures.cases(spark, d), "state")


@query
def unique_states_nonnull(spark, d):
    return op.unique_values(fixtures.cases(spark, d), "state", keep_null=False)


@query
def unique_counts(spark, d):
    return op.unique_counts(fixtures.cases(spark, d))


# -- increments ---------------------------------------------------------------------

def _clipped(spark, d):
    return op.daily_new(fixtures.cases(spark, d))


def _signed(spark, d):
    return op.daily_new(fixtures.cases(spark, d), clip=False)


def _dropnull(spark, d):
    return op.daily_new(fixtures.cases(spark, d), null_keys="drop")


_INCREMENTS = ("prev_confirmed", "prev_deaths", "daily_new_cases", "daily_new_deaths")


@query
def lag_prev(spark, d):
    return op.lag_prev(fixtures.cases(spark, d)).select(
        *_kept("confirmed", "deaths", "prev_confirmed", "prev_deaths")
    )


@query
def daily_new_clipped(spark, d):
    return _clipped(spark, d).select(*_kept(*_INCREMENTS))


@query
def daily_new_signed(spark, d):
    return _signed(spark, d).select(*_kept(*_INCREMENTS))


@query
def daily_new_dropnull(spark, d):
    return _dropnull(spark, d).select(*_kept(*_INCREMENTS))


# -- aggregates -----------------------------------------------------------------------

@query
def world_daily_anomaly(spark, d):
    return _rounded(op.world_daily_anomaly(_clipped(spark, d)), "roll_mean")


@query
def world_daily_cases_deaths(spark, d):
    return op.world_daily_cases_deaths(_dropnull(spark, d))


@query
def country_daily(spark, d):
    return op.country_daily(_clipped(spark, d))


@query
def country_daily_dropnull(spark, d):
    return op.country_daily(_dropnull(spark, d)).orderBy("country", "date")


@query
def active_countries_daily(spark, d):
    return op.keep_active(op.country_daily(_dropnull(spark, d)))


@query
def country_cumulative(spark, d):
    return op.cumulative_max(fixtures.cases(spark, d))


@query
def world_cumulative(spark, d):
    return op.cumulative_by_date(fixtures.cases(spark, d))


@query
def latest_nonnull(spark, d):
    return op.latest_nonnull(fixtures.cases(spark, d))


@query
def latest_by_year(spark, d):
    return op.latest_by_year(_reported(fixtures.cases(spark, d), spark, d))


@query
def yearly_cumulative(spark, d):
    latest = op.latest_by_year(_reported(fixtures.cases(spark, d), spark, d))
    return op.yearly_cumulative(latest)


@query
def global_totals(spark, d):
    return op.global_totals(op.latest_nonnull(_reported(fixtures.cases(spark, d), spark, d)))


@query
def top20_cumulative(spark, d):
    return op.top_k(op.cumulative_max(fixtures.cases(spark, d)), TOP)


@query
def top20_latest(spark, d):
    latest = op.latest_nonnull(fixtures.cases(spark, d), columns=("confirmed", "deaths"))
    return op.top_k(op.valid_countries(latest, fixtures.iso(spark, d)), TOP, by="confirmed")


# -- anomaly and growth -------------------------------------------------------------------

@query
def world_cum_anomaly(spark, d):
    return _rounded(op.world_cum_anomaly(fixtures.cases(spark, d)), "roll_mean")


@query
def country_anomaly(spark, d):
    return _rounded(op.country_anomaly(fixtures.cases(spark, d)), "roll_mean")


@query
def anomaly_points(spark, d):
    flagged = op.world_cum_anomaly(fixtures.cases(spark, d))
    return _rounded(op.anomaly_points(flagged), "roll_mean")


@query
def growth_rate(spark, d):
    grown = op.growth_rate(_reported(fixtures.cases(spark, d), spark, d))
    return _rounded(grown.select(*_kept("confirmed", "growth_rate", "growth_pct")), "growth_rate", "growth_pct")


# -- filters and box statistics --------------------------------------------------------------

@query
def valid_country_filter(spark, d):
    return _reported(fixtures.cases(spark, d), spark, d)


@query
def country_series(spark, d):
    return op.one_country(op.country_daily(_clipped(spark, d)), SHOWN_COUNTRY)


@query
def countries_with_data(spark, d):
    return op.countries_with_data(_reported(_signed(spark, d), spark, d))


def _boxed(spark, d, *columns: str) -> DataFrame:
    # read by the count of values, the rank search and the comparison with the fences
    return src.stage(op.non_negative(_reported(_signed(spark, d), spark, d)).select(*columns))


@query
def box_stats(spark, d):
    boxes = op.box_stats(_boxed(spark, d, "country", "daily_new_cases"))
    return _rounded(boxes, "q1", "median", "q3", "lower_fence", "upper_fence")


@query
def box_outliers(spark, d):
    return op.box_outliers(_boxed(spark, d, *_kept("daily_new_cases")))


# -- comparisons between feeds ------------------------------------------------------------------

@query
def wide_measures(spark, d):
    staged = src.stage(fixtures.cases(spark, d))
    return src.std_wide_measures(
        confirmed=fixtures.as_wide_feed(staged),
        deaths=fixtures.as_wide_feed(staged, "confirmed DIV 10"),
        recovered=fixtures.as_wide_feed(staged, "confirmed DIV 2"),
        source="WIDE",
    )


@query
def feed_correlation(spark, d):
    staged = src.stage(fixtures.cases(spark, d))
    wide, long = (staged.where(F.col("source") == s) for s in ("WIDE", "LONG"))
    return _rounded(op.correlate(wide, long, left_value="confirmed", right_value="confirmed"), "correlation")


@query
def growth_around_event(spark, d):
    growth = op.growth_rate(op.positive(fixtures.cases(spark, d)), per_source=True)
    return _rounded(op.growth_around(growth, fixtures.events(spark, d)), "growth_before", "growth_after")


@query
def one_row_per_day(spark, d):
    return op.one_per_key(fixtures.cases(spark, d))


@query
def state_trend(spark, d):
    with_state = fixtures.cases(spark, d).where(F.col("state").isNotNull())
    return _rounded(op.cumulative_anomaly(with_state, keys=("state",)), "roll_mean")


@query
def place_trend(spark, d):
    with_state = fixtures.cases(spark, d).where(F.col("state").isNotNull())
    return _rounded(op.cumulative_anomaly(with_state, keys=PLACE), "roll_mean")


@query
def subnational_gap(spark, d):
    return op.subnational_gap(fixtures.cases(spark, d), national_source="LONG")


# -- the same operators over raw rows, a few keys holding all of them -----------------------------

@query
def events_lag(spark, d):
    lagged = previous_values(
        fixtures.event_rows(spark, d),
        {"prev_value": "value", "prev_id": "event_id"},
        keys=["country"],
        order_by=["date", "ts", "event_id"],
    )
    return lagged.select("event_id", "country", "value", "prev_value", "prev_id")


@query
def events_latest(spark, d):
    return op.latest_nonnull(fixtures.event_rows(spark, d), columns=("date", "state", "value", "source"))


@query
def events_box(spark, d):
    boxes = op.box_stats(fixtures.event_rows(spark, d), value="value")
    return _rounded(boxes, "q1", "median", "q3", "lower_fence", "upper_fence")


@query
def events_growth(spark, d):
    grown = op.growth_rate(fixtures.event_rows(spark, d), value="value")
    return _rounded(grown.select(*_kept("value", "growth_rate", "growth_pct")), "growth_rate", "growth_pct")
