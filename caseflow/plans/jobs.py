"""End-to-end jobs: load, offload, export, enrich, reports, dashboard tables.

Each job writes folders and returns nothing. Where outputs share work, the shared
part is staged once at its smallest: country-day sums and per-place maxima rather
than the rows they came from.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseflow import operators as op, sources as src
from caseflow.schema import PLACE

# Stored feeds may repeat an observation any number of times; see previous_values.
SPREAD_COPIES = 1024
REPORT_NULL = '""'  # as the published reports have it


def load(
    spark: SparkSession,
    *,
    wide: str,
    long: str,
    single: str,
    single_country: str,
    out: str,
    tags: tuple[str, str, str] = ("WIDE", "LONG", "SINGLE"),
    wide_deaths: str | None = None,
    wide_recovered: str | None = None,
) -> None:
    """Three CSV feeds to one Parquet table, sorted by place and date.

    The wide feed may come with a file of deaths and one of recoveries, which are joined
    to it by place and date.

    The feeds are read as text under their header names, since the wide feed gains a
    column a day and inference would read everything twice. The sort clusters the
    table, so a later filter on country skips row groups.
    """
    measures = {"confirmed": wide, "deaths": wide_deaths, "recovered": wide_recovered}
    files = {name: src.read_csv_strings(spark, path, escaped=False) for name, path in measures.items() if path}
    feeds = src.combine(
        src.std_wide(files["confirmed"], source=tags[0]) if len(files) == 1 else src.std_wide_measures(**files, source=tags[0]),
        src.std_long(src.read_csv_strings(spark, long, escaped=False), source=tags[1]),
        src.std_single(src.read_csv_strings(spark, single, escaped=False), country=single_country, source=tags[2]),
    )
    src.write_parquet(src.sort_cases(feeds), out)


def offload(spark: SparkSession, *, cases: str, fmt: str, options: Mapping[str, str]) -> None:
    """The Parquet table to a document collection."""
    src.write_documents(src.read_parquet(spark, cases), fmt, options)


def export_jsonl(spark: SparkSession, *, cases: str, out: str, max_files: int | None = None) -> None:
    """The Parquet table as JSON Lines."""
    src.write_jsonl(src.read_parquet(spark, cases), out, max_files=max_files)


def enrich(cases: DataFrame, *, out: str) -> None:
    """Previous values and signed increments, as Parquet."""
    src.write_parquet(op.daily_new(cases, clip=False, copies=SPREAD_COPIES), out)


def reports(cases: DataFrame, *, out: str, exclude: DataFrame | None = None) -> None:
    """The batch reports as CSV folders below ``out``.

    Three passes over the cases: profile, increments, maxima. ``exclude`` names
    aggregates (continents, income groups) to leave out of the cumulative reports.
    """
    src.write_csv(op.missing_summary(cases), f"{out}/missing_summary", null_value=REPORT_NULL)

    country_day = src.stage(op.country_daily(op.daily_new(cases, copies=SPREAD_COPIES)))
    world = op.flag_anomalies(op.world_daily(country_day, value="daily_new"))
    src.write_csv(world, f"{out}/world_daily_anomaly", null_value=REPORT_NULL)
    src.write_csv(country_day, f"{out}/country_daily", partition_by=["country"], null_value=REPORT_NULL)

    place_max = src.stage(
        cases.groupBy(*PLACE).agg(F.max("confirmed").alias("confirmed"), F.max("deaths").alias("deaths"))
    )
    cumulative = op.cumulative_max(place_max)
    if exclude is not None:
        cumulative = op.exclude_names(cumulative, exclude)
    src.write_csv(cumulative, f"{out}/country_cumulative", null_value=REPORT_NULL)
    src.write_csv(op.top_k(cumulative), f"{out}/top20_confirmed", null_value=REPORT_NULL)
    src.write_csv(op.unique_values(place_max, "country"), f"{out}/unique_countries", null_value=REPORT_NULL)
    src.write_csv(op.unique_values(place_max, "state"), f"{out}/unique_states", null_value=REPORT_NULL)


def explore(cases: DataFrame, *, out: str) -> None:
    """A first look at a table of cases, as CSV folders below ``out``.

    Profile (missing values, shares, types, distinct names), then increments without
    rows of unknown place, the world's anomalies of both kinds, the last known values,
    the largest totals, and the series of countries that have any cases.
    """

    def write(df: DataFrame, name: str) -> None:
        src.write_csv(df, f"{out}/{name}", null_value=REPORT_NULL)

    write(op.missing_summary(cases), "missing_summary")
    write(op.missing_ratio(cases), "missing_ratio")
    write(op.schema_profile(cases), "schema_profile")
    write(op.unique_counts(cases), "unique_counts")

    country_day = src.stage(op.country_daily(op.daily_new(cases, null_keys="drop", copies=SPREAD_COPIES)))
    write(country_day, "country_daily")
    write(op.flag_anomalies(op.world_daily(country_day, value="daily_new")), "world_daily_anomaly")
    write(op.keep_active(country_day), "active_countries_daily")

    by_date = src.stage(op.cumulative_by_date(cases, keys=("country",)))
    write(op.world_cum_anomaly(by_date), "world_cum_anomaly")
    write(op.anomaly_points(op.country_anomaly(by_date)), "country_anomaly_points")

    latest = src.stage(op.latest_nonnull(cases, columns=[c for c in cases.columns if c != "country"]))
    write(latest, "latest_per_country")
    write(op.global_totals(latest), "global_totals")
    write(op.top_k(latest, by="confirmed"), "top20_latest")


def dashboard(enriched: DataFrame, names: DataFrame, *, out: str) -> None:
    """The tables behind the three dashboard tabs, as Parquet folders below ``out``.

    A selector's choice is a filter on the written table, which is laid out by country.
    """
    valid = src.stage(op.reported(enriched, names))
    latest = src.stage(op.latest_nonnull(valid, columns=[c for c in valid.columns if c != "country"]))
    src.write_parquet(latest, f"{out}/latest_per_country")
    src.write_parquet(op.global_totals(latest), f"{out}/global_totals")
    yearly = op.yearly_cumulative(op.latest_by_year(valid, columns=("confirmed", "deaths")))
    src.write_parquet(yearly, f"{out}/yearly_cumulative")
    src.write_parquet(op.countries_with_data(valid), f"{out}/countries_with_data")
    increments = op.non_negative(valid)
    src.write_parquet(op.box_stats(increments), f"{out}/box_stats")
    boxes = enriched.sparkSession.read.parquet(f"{out}/box_stats")
    src.write_parquet(op.box_outliers(increments, boxes=boxes), f"{out}/box_outliers")
    growth = op.growth_rate(valid, copies=SPREAD_COPIES).select("date", "country", "state", "source", "growth_rate", "growth_pct")
    src.write_parquet(growth.repartitionByRange("country", "date"), f"{out}/growth_rate")
