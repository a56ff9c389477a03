"""The same queries as SQL for DuckDB, over the same test tables."""

from __future__ import annotations

_FEEDS = """
base AS (
  SELECT n.n_nationkey AS nk, n.n_name AS country, c.c_mktsegment AS state,
         CAST(o.o_orderdate AS DATE) AS date, o.o_orderstatus AS st
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
long_day AS (
  SELECT nk, country, date, COUNT(*) AS n, SUM(CASE WHEN st = 'P' THEN 1 ELSE 0 END) AS p,
         SUM(CASE WHEN st = 'F' THEN 1 ELSE 0 END) AS f
  FROM base GROUP BY nk, country, date),
long_src AS (
  SELECT date, country, CAST(NULL AS VARCHAR) AS state,
         CAST(SUM(n) OVER (PARTITION BY country ORDER BY date) - 2 * p AS BIGINT) AS confirmed,
         CAST(NULLIF(SUM(f) OVER (PARTITION BY country ORDER BY date), 0) AS DOUBLE) AS deaths,
         CAST(NULL AS DOUBLE) AS recovered, 'LONG' AS source, nk
  FROM long_day),
pairs AS (SELECT DISTINCT country, state FROM base),
months AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date FROM base),
wide_m AS (
  SELECT country, state, CAST(date_trunc('month', date) AS DATE) AS date, COUNT(*) AS n
  FROM base GROUP BY 1, 2, 3),
wide_c AS (SELECT country, state, date, SUM(n) OVER (PARTITION BY country, state ORDER BY date) AS cum FROM wide_m),
wide_src AS (
  SELECT m.date, p.country, p.state, CAST(w.cum AS BIGINT) AS confirmed, CAST(NULL AS DOUBLE) AS deaths,
         CAST(NULL AS DOUBLE) AS recovered, 'WIDE' AS source
  FROM pairs p CROSS JOIN months m
  LEFT JOIN wide_c w ON w.country = p.country AND w.state = p.state AND w.date = m.date),
single_src AS (
  SELECT date, country, state, confirmed + 1 AS confirmed, deaths, recovered, 'SINGLE' AS source
  FROM long_src WHERE nk = 0),
cases AS (
  SELECT * FROM wide_src
  UNION ALL SELECT date, country, state, confirmed, deaths, recovered, source FROM long_src
  UNION ALL SELECT * FROM single_src),
iso AS (SELECT n_name AS name FROM nation WHERE n_nationkey % 10 <> 3),
lagged AS (
  SELECT *, LAG(confirmed) OVER w AS prev_confirmed, LAG(deaths) OVER w AS prev_deaths
  FROM cases WINDOW w AS (PARTITION BY country, state ORDER BY date, source)),
clipped AS (
  SELECT *,
    CASE WHEN confirmed - prev_confirmed > 0 THEN confirmed - prev_confirmed ELSE 0 END AS daily_new_cases,
    CASE WHEN deaths - prev_deaths > 0 THEN deaths - prev_deaths ELSE 0 END AS daily_new_deaths
  FROM lagged),
signed AS (
  SELECT *, COALESCE(confirmed - prev_confirmed, 0) AS daily_new_cases,
         COALESCE(deaths - prev_deaths, 0) AS daily_new_deaths
  FROM lagged),
dropnull AS (
  SELECT * REPLACE (
    CASE WHEN state IS NULL THEN NULL ELSE prev_confirmed END AS prev_confirmed,
    CASE WHEN state IS NULL THEN NULL ELSE prev_deaths END AS prev_deaths,
    CASE WHEN state IS NULL THEN 0 ELSE daily_new_cases END AS daily_new_cases,
    CASE WHEN state IS NULL THEN 0 ELSE daily_new_deaths END AS daily_new_deaths)
  FROM clipped),
reported AS (SELECT * FROM cases WHERE country IN (SELECT name FROM iso) AND confirmed > 0),
country_day AS (
  SELECT country, date, CAST(SUM(daily_new_cases) AS BIGINT) AS daily_new FROM clipped GROUP BY country, date),
country_day_dropnull AS (
  SELECT country, date, CAST(SUM(daily_new_cases) AS BIGINT) AS daily_new FROM dropnull GROUP BY country, date),
cumulative AS (
  SELECT country, MAX(confirmed) AS cum_confirmed, MAX(deaths) AS cum_deaths FROM cases GROUP BY country),
boxed AS (
  SELECT * FROM signed
  WHERE country IN (SELECT name FROM iso) AND confirmed > 0 AND daily_new_cases >= 0),
quartiles AS (
  SELECT country, quantile_cont(daily_new_cases, 0.25) AS q1, quantile_cont(daily_new_cases, 0.5) AS median,
         quantile_cont(daily_new_cases, 0.75) AS q3
  FROM boxed GROUP BY country),
fences AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM quartiles),
world_cum AS (
  SELECT date, CAST(COALESCE(SUM(confirmed), 0) AS BIGINT) AS confirmed FROM cases GROUP BY date),
world_step AS (SELECT *, LAG(confirmed) OVER (ORDER BY date) AS prev FROM world_cum),
world_new AS (
  SELECT *, CASE WHEN prev IS NOT NULL THEN GREATEST(confirmed - prev, 0) END AS daily_new FROM world_step),
world_roll AS (
  SELECT *, AVG(daily_new) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll FROM world_new),
world_flagged AS (
  SELECT date, confirmed, prev, daily_new, ROUND(roll, 6) AS roll_mean,
         COALESCE(daily_new > roll * 1.5, FALSE) AS anomaly
  FROM world_roll)
"""


def _sql(body: str) -> str:
    return f"WITH {_FEEDS.strip()}\n{body.strip()}"


def _last(columns: str) -> str:
    order = "{'d': date, 'st': COALESCE(state, ''), 'so': source}"
    return ", ".join(
        f"arg_max({c}, {order}) FILTER ({c} IS NOT NULL) AS {c}" for c in columns.split()
    )


_ALL_LAST = _last("date state confirmed deaths recovered source")
_CASES = "SELECT date, country, state, confirmed, deaths, recovered, source FROM cases"
_INCREMENTS = (
    "SELECT date, country, state, source, prev_confirmed, prev_deaths, daily_new_cases, daily_new_deaths FROM "
)
_COLUMNS = ("date", "country", "state", "confirmed", "deaths", "recovered", "source")
_TYPED = "replace(lower(typeof(any_value({c}))), 'varchar', 'string')"

_TEXTS = """
    SELECT 'documents' AS origin, doc_id AS id, CAST(NULL AS BIGINT) AS turn, lang AS kind, text FROM documents
    UNION ALL
    SELECT 'conversations', conv_id, turn, role, text FROM conversations"""
_EVENTS = """WITH rows AS (
        SELECT CAST(ts AS DATE) AS date, event_type AS country, CAST(user_id AS VARCHAR) AS state, ts, event_id, value,
               props AS source
        FROM events)"""

ORACLE: dict[str, str] = {
    # sources and sinks
    "src_csv_roundtrip": _sql(_CASES),
    "src_csv_strings": _sql(_CASES),
    "src_parquet_roundtrip": _sql(_CASES),
    "src_document_roundtrip": _sql(_CASES),
    "src_json_roundtrip": _sql(_CASES),
    "jsonl_compact": _sql(_CASES),
    "sink_partitioned_csv": _sql("SELECT country, date, daily_new FROM country_day"),
    # reshape, standardise, combine
    "wide_to_long": _sql(
        "SELECT CAST(date + INTERVAL 20 YEAR AS DATE) AS date, country, state, confirmed FROM wide_src"
    ),
    "std_long": _sql("SELECT date, country, state, confirmed, deaths, recovered, source FROM long_src"),
    "std_single": _sql("SELECT date, country, state, confirmed, deaths, recovered, source FROM single_src"),
    "combine_sources": _sql(_CASES),
    "combine_sorted_head": _sql(
        _CASES + " ORDER BY country NULLS FIRST, state NULLS FIRST, date NULLS FIRST, source, confirmed LIMIT 100"
    ),
    # profile
    "missing_summary": _sql(
        "SELECT "
        + ", ".join(f"COUNT(*) FILTER ({c} IS NULL) AS {c}" for c in _COLUMNS)
        + ", COUNT(*) AS total_rows FROM cases"
    ),
    "missing_by_column": _sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS missing FROM cases" for c in _COLUMNS
        )
    ),
    "missing_ratio": _sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, ROUND(100.0 * COUNT(*) FILTER ({c} IS NULL) / COUNT(*), 2) AS missing_pct"
            " FROM cases"
            for c in _COLUMNS
        )
    ),
    "schema_profile": _sql(
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS column_name, {_TYPED.format(c=c)} AS data_type,"
            f" COUNT({c}) AS non_null FROM cases"
            for i, c in enumerate(_COLUMNS, 1)
        )
    ),
    "unique_countries": _sql("SELECT DISTINCT country FROM cases"),
    "unique_states": _sql("SELECT DISTINCT state FROM cases"),
    "unique_states_nonnull": _sql("SELECT DISTINCT state FROM cases WHERE state IS NOT NULL"),
    "unique_counts": _sql("SELECT COUNT(DISTINCT country) AS n_country, COUNT(DISTINCT state) AS n_state FROM cases"),
    # increments
    "lag_prev": _sql(
        "SELECT date, country, state, source, confirmed, deaths, prev_confirmed, prev_deaths FROM lagged"
    ),
    "daily_new_clipped": _sql(_INCREMENTS + "clipped"),
    "daily_new_signed": _sql(_INCREMENTS + "signed"),
    "daily_new_dropnull": _sql(_INCREMENTS + "dropnull"),
    # aggregates
    "world_daily_anomaly": _sql("""
        , daily AS (SELECT date, CAST(SUM(daily_new_cases) AS BIGINT) AS daily_new FROM clipped GROUP BY date),
        rolled AS (
          SELECT *, AVG(daily_new) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll FROM daily)
        SELECT date, daily_new, ROUND(roll, 6) AS roll_mean, COALESCE(daily_new > roll * 1.5, FALSE) AS anomaly
        FROM rolled"""),
    "world_daily_cases_deaths": _sql("""
        SELECT date, CAST(SUM(daily_new_cases) AS BIGINT) AS daily_new_cases,
               CAST(SUM(daily_new_deaths) AS DOUBLE) AS daily_new_deaths
        FROM dropnull GROUP BY date"""),
    "country_daily": _sql("SELECT country, date, daily_new FROM country_day"),
    "country_daily_dropnull": _sql("SELECT country, date, daily_new FROM country_day_dropnull"),
    "active_countries_daily": _sql("""
        SELECT country, date, daily_new FROM country_day_dropnull
        WHERE country IN (SELECT country FROM country_day_dropnull GROUP BY country HAVING SUM(daily_new) > 0)"""),
    "country_cumulative": _sql("SELECT country, cum_confirmed, cum_deaths FROM cumulative"),
    "world_cumulative": _sql("""
        SELECT date, CAST(COALESCE(SUM(confirmed), 0) AS BIGINT) AS confirmed, COALESCE(SUM(deaths), 0) AS deaths
        FROM cases GROUP BY date"""),
    "latest_nonnull": _sql(f"SELECT country, {_ALL_LAST} FROM cases GROUP BY country"),
    "latest_by_year": _sql(
        f"SELECT country, CAST(year(date) AS INTEGER) AS year, {_ALL_LAST.replace('arg_max(date,', 'arg_max(reported.date,')}"
        " FROM reported GROUP BY country, year(date)"
    ),
    "yearly_cumulative": _sql(f"""
        , latest AS (
          SELECT country, CAST(year(date) AS INTEGER) AS year, {_last("confirmed deaths")}
          FROM reported GROUP BY country, year(date))
        SELECT year, CAST(COALESCE(SUM(confirmed), 0) AS BIGINT) AS confirmed, COALESCE(SUM(deaths), 0) AS deaths
        FROM latest GROUP BY year"""),
    "global_totals": _sql(f"""
        , latest AS (SELECT country, MAX(date) AS date, {_last("confirmed deaths")} FROM reported GROUP BY country),
        totals AS (
          SELECT CAST(COALESCE(SUM(confirmed), 0) AS BIGINT) AS total_confirmed,
                 CAST(COALESCE(SUM(deaths), 0) AS BIGINT) AS total_deaths,
                 strftime(MAX(date), '%Y-%m-%d') AS latest_date
          FROM latest)
        SELECT total_confirmed, total_deaths, latest_date,
               format('{{:,}}', total_confirmed) AS total_confirmed_text,
               format('{{:,}}', total_deaths) AS total_deaths_text
        FROM totals"""),
    "top20_cumulative": _sql("""
        SELECT country, cum_confirmed, cum_deaths FROM cumulative
        ORDER BY cum_confirmed DESC NULLS LAST, country LIMIT 20"""),
    "top20_latest": _sql(f"""
        , latest AS (SELECT country, {_last("confirmed deaths")} FROM cases GROUP BY country)
        SELECT country, confirmed, deaths FROM latest WHERE country IN (SELECT name FROM iso)
        ORDER BY confirmed DESC NULLS LAST, country LIMIT 20"""),
    # anomaly and growth
    "world_cum_anomaly": _sql("SELECT * FROM world_flagged"),
    "anomaly_points": _sql("SELECT * FROM world_flagged WHERE anomaly"),
    "country_anomaly": _sql("""
        , day AS (
          SELECT country, date, CAST(COALESCE(SUM(confirmed), 0) AS BIGINT) AS confirmed
          FROM cases GROUP BY country, date),
        step AS (SELECT *, LAG(confirmed) OVER (PARTITION BY country ORDER BY date) AS prev FROM day),
        new AS (SELECT *, CASE WHEN prev IS NOT NULL THEN GREATEST(confirmed - prev, 0) END AS daily_new FROM step),
        rolled AS (
          SELECT *, AVG(daily_new) OVER (
            PARTITION BY country ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll
          FROM new)
        SELECT country, date, confirmed, prev, daily_new, ROUND(roll, 6) AS roll_mean,
               COALESCE(daily_new > roll * 1.5, FALSE) AS anomaly
        FROM rolled"""),
    "growth_rate": _sql("""
        , step AS (
          SELECT *, LAG(confirmed) OVER (PARTITION BY country ORDER BY date, COALESCE(state, ''), source) AS prev
          FROM reported),
        grown AS (SELECT *, COALESCE(CAST(confirmed AS DOUBLE) / prev - 1, 0) AS rate FROM step)
        SELECT date, country, state, source, confirmed, ROUND(rate, 6) AS growth_rate,
               ROUND(rate * 100, 6) AS growth_pct
        FROM grown"""),
    # filters and box statistics
    "valid_country_filter": _sql("SELECT date, country, state, confirmed, deaths, recovered, source FROM reported"),
    "country_series": _sql("SELECT country, date, daily_new FROM country_day WHERE country = 'NATION_7'"),
    "countries_with_data": _sql("SELECT DISTINCT country FROM boxed WHERE daily_new_cases > 0"),
    "box_stats": _sql("""
        SELECT country, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
               ROUND(lower_fence, 6) AS lower_fence, ROUND(upper_fence, 6) AS upper_fence,
               MIN(daily_new_cases) FILTER (daily_new_cases BETWEEN lower_fence AND upper_fence) AS whisker_low,
               MAX(daily_new_cases) FILTER (daily_new_cases BETWEEN lower_fence AND upper_fence) AS whisker_high,
               COUNT(*) AS n_rows,
               COUNT(*) FILTER (daily_new_cases NOT BETWEEN lower_fence AND upper_fence) AS n_outliers
        FROM boxed JOIN fences USING (country)
        GROUP BY country, q1, median, q3, lower_fence, upper_fence"""),
    "box_outliers": _sql("""
        SELECT date, country, state, source, daily_new_cases FROM boxed JOIN fences USING (country)
        WHERE daily_new_cases NOT BETWEEN lower_fence AND upper_fence"""),
    # comparisons between feeds
    "wide_measures": _sql("""
        SELECT CAST(date + INTERVAL 20 YEAR AS DATE) AS date, country, state, confirmed,
               CAST(confirmed // 10 AS DOUBLE) AS deaths, CAST(confirmed // 2 AS DOUBLE) AS recovered, source
        FROM wide_src"""),
    "feed_correlation": _sql("""
        , a AS (SELECT country, date, SUM(confirmed) AS x FROM wide_src GROUP BY country, date),
        b AS (SELECT country, date, SUM(confirmed) AS y FROM long_src GROUP BY country, date)
        SELECT country, COUNT(*) AS n_days,
               CASE WHEN COUNT(DISTINCT x) > 1 AND COUNT(DISTINCT y) > 1
                    THEN ROUND(corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE)), 6) END AS correlation
        FROM a JOIN b USING (country, date) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY country"""),
    "growth_around_event": _sql("""
        , step AS (
          SELECT *, LAG(confirmed) OVER (PARTITION BY country, source ORDER BY date, COALESCE(state, '')) AS prev
          FROM cases WHERE confirmed > 0),
        grown AS (SELECT *, COALESCE(CAST(confirmed AS DOUBLE) / prev - 1, 0) AS rate FROM step),
        happened AS (
          SELECT n_name AS country,
                 CAST(DATE '1997-01-01' + to_months(CAST(n_nationkey AS INTEGER)) AS DATE) AS event_date
          FROM nation)
        SELECT country, event_date, ROUND(AVG(rate) FILTER (date < event_date), 6) AS growth_before,
               ROUND(AVG(rate) FILTER (date >= event_date), 6) AS growth_after
        FROM happened LEFT JOIN grown USING (country) GROUP BY country, event_date"""),
    "one_row_per_day": _sql("""
        SELECT date, country, state, confirmed, deaths, recovered, source FROM cases
        QUALIFY ROW_NUMBER() OVER (PARTITION BY country, state, date ORDER BY source DESC) = 1"""),
    "state_trend": _sql("""
        , day AS (
          SELECT state, date, CAST(COALESCE(SUM(confirmed), 0) AS BIGINT) AS confirmed
          FROM cases WHERE state IS NOT NULL GROUP BY state, date),
        step AS (SELECT *, LAG(confirmed) OVER (PARTITION BY state ORDER BY date) AS prev FROM day),
        new AS (SELECT *, CASE WHEN prev IS NOT NULL THEN GREATEST(confirmed - prev, 0) END AS daily_new FROM step),
        rolled AS (
          SELECT *, AVG(daily_new) OVER (
            PARTITION BY state ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll
          FROM new)
        SELECT state, date, confirmed, prev, daily_new, ROUND(roll, 6) AS roll_mean,
               COALESCE(daily_new > roll * 1.5, FALSE) AS anomaly
        FROM rolled"""),
    "place_trend": _sql("""
        , day AS (
          SELECT country, state, date, CAST(COALESCE(SUM(confirmed), 0) AS BIGINT) AS confirmed
          FROM cases WHERE state IS NOT NULL GROUP BY country, state, date),
        step AS (SELECT *, LAG(confirmed) OVER (PARTITION BY country, state ORDER BY date) AS prev FROM day),
        new AS (SELECT *, CASE WHEN prev IS NOT NULL THEN GREATEST(confirmed - prev, 0) END AS daily_new FROM step),
        rolled AS (
          SELECT *, AVG(daily_new) OVER (
            PARTITION BY country, state ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll
          FROM new)
        SELECT country, state, date, confirmed, prev, daily_new, ROUND(roll, 6) AS roll_mean,
               COALESCE(daily_new > roll * 1.5, FALSE) AS anomaly
        FROM rolled"""),
    "subnational_gap": _sql("""
        , a AS (
          SELECT country, date, CAST(SUM(confirmed) AS BIGINT) AS regional FROM wide_src
          GROUP BY country, date HAVING SUM(confirmed) IS NOT NULL),
        b AS (SELECT country, date, CAST(SUM(confirmed) AS BIGINT) AS national FROM long_src GROUP BY country, date)
        SELECT country, date, regional, national, regional - national AS gap FROM a FULL JOIN b USING (country, date)"""),
    # long texts through files
    "csv_text_roundtrip": _TEXTS,
    "json_text_roundtrip": _TEXTS,
    # raw rows
    "events_lag": f"""{_EVENTS}
        SELECT event_id, country, value,
               LAG(value) OVER (PARTITION BY country ORDER BY date, ts, event_id) AS prev_value,
               LAG(event_id) OVER (PARTITION BY country ORDER BY date, ts, event_id) AS prev_id
        FROM rows""",
    "events_latest": f"""{_EVENTS}
        SELECT country, """ + ", ".join(
            f"arg_max({c}, {{'d': date, 'st': COALESCE(state, ''), 'so': source, 'v': {c}}}) FILTER ({c} IS NOT NULL) AS {c}"
            for c in ("date", "state", "value", "source")
        ) + " FROM rows GROUP BY country",
    "events_box": f"""{_EVENTS},
        quartiles AS (
          SELECT country, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
          FROM rows GROUP BY country),
        fences AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM quartiles)
        SELECT country, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
               ROUND(lower_fence, 6) AS lower_fence, ROUND(upper_fence, 6) AS upper_fence,
               MIN(value) FILTER (value BETWEEN lower_fence AND upper_fence) AS whisker_low,
               MAX(value) FILTER (value BETWEEN lower_fence AND upper_fence) AS whisker_high,
               COUNT(*) AS n_rows, COUNT(*) FILTER (value NOT BETWEEN lower_fence AND upper_fence) AS n_outliers
        FROM rows JOIN fences USING (country) GROUP BY country, q1, median, q3, lower_fence, upper_fence""",
    "events_growth": f"""{_EVENTS},
        step AS (
          SELECT *, LAG(value) OVER (PARTITION BY country ORDER BY date, COALESCE(state, ''), source, value) AS prev FROM rows),
        grown AS (SELECT *, COALESCE(value / NULLIF(prev, 0) - 1, 0) AS rate FROM step)
        SELECT date, country, state, source, value, ROUND(rate, 6) AS growth_rate, ROUND(rate * 100, 6) AS growth_pct
        FROM grown""",
}
