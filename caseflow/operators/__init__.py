from caseflow.operators.aggregate import (
    country_daily,
    cumulative_by_date,
    cumulative_max,
    global_totals,
    latest_by_year,
    latest_nonnull,
    top_k,
    world_daily,
    world_daily_cases_deaths,
    yearly_cumulative,
)
from caseflow.operators.anomaly import (
    anomaly_points,
    country_anomaly,
    cumulative_anomaly,
    flag_anomalies,
    growth_rate,
    world_cum_anomaly,
    world_daily_anomaly,
)
from caseflow.operators.compare import correlate, growth_around, one_per_key, subnational_gap
from caseflow.operators.filters import (
    active_countries,
    countries_with_data,
    exclude_names,
    keep_active,
    non_negative,
    one_country,
    positive,
    reported,
    valid_countries,
)
from caseflow.operators.increments import daily_new, lag_prev
from caseflow.operators.quality import (
    missing_by_column,
    missing_ratio,
    missing_summary,
    schema_profile,
    unique_counts,
    unique_values,
)
from caseflow.operators.stats import box_fences, box_outliers, box_stats, exact_quantiles

__all__ = [
    "active_countries", "anomaly_points", "box_fences", "box_outliers", "box_stats", "correlate", "countries_with_data",
    "country_anomaly", "country_daily", "cumulative_anomaly", "cumulative_by_date", "cumulative_max",
    "daily_new", "exact_quantiles", "exclude_names", "flag_anomalies", "global_totals", "growth_around", "growth_rate",
    "keep_active", "lag_prev", "latest_by_year", "latest_nonnull", "missing_by_column", "missing_ratio",
    "missing_summary", "non_negative", "one_country", "one_per_key", "positive", "reported", "schema_profile", "subnational_gap", "top_k",
    "unique_counts", "unique_values", "valid_countries", "world_cum_anomaly", "world_daily",
    "world_daily_anomaly", "world_daily_cases_deaths", "yearly_cumulative",
]
