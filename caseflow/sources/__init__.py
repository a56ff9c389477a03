from caseflow.sources.feeds import (
    combine,
    preview,
    sort_cases,
    standardise,
    std_long,
    std_single,
    std_wide,
    std_wide_measures,
    value_columns,
    wide_to_long,
)
from caseflow.sources.files import (
    compact_jsonl,
    csv_headers,
    read_csv,
    read_csv_strings,
    read_documents,
    read_jsonl,
    read_parquet,
    write_csv,
    write_documents,
    write_jsonl,
    write_parquet,
)
from caseflow.sources.scratch import discard, scratch_dir, stage

__all__ = [
    "combine", "compact_jsonl", "csv_headers", "discard", "preview", "read_csv", "read_csv_strings", "read_documents",
    "read_jsonl", "read_parquet", "scratch_dir", "sort_cases", "stage", "standardise", "std_long",
    "std_single", "std_wide", "std_wide_measures", "value_columns", "wide_to_long", "write_csv", "write_documents",
    "write_jsonl", "write_parquet",
]
