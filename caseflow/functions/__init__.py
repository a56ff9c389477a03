from caseflow.functions.scalars import (
    at_least_zero,
    cast_sql,
    literal,
    or_zero,
    parse_date,
    quoted,
    tie_break,
    with_thousands,
)
from caseflow.functions.windows import previous_values, trailing_mean

__all__ = [
    "at_least_zero",
    "cast_sql",
    "literal",
    "or_zero",
    "parse_date",
    "previous_values",
    "quoted",
    "tie_break",
    "trailing_mean",
    "with_thousands",
]
