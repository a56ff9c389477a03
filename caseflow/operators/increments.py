"""Daily increments of cumulative series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caseflow.functions.scalars import or_zero
from caseflow.functions.windows import previous_values
from caseflow.schema import PLACE

PREVIOUS = {"prev_confirmed": "confirmed", "prev_deaths": "deaths"}
NEW = {
    "daily_new_cases": ("confirmed", "prev_confirmed"),
    "daily_new_deaths": ("deaths", "prev_deaths"),
}


def lag_prev(
    df: DataFrame,
    *,
    values: Mapping[str, str] = PREVIOUS,
    keys: Sequence[str] = PLACE,
    null_keys: str = "group",
    per_source: bool = False,
    **split,
) -> DataFrame:
    """Add the previous row's values within ``keys`` by date.

    Rows of one day are ordered by source, then by the values themselves, so the
    result does not depend on how the input happens to be partitioned.

    ``null_keys="group"`` treats a null key as a value of its own, as SQL windows
    do; ``"drop"`` gives such rows no predecessor. ``per_source`` keeps the feeds of
    one place apart. ``split`` goes to :func:`previous_values`: how a large place is
    cut (``pieces``), and whether its copies are spread (``copies``).
    """
    if null_keys not in ("group", "drop"):
        raise ValueError(f"null_keys: {null_keys!r}")
    places = [*keys, "source"] if per_source else list(keys)
    out = previous_values(
        df,
        values,
        keys=places,
        order_by=["date", "source", *dict.fromkeys(values.values())],
        **split,
    )
    if null_keys == "drop":
        known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
        out = out.withColumns({c: F.when(known, F.col(c)) for c in values})
    return out


def daily_new(
    df: DataFrame,
    *,
    clip: bool = True,
    new: Mapping[str, tuple[str, str]] = NEW,
    **lag_options,
) -> DataFrame:
    """Add previous values and increments; an unknown increment counts as 0.

    ``clip=True`` turns a falling total into 0, ``clip=False`` keeps the negative
    correction. Further options go to :func:`lag_prev`.
    """
    lagged = lag_prev(df, values={prev: value for value, prev in new.values()}, **lag_options)

    def increment(value: str, prev: str) -> Column:
        known = or_zero(F.col(value) - F.col(prev))
        return F.greatest(known, F.lit(0)) if clip else known

    return lagged.withColumns({out: increment(*pair) for out, pair in new.items()})
