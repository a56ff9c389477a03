"""Window expressions that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseflow.functions.scalars import tie_break

ROLLING_ROWS = 7
BY_DAY = (("date",),)


def trailing_mean(
    value: str,
    *,
    order_by: Sequence[Column],
    keys: Sequence[str] = (),
    rows: int = ROLLING_ROWS,
) -> Column:
    """Mean of the last ``rows`` rows, the current one included; nulls are skipped.

    Without keys the window is a single task, so the input must already be
    aggregated to one row per date.
    """
    frame = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(1 - rows, 0)
    return F.avg(value).over(frame)


def previous_values(
    df: DataFrame,
    values: Mapping[str, str],
    *,
    keys: Sequence[str],
    order_by: Sequence[str],
    pieces: Sequence[Sequence[str]] = BY_DAY,
    copies: int = 0,
) -> DataFrame:
    """``lag`` of several columns within ``keys``, split so that no key needs one task.

    ``values`` maps output name to input column. ``pieces`` lists, from fine to
    coarse, leading parts of ``order_by`` to cut a key's rows by: each piece is a
    contiguous run. The last row of every piece is found by an aggregate, which combines
    before it shuffles; a lag over these, as many as the calendar has days, tells what
    comes before each piece. That joins the piece as one more row at its head, and the
    lag is taken inside the pieces. One shuffle carries the rows, to tasks that sort one
    piece of one key at a time; the finest pieces named are used.

    With the default a task sorts one day of a key. ``(("date", "source"), ("date",))``
    also cuts a day with many feeds. ``copies`` spreads rows equal in all of
    ``order_by`` over that many tasks, by where they were read; since they are equal,
    their order among themselves does not matter. It goes level by level instead, from
    the copies over the pieces to the key, and every level shuffles the rows once.
    ``pieces=()`` is the plain window, for small keys.
    """
    if pieces and not copies:
        return _lag_in_pieces(df, values, list(keys), list(order_by), list(pieces[0]))
    order, levels = list(order_by), [list(p) for p in pieces]
    out = df
    if copies:
        out = out.withColumn("_salt", F.spark_partition_id() % copies)
        order.append("_salt")
        levels.insert(0, order)
    levels.append([])
    finest = levels[0]

    for n, level in enumerate(levels):
        if n == 0:
            window = Window.partitionBy(*keys, *finest)
            is_open, lacks = F.lit(True), F.lit(True)
        else:
            is_open, lacks = F.col("_open"), F.col("_first")
            done = [F.col(c) if c in level else F.when(~is_open, F.col(c)) for c in finest]
            window = Window.partitionBy(*keys, "_open", *done)
        window = window.orderBy(*tie_break(*order))
        step = {
            name: F.lag(src).over(window) if n == 0 else F.when(lacks, F.lag(src).over(window)).otherwise(F.col(name))
            for name, src in values.items()
        }
        if level:
            first, last = (f(F.lit(1)).over(window).isNull() for f in (F.lag, F.lead))
            step |= {"_first": is_open & first, "_open": is_open & (first | last)}
        out = out.withColumns(step)
    return out.drop("_first", "_open", "_salt")


def _lag_in_pieces(df: DataFrame, values: Mapping[str, str], keys: list[str], order: list[str], piece: list[str]) -> DataFrame:
    inputs = list(dict.fromkeys(values.values()))
    # a row at the head stands in the piece it opens, so a value that says where needs a column of its own
    carried = {c: f"_value_{n}" if c in (*keys, *piece) else c for n, c in enumerate(inputs)}
    within = [c for c in order if c not in piece]
    whole = F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(within)], *[F.col(c).alias(f"v{n}") for n, c in enumerate(inputs)])
    lasts = df.groupBy(*keys, *piece).agg(F.max(whole).alias("_last"))
    pieces_of_key = Window.partitionBy(*keys).orderBy(*tie_break(*piece))
    heads = lasts.withColumn("_last", F.lag("_last").over(pieces_of_key)).where("_last IS NOT NULL")

    rows = df.withColumns({new: F.col(c) for c, new in carried.items() if new != c})
    found = {c: F.col(f"_last.v{n}") for n, c in enumerate(inputs)}
    head = {f.name: F.col(f.name) if f.name in (*keys, *piece) else F.lit(None).cast(f.dataType) for f in rows.schema}
    head |= {carried[c]: value for c, value in found.items()}
    both = rows.withColumn("_row", F.lit(True)).unionByName(
        heads.select(*[column.alias(name) for name, column in head.items()], F.lit(False).alias("_row"))
    )
    window = Window.partitionBy(*keys, *piece).orderBy("_row", *tie_break(*within, *[carried[c] for c in inputs if c not in order]))
    lagged = both.withColumns({name: F.lag(carried[c]).over(window) for name, c in values.items()})
    return lagged.where("_row").drop("_row", *[new for c, new in carried.items() if new != c])
