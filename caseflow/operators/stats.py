"""Box-plot statistics: exact quartiles, fences, whiskers and outliers per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseflow.sources.scratch import stage

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
FENCE = 1.5

# Bands per doubling of a value. Any bigint or double falls in one of a few
# thousand bands, so the list of a group's bands is short whatever its size.
_BANDS_PER_DOUBLING = 64

# A band with more distinct values than this is cut into so many, and again.
PIECE = 10_000
_CUTS = 1024


def _band(value: Column) -> Column:
    """A step function that never falls as ``value`` rises; infinities and, last, NaN
    have steps of their own."""
    number = value.cast("double")
    size = F.signum(number) * F.log2(F.abs(number) + 1) * _BANDS_PER_DOUBLING
    return (
        F.when(F.isnan(number), 1 << 62)
        .when(F.abs(number) == float("inf"), (F.signum(number) * (1 << 61)).cast("long"))
        .otherwise(F.floor(size))
    )


def frequencies(df: DataFrame, *, key: str, value: str) -> DataFrame:
    """(key, value, n): how often each value occurs. Combines before it shuffles.

    Null keys and values go here, explicitly, so that the joins further up infer
    nothing new and every use of the table is one and the same shuffle.
    """
    known = F.col(key).isNotNull() & F.col(value).isNotNull()
    return df.where(known).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(freq: DataFrame, *, key: str, value: str, probs: dict[str, float], piece: int = PIECE) -> DataFrame:
    """Exact quantiles per key with linear interpolation between neighbouring ranks.

    Gathering a group's values, or its distinct values, in one task does not bound
    the task. Instead the values are counted in bands; a running count over a key's
    bands tells which band holds each wanted rank. A band of more than ``piece``
    distinct values is cut evenly between its own least and greatest value, and the
    search goes on in the part that holds the rank, until what is left is small; only
    that is sorted. Every level shrinks a band to at most a thousandth of its width, so
    there are a handful at most, each one pass over the band's values.

    NaN is the greatest value, as in Spark's own percentile. ``freq`` should be a stored
    table (``stage``): it is read once per level.
    """
    ranks = [
        F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), bound(F.lit(p) * (F.col("rows") - 1)).alias("rank"))
        for name, p in probs.items()
        for bound in (F.floor, F.ceil)
    ]
    totals = freq.groupBy(key).agg(F.sum("n").alias("rows")).withColumn("ranks", F.array_distinct(F.array(*ranks)))
    bands = _summed(freq.withColumn("cut", _band(F.col(value))), [key, "cut"], value)
    pieces = stage(_holding(bands.join(totals, key).withColumn("start", F.lit(0).cast("long")), [key]))
    while pieces.where(F.col("distinct") > piece).head(1):
        small, large = pieces.where(F.col("distinct") <= piece), pieces.where(F.col("distinct") > piece)
        width = (F.col("hi") - F.col("lo")).cast("double")
        cut = F.floor((F.col(value) - F.col("lo")).cast("double") / width * _CUTS)
        bands = _summed(_inside(freq, large, key, value).withColumn("cut", cut), [key, "lo", "cut"], value, "lo2")
        carried = large.select(key, "lo", "start", "rows", "ranks")
        pieces = stage(small.unionByName(_holding(bands.join(carried, [key, "lo"]), [key, "lo"]).drop("lo").withColumnRenamed("lo2", "lo")))

    in_piece = Window.partitionBy(key, "lo").orderBy(value)
    found = (
        _inside(freq, pieces, key, value)
        .withColumn("end", F.col("start") + F.sum("n").over(in_piece.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rank", F.explode("ranks"))
        .where((F.col("rank.rank") < F.col("end")) & (F.col("rank.rank") >= F.col("end") - F.col("n")))
    )

    def quantile(name: str, p: float) -> Column:
        mine = F.when(F.col("rank.name") == name, F.col(value).cast("double"))
        low, high = F.min(mine), F.max(mine)
        at = F.lit(p) * (F.max("rows") - 1)
        # one value for both ranks needs no difference, which infinity does not have
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name)

    return found.groupBy(key).agg(*[quantile(n, p) for n, p in probs.items()])


def _summed(cut: DataFrame, by: list[str], value: str, lo: str = "lo") -> DataFrame:
    """Rows, distinct values and bounds of every band."""
    return cut.groupBy(*by).agg(
        F.sum("n").alias("in_band"), F.count(F.lit(1)).alias("distinct"), F.min(value).alias(lo), F.max(value).alias("hi")
    )


def _holding(bands: DataFrame, within: list[str]) -> DataFrame:
    """The bands that hold wanted ranks, with the number of rows before them."""
    before = Window.partitionBy(*within).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("in_band")
    return (
        bands.withColumn("start", F.col("start") + F.coalesce(F.sum("in_band").over(before), F.lit(0)))
        .withColumn("ranks", F.filter("ranks", lambda r: (r["rank"] >= F.col("start")) & (r["rank"] < end)))
        .where(F.size("ranks") > 0)
        .drop("cut", "in_band")
    )


def _inside(freq: DataFrame, pieces: DataFrame, key: str, value: str) -> DataFrame:
    """The values of the pieces. A key has a few pieces at most, so the join adds few rows
    to look at; Spark broadcasts them below its size threshold."""
    within = (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))
    return freq.join(pieces.drop("distinct"), key).where(within)


def _fences(quartiles: DataFrame) -> DataFrame:
    spread = FENCE * (F.col("q3") - F.col("q1"))
    return quartiles.withColumns({"lower_fence": F.col("q1") - spread, "upper_fence": F.col("q3") + spread})


def box_fences(df: DataFrame, *, key: str = "country", value: str = "daily_new_cases") -> DataFrame:
    """(key, q1, median, q3, lower_fence, upper_fence)."""
    freq = stage(frequencies(df, key=key, value=value))
    return _fences(exact_quantiles(freq, key=key, value=value, probs=QUARTILES))


def box_stats(df: DataFrame, *, key: str = "country", value: str = "daily_new_cases") -> DataFrame:
    """One box per key: quartiles, fences, whiskers (the extreme values within the
    fences), row and outlier counts."""
    freq = stage(frequencies(df, key=key, value=value))
    fences = _fences(exact_quantiles(freq, key=key, value=value, probs=QUARTILES))
    inside = F.col(value).between(F.col("lower_fence"), F.col("upper_fence"))
    box = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    return (
        freq.join(fences, key)
        .groupBy(key, *box)
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.sum("n").alias("n_rows"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
        )
    )


def box_outliers(
    df: DataFrame,
    *,
    key: str = "country",
    value: str = "daily_new_cases",
    columns: Sequence[str] | None = None,
    boxes: DataFrame | None = None,
) -> DataFrame:
    """The rows beyond the fences of their key. ``boxes``, from ``box_stats`` or
    ``box_fences`` over the same rows, spares finding the fences anew."""
    found = box_fences(df, key=key, value=value) if boxes is None else boxes
    fences = found.select(key, "lower_fence", "upper_fence")
    outside = (F.col(value) < F.col("lower_fence")) | (F.col(value) > F.col("upper_fence"))
    return df.join(fences, key).where(outside).select(*(columns or df.columns))
