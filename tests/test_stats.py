from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow import operators as op
from caseflow.operators import stats
from caseflow.operators.stats import QUARTILES, frequencies

from conftest import ordered, plan, rows

RNG = np.random.default_rng(3)
SERIES = {
    "ints": [int(x) for x in RNG.integers(0, 10**9, 501)],
    "ties": [3] * 400 + [7] * 99 + [10**12],
    "signed": [float(x) for x in RNG.normal(0, 50, 200)],
    "one": [42.0],
    "two": [1.0, 2.0],
    "zeros": [0.0] * 10,
    "skewed": [float(x) for x in np.exp(RNG.normal(0, 4, 300))],
}


@pytest.fixture(scope="module")
def df(spark):
    data = [(k, float(v)) for k, vs in SERIES.items() for v in vs] + [("ints", None), (None, 5.0)]
    return spark.createDataFrame(data, "country string, v double").repartition(6)


def test_quantiles_are_exact(df):
    probs = {**QUARTILES, "p0": 0.0, "p99": 0.99, "p100": 1.0}
    out = op.exact_quantiles(frequencies(df, key="country", value="v"), key="country", value="v", probs=probs)
    found = {r["country"]: [r[p] for p in probs] for r in out.collect()}
    assert found.keys() == SERIES.keys()
    for name, values in SERIES.items():
        assert found[name] == pytest.approx(list(np.quantile(values, list(probs.values()))), rel=1e-12, abs=1e-12)


def brute_box(values):
    q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in values if low <= v <= high]
    return q1, median, q3, low, high, min(inside), max(inside), len(values), len(values) - len(inside)


def test_boxes(df):
    for r in op.box_stats(df, value="v").collect():
        assert tuple(r)[1:] == pytest.approx(brute_box(SERIES[r["country"]]), rel=1e-9, abs=1e-9), r["country"]


def test_outliers_are_the_rows_beyond_the_fences(df):
    expected = [(k, v) for k, vs in SERIES.items() for v in map(float, vs) if not brute_box(vs)[3] <= v <= brute_box(vs)[4]]
    assert ordered(rows(op.box_outliers(df, value="v"))) == ordered(expected)


def test_integer_values(spark):
    df = spark.createDataFrame([("A", v) for v in (0, 1, 2, 3, 100)], "country string, v bigint")
    assert rows(op.box_stats(df, value="v")) == [("A", 1.0, 2.0, 3.0, -2.0, 6.0, 0, 3, 5, 1)]


def test_frequencies_are_counted_once(df):
    counted = df.groupBy("country", "v").count().select("country", "v")
    out = op.box_stats(counted, value="v")
    out.collect()
    final = plan(out)
    assert "percentile" not in final and "collect_list" not in final
    # they are stored, and every use reads the store
    assert "ExistingRDD" in plan(counted) and "ExistingRDD" not in final and "FileScan" in final


def test_nan_is_the_greatest_value(spark):
    nan, inf = float("nan"), float("inf")
    rows_ = [("A", v) for v in (1.0, 2.0, -3.0, nan, 5.0)] + [("B", v) for v in (nan, nan, 1.0)] + [("C", v) for v in (-inf, inf, inf, 0.0, -0.0)]
    df = spark.createDataFrame(rows_, "country string, v double")
    out = op.exact_quantiles(frequencies(df, key="country", value="v"), key="country", value="v", probs=QUARTILES)
    found = {r.country: tuple(map(str, r[1:])) for r in out.collect()}
    builtin = {r.country: tuple(map(str, r.p)) for r in df.groupBy("country").agg(F.percentile("v", list(QUARTILES.values())).alias("p")).collect()}
    assert found["A"] == ("1.0", "2.0", "5.0") == builtin["A"]
    assert found["B"] == ("nan", "nan", "nan") == builtin["B"] and found["C"] == ("0.0", "0.0", "inf")
    boxes = {r.country: r for r in op.box_stats(df, value="v").collect()}
    assert (boxes["A"].q1, boxes["A"].median, boxes["A"].q3, boxes["A"].n_rows, boxes["A"].n_outliers) == (1.0, 2.0, 5.0, 5, 1)


def pieces_of(monkeypatch):
    """The tables that the search stores, level by level."""
    kept, real = [], stats.stage
    monkeypatch.setattr(stats, "stage", lambda df: kept.append(real(df)) or kept[-1])
    return kept


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_a_band_of_many_values_is_cut_until_it_is_small(spark, monkeypatch, kind):
    values = {
        "near": [10**9 + i for i in range(5000)],
        "far": [2**62 + i * 3 for i in range(3000)] if kind == "bigint" else [1e18 + i * 256.0 for i in range(3000)],
        "clustered": [10**9 + (i if i < 4000 else i * 100) for i in range(4500)],
        "negative": [-(10**6) - i for i in range(2000)],
        "ties": [10**9 + i // 50 for i in range(5000)],
    }
    df = spark.createDataFrame([(k, int(v) if kind == "bigint" else float(v)) for k, vs in values.items() for v in vs], f"country string, v {kind}")
    kept = pieces_of(monkeypatch)
    out = op.exact_quantiles(frequencies(df, key="country", value="v"), key="country", value="v", probs=QUARTILES, piece=40)
    found = {r.country: tuple(r[1:]) for r in out.collect()}
    for name, vs in values.items():
        assert found[name] == pytest.approx(tuple(np.quantile(np.array(vs, dtype=np.longdouble), [0.25, 0.5, 0.75]).astype(float)), rel=1e-15)
    assert len(kept) > 1 and kept[-1].agg(F.max("distinct")).first()[0] <= 40


def test_a_million_values_of_one_size(spark, monkeypatch):
    df = spark.range(1_000_000).select(F.lit("A").alias("country"), (F.col("id") * 7 % 1_000_000 + 10**12).alias("v"))
    kept = pieces_of(monkeypatch)
    box = op.box_stats(df, value="v").first()
    assert (box.q1, box.median, box.q3, box.n_rows, box.n_outliers) == (10**12 + 249999.75, 10**12 + 499999.5, 10**12 + 749999.25, 10**6, 0)
    assert kept[-1].agg(F.max("distinct")).first()[0] <= stats.PIECE
