"""Exact top-k: beyond doubles, hot copies, and how much the bounds rule out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import topk


def brute(ids, vectors, k, is_query):
    scores = [[int(sum(int(a) * int(b) for a, b in zip(x, y, strict=True))) for y in vectors] for x in vectors]
    out = set()
    for q, i in enumerate(ids):
        if is_query(i):
            best = sorted((-scores[q][c], j) for c, j in enumerate(ids) if j != i)[:k]
            out |= {(int(i), n, int(j), -s) for n, (s, j) in enumerate(best, 1)}
    return out


def result(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


def test_scores_beyond_doubles_are_exact(spark):
    draw = np.random.default_rng(1)
    vectors = [[int(x) for x in draw.integers(2**21, 2**22, 6)] for _ in range(60)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = brute(range(60), [[64 * x for x in v] for v in vectors], 5, lambda i: i % 20 == 0)
    assert max(s for *_, s in expected) > 2**53
    assert result(topk.top_k(table, F.col("vec_id") % 20 == 0, k=5)) == expected


def test_scores_beyond_64_bits_fail(spark):
    for value in (2.0**30, 1e300):
        table = spark.createDataFrame([(i, [value, value]) for i in range(3)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(table, F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("size", [5, 4096])
def test_clusters_parts_and_copies(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "BLOCK", size)
    monkeypatch.setattr(topk, "QUERIES", size)
    monkeypatch.setattr(topk, "SAMPLE", 30)
    monkeypatch.setattr(topk, "PIVOTS", 7)
    draw = np.random.default_rng(2)
    vectors = [list(map(int, draw.integers(-20, 20, 4) + 50 * (i % 3))) for i in range(120)]
    vectors += [vectors[7]] * 80 + [[0] * 4] * 3
    ids = list(range(len(vectors)))
    table = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    assert result(topk.top_k(table, F.col("vec_id") % 5 == 0, k=4)) == brute(ids, vectors, 4, lambda i: i % 5 == 0)


def test_one_hot_vector_is_sampled_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 10)
    table = spark.range(400).select(F.lit(3).cast("long").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    table = table.union(spark.createDataFrame([(20, [2.0, 1.0])], "vec_id long, embedding array<double>"))
    got = topk.top_k(table, F.col("vec_id") % 20 == 0, k=6).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(20, 3, 4 * 64 * 64)] * 6


def evaluated(vectors, n_queries, k=20):
    pivots = topk._pivots(vectors[::4].astype(np.float64), topk.PIVOTS)
    block = topk.Block(np.arange(len(vectors)), vectors, pivots)
    q, ids = vectors[:n_queries], np.arange(n_queries)
    place, found, scores, pairs = topk.search_block(ids, q, np.full(n_queries, topk.NONE), block, pivots, k)
    whole = q @ vectors.T
    whole[ids, ids] = -(10**15)
    for i in range(n_queries):
        order = np.lexsort((np.arange(len(vectors)), -whole[i]))[:k]
        assert found[place == i].tolist() == order.tolist() and scores[place == i].tolist() == whole[i][order].tolist()
    return pairs / (n_queries * len(vectors))


def test_bounds_rule_out_most_of_clustered_vectors_and_little_of_noise():
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 60, (40, 32))
    clustered = np.floor(centres[draw.integers(0, 40, 4000)] + draw.normal(0, 3, (4000, 32))).astype(np.int64)
    noise = np.floor(draw.normal(0, 60, (4000, 32))).astype(np.int64)
    share = evaluated(clustered, 100), evaluated(noise, 100)
    print("evaluated: clustered", share[0], "noise", share[1])
    assert share[0] < 0.2 and share[1] <= 1
