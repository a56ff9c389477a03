"""Divergence of sources and terms against a plain computation, and the skybands alone."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import divergence

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, smallest=3, top=200):
    """The report straight from its definition, in whole numbers of any size."""
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = terms(text)
        count[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= smallest]
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})

        def parts(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: parts(count[lang, s]) for s in sources}, parts(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            alone = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(alone)[:top])):
                out += [(lang, s, part, item, -v, n) for n, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def corpus(seed, n=400):
    draw = random.Random(seed)
    names = [draw.choice("abcdefgé") * draw.randint(1, 3) + draw.choice(["x", "Ü", "日本", "ab", ""]) for _ in range(60)]
    sources = ["s1", "s2", "s3", None, "", "Z"]
    for i in range(n):
        source = "s1" if i % 3 == 0 else draw.choice(sources)
        text = draw.choice([" ", "-", "1", " "]).join(draw.choice(names[: 10 + 10 * (hash(source or "") % 5)]) for _ in range(draw.randint(0, 30)))
        yield draw.choice([text, text, text.upper(), None if i % 9 == 0 else text]), draw.choice(["en", "en", "de", None]), source


@pytest.mark.parametrize(("top", "piece"), [(200, 50_000), (3, 4)])
def test_equals_brute_force(spark, top, piece):
    rows = list(corpus(1))
    rows += [("only here", "fr", "a"), ("", "fr", "b"), (None, "xx", "a"), ("   12 ", "xx", "b"), ("Word word WORD", "one", "alone")] + [("rep eat", "one", "alone")] * 5
    docs = spark.createDataFrame([(None if i % 5 == 0 else i % 7, *r, 0) for i, r in enumerate(rows)], DOC).repartition(5)
    docs = docs.withColumns({"term": F.lit("x"), "n": F.lit(1), "rank": F.lit(2), "item": F.lit("y")})
    assert result(divergence.divergence(docs, top=top, piece=piece)) == brute(rows, top=top)


def test_empty_table(spark):
    out = divergence.divergence(spark.createDataFrame([], DOC))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "Ab  c-dÉ é 日本x1Y " * 50 + "z" * 500
    expected = [w.encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    for chunk in (1, 7, 100, 1 << 20):
        assert [w for part in divergence.words(text, chunk) for w in part] == expected


@pytest.mark.parametrize("seed", range(6))
def test_skyband_keeps_what_fewer_than_k_dominate(seed):
    draw = np.random.default_rng(seed)
    n, k = 900, int(draw.integers(1, 12))
    group, whole = draw.integers(0, 12 if seed % 2 else 10**6, n), draw.integers(0, 12 if seed % 2 else 10**6, n)
    name = draw.permutation(n)
    kept = set(divergence.skyband(group, whole, name, k).tolist())
    dominators = ((group[:, None] >= group) & (whole[:, None] <= whole) & (name[:, None] < name)).sum(axis=0)
    assert kept == set(np.flatnonzero(dominators < k).tolist())
    order = np.lexsort((name, whole, -group))  # whatever the exact values, the first k by a rule that respects all three are kept
    assert set(order[:k].tolist()) <= kept


def test_large_groups_are_merged_from_pieces(spark):
    points = spark.range(4000).select(
        F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("source"),
        F.concat(F.lit("t"), F.col("id")).alias("term"), (F.col("id") * 7919 % 997).alias("n"), (F.col("id") * 104729 % 499).alias("whole"),
    )
    left = divergence.merged_skybands(points, 5, piece=200).collect()
    assert 10 < len(left) < 1500
    for source in ("hot", "b"):
        mine = [r for r in points.collect() if r.source == source]
        keep = {r.term for r in left if r.source == source}
        for r in mine:
            if sum(o.n >= r.n and o.whole <= r.whole and o.term < r.term for o in mine) < 5:
                assert r.term in keep


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.smoothed(F.lit(20 * 10**12), F.lit(2 * 10**13), F.lit(10**9)).alias("p"), divergence.gap(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long")).alias("g")).first()
    assert row.p == 1 + 10**9 * (20 * 10**12 + 1) // (2 * 10**13 + 10**9) and row.g == 10**18


def test_grid_rules_out_most_points_and_only_dominated_ones():
    draw = np.random.default_rng(8)
    whole, name = draw.integers(1, 400, 4000), draw.permutation(4000)
    grid = divergence.Grid(whole, name)
    added, asked = np.arange(0, 3000), np.arange(3000, 4000)
    grid.add(added)
    least = grid.least(asked)
    exact = ((whole[added][:, None] <= whole[asked]) & (name[added][:, None] < name[asked])).sum(axis=0)
    assert (least <= exact).all()
    assert (least >= 200).sum() > 0.9 * (exact >= 200).sum()


def test_skyband_of_many_points_with_equal_counts():
    draw = np.random.default_rng(9)
    group, name = draw.integers(1, 6, 3000), draw.permutation(3000)
    whole = group + draw.integers(0, 4, 3000)
    for k in (1, 20, 200):
        before = (group[:, None] >= group) & (whole[:, None] <= whole) & (name[:, None] < name)
        assert sorted(divergence.skyband(group, whole, name, k).tolist()) == np.flatnonzero(before.sum(axis=0) < k).tolist()
