"""Links of a similarity join: all of them are counted, those of rows without an id too."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from caseflow.llm import jaccard


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = t.split()
        out.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))))
    return out


def linked(x, y):
    return x != y and 4 * len(x & y) >= 3 * len(x | y)


def test_every_link_within_large_groups_is_counted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    draw = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):
        copy = list(base)
        for at in draw.sample(range(120), draw.randint(0, 4)):
            copy[at] = f"x{k}_{at}"
        texts.append(" ".join(copy))
    texts += texts[:5] + ["other words than those of the copies above"]
    sets = sets_of(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.n_links for r in jaccard.similar(docs).collect()}
    assert found == {i: len({y for y in sets if linked(x, y)}) for i, x in enumerate(sets)}


def test_rows_without_an_id_link(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join(words[5:] + ["z"])
    rows = [(3, " ".join(words)), (None, near), (7, " ".join(words[12:] + ["z", "y"])), (8, "nothing like it at all here"), (None, None)]
    sets = sets_of([t for _, t in rows[:3]])
    assert linked(sets[0], sets[1]) and linked(sets[1], sets[2])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.component_id, r.n_links) for r in jaccard.similar(docs).collect()]
    direct = int(linked(sets[0], sets[2]))
    assert sorted(found, key=str) == sorted([(3, 3, 1 + direct), (None, 3, 2), (7, 3, 1 + direct), (8, 8, 0), (None, None, 0)], key=str)


def test_sets_are_sent_to_their_pairs_and_not_stored(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(jaccard, "stage", lambda df, put=jaccard.stage: stored.append(df.columns) or put(df))
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words[i : i + 60]) for i in range(4)] * 2 + ["nothing like it at all here"]
    rows = [*enumerate(texts), (0, "another text of a repeated id"), (0, texts[0])]
    sets = sets_of([t for _, t in rows])
    found = sorted((r.doc_id, r.n_links) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == sorted((i, len({y for y in sets if linked(x, y)})) for (i, _), x in zip(rows, sets, strict=True))
    assert stored and not any("tokens" in columns for columns in stored)


def test_unrelated_long_sets_are_ruled_out_by_their_parities():
    draw = np.random.default_rng(5)
    x, y = (np.sort(draw.integers(0, 2**63, 5000).astype(np.uint64)) for _ in range(2))
    near, few = np.sort(np.concatenate([x[:4800], y[:200]])), x[:3800]
    tokens = np.concatenate([x, y, near, few])
    sizes = np.array([len(x), len(y), len(near), len(few)])
    parity = np.array([*jaccard.parities(tokens, np.concatenate([[0], np.cumsum(sizes)])), None], object)[:4]
    assert len(parity[0]) == 2 * len(parity[3])  # of more bins those that fall together are added
    first, other = np.array([0, 0, 0]), np.array([1, 2, 3])
    assert jaccard.plausible(sizes[first], sizes[other], parity[first], parity[other], jaccard.Bands(3, 4)).tolist() == [False, True, True]


def test_members_of_open_groups_are_compared_once_and_all(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 9)
    draw = np.random.default_rng(6)
    base = draw.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.sort(np.concatenate([base[: 100 - k], draw.integers(0, 2**63, k).astype(np.uint64)])) for k in range(40)]
    parity = jaccard.parities(np.concatenate(sets), np.arange(0, 4001, 100))
    groups = spark.createDataFrame([(s, 7, [*range(40)][s % 3 :]) for s in range(6)] + [(9, 8, [50, 51])], "a long, b long, members array<long>")
    merged = jaccard._merged(groups)
    assert merged.count() == merged.select("id").distinct().count() == 42  # six lists alike are one
    traits = spark.createDataFrame([(i, i // 10, 100, bytes(parity[i])) for i in range(40)], "id long, root long, n long, parity binary")
    flat = merged.where("id < 50").withColumn("size", F.lit(40).cast("long")).join(traits, "id")
    found = {(r.a, r.b) for r in jaccard._across(flat, jaccard.Bands(3, 4)).collect()}
    size, ids = np.array([100]), range(40)
    lone = [np.array([p], object) for p in parity]
    expected = {(i, j) for i in ids for j in ids if i < j and i // 10 != j // 10 and jaccard.plausible(size, size, lone[i], lone[j], jaccard.Bands(3, 4))[0]}
    assert found == expected and (9, 10) in found


def test_open_groups_give_the_links_that_join_their_components_alone(spark, monkeypatch):
    made = []
    monkeypatch.setattr(jaccard, "SMALL", 1)
    monkeypatch.setattr(jaccard, "_across", lambda *given, run=jaccard._across: made.append(run(*given)) or made[-1])
    draw = random.Random(3)
    base = [f"w{i}" for i in range(150)]

    def copy(k, changes):
        words = list(base)
        for at in draw.sample(range(150), changes):
            words[at] = f"x{k}_{at}"
        return " ".join(words)

    # stars are around the smallest hashes: here copies too far from all others
    far = [copy(k, 6) for k in range(2000)]
    order = np.argsort(jaccard.set_ids(*jaccard.shingle_sets(far, 5)))[:12].tolist()
    texts = [copy(k + 2000, 2) for k in range(100)] + [far[k] for k in order]
    sets = sets_of(texts)
    partners = [{j for j, y in enumerate(sets) if linked(x, y)} for x in sets]
    found = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    least = {}
    for i in range(len(sets)):
        open_ = [i]
        while open_:
            if (x := open_.pop()) not in least:
                least[x] = i
                open_ += partners[x]
    assert found == {i: (least[i], len({sets[j] for j in partners[i]})) for i in range(len(sets))}
    assert sum(map(len, partners)) > 9000  # in both directions
    assert len(made) == 1 and 0 < made[0].count() < len(sets)


def test_a_meeting_of_blocks_gives_no_more_links_than_join_its_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 40 * 100 * 8 // 3)
    draw = np.random.default_rng(8)
    base = draw.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.sort(np.concatenate([base[: 100 - k % 20], draw.integers(0, 2**63, k % 20).astype(np.uint64)])) for k in range(40)]
    parity = jaccard.parities(np.concatenate(sets), np.arange(0, 4001, 100))
    flat = spark.createDataFrame([(5, 7, 40, i, i // 2, 100, bytes(parity[i])) for i in range(40)], "a long, b long, size long, id long, root long, n long, parity binary")
    tokens = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "id long, tokens binary")
    bands = jaccard.Bands(3, 4)
    bounded = {(r.a, r.b) for r in jaccard._across(flat, bands).collect()}
    found = {(r.a, r.b) for r in jaccard._across(flat, bands, tokens).collect()}
    assert found <= {(i, j) for i, j in bounded if jaccard._linked(sets[i], sets[j], 3, 4) and i // 2 != j // 2}

    def roots(edges):
        label = [i // 2 for i in range(40)]
        for i, j in edges:
            label = [label[i] if at == label[j] else at for at in label]
        return [label.index(at) for at in label]

    assert len(bounded) > 400 and len(found) <= 6 * 19  # three blocks, six meetings, twenty components
    assert roots(found) == roots((i, j) for i, j in bounded if jaccard._linked(sets[i], sets[j], 3, 4))


def rows_of_joins(df, on):
    """Rows made by each inner join of two columns of this name, when ``df`` runs."""
    df.collect()
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(node.plan())
        else:
            if re.search(rf"Join \[{on}#\d+L?\], \[{on}#\d+L?\], Inner", node.simpleString(200)):
                found.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_members_of_many_groups_are_joined_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(jaccard, "SMALL", 1)
    monkeypatch.setattr(jaccard, "stage", lambda df, put=jaccard.stage: made.extend(rows_of_joins(df, "id")) or put(df))
    draw = random.Random(3)
    base = [f"w{i}" for i in range(150)]

    def copy(k, changes):
        words = list(base)
        for at in draw.sample(range(150), changes):
            words[at] = f"x{k}_{at}"
        return " ".join(words)

    # the smallest hashes, around which the stars are, belong to copies too far from all others
    far = [copy(k, 6) for k in range(2000)]
    order = np.argsort(jaccard.set_ids(*jaccard.shingle_sets(far, 5)))[:12].tolist()
    texts = [copy(k + 2000, 2) for k in range(60)] + [far[k] for k in order]
    sets = sets_of(texts)
    found = {r.doc_id: r.n_links for r in jaccard.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {i: len({y for y in sets if linked(x, y)}) for i, x in enumerate(sets)}
    assert made and max(made) <= len(set(sets))
