"""Whole-text scores against all segmentations, with and without the table of common words."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseflow.llm import lattice

PIECES = [("a", 0.0), ("b", -1.0), ("ab", -2.0), ("▁", -3.0), ("▁a", -4.0), ("ba", -5.0), ("bab", -6.0)]
TEXTS = ["ab ba", "abab A", None, "", "b\tb ab", "xyb é", "ba " * 40, "once"] + ["ab ab ba"] * 30
DOC = "doc_id long, text string"


def splits(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        for rest in splits(word[n:]):
            yield [word[:n], *rest]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


@pytest.fixture
def models(monkeypatch):
    made = []

    class Kept(lattice.Pieces):
        def __init__(self, pieces):
            super().__init__(pieces)
            made.append(self)

    monkeypatch.setattr(lattice, "Pieces", Kept)
    monkeypatch.setattr(lattice, "read_pieces", lambda path: PIECES)
    return made


@pytest.mark.parametrize("common", [0, 2, 1000])
def test_text_scores_add_up_all_segmentations(spark, models, common):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, DOC).withColumns({"row": F.lit(1), "word": F.lit("w"), "base": F.lit("b")}).repartition(3)
    got = {r.doc_id: r for r in lattice.score(docs, "", common=common).collect()}
    kept = sorted(PIECES, key=lambda x: (-x[1], x[0]))
    log = {p: models[0].log[i] for i, (p, _) in enumerate(kept)}
    byte, end = models[0].log[len(kept)] - math.log(256), models[0].log[len(kept) + 1]

    def lattice_log(word):
        total = 0.0
        for split in splits("▁" + word):
            p = 0.0
            for piece in split:
                if piece in log:
                    p += log[piece]
                elif len(piece) == 1:
                    p += byte * len(piece.encode())
                else:
                    p = -math.inf
            total += math.exp(p)
        return math.log(total) + end

    words = lambda t: (t or "").lower().split()
    taught, texts = Counter(), 0
    for i, t in rows:
        if not held_out(i):
            taught.update(words(t))
            texts += 1
    tokens, once = sum(taught.values()) + texts, sum(n == 1 for n in taught.values()) + (texts == 1)
    escape = min(0.5, max(1, once) / (tokens + 1))
    assert len(got) == len(rows)
    for i, t in rows:
        expected = math.log10((1 - escape) * texts / tokens)
        for w in words(t):
            expected += math.log10((1 - escape) * taught[w] / tokens + escape * math.exp(lattice_log(w)))
        r = got[i]
        assert r.score == pytest.approx(expected, rel=1e-9) and r.held_out == held_out(i)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words(t)) + 1, sum(w in taught for w in words(t)) + 1, tokens)


def test_null_and_repeated_ids_are_rows_of_their_own(spark, models):
    rows = [(None, "ab x"), (None, "ab x"), (7, "rare words here"), (7, "rare words here"), (7, "")]
    got = sorted((str(r.doc_id), r.n_tokens) for r in lattice.score(spark.createDataFrame(rows, DOC), "", common=1).collect())
    assert got == [("7", 1), ("7", 4), ("7", 4), ("None", 3), ("None", 3)]
