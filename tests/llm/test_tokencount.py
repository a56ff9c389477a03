"""Token counts by transducer against the library, whole and in chunks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caseflow.llm import tokencount
from caseflow.llm.queries import op11_token_counts, vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def pieces():
    return tokencount.read_pieces(MODEL)


def odd_texts(pieces, n):
    draw, names = random.Random(5), list(pieces)
    for k in range(n):
        if k % 4 == 0:
            yield "".join(draw.choice(names).replace("▁", " ") for _ in range(draw.randint(0, 12)))
        elif k % 4 == 1:
            yield "".join(draw.choice("  aeinrst\n\t▁,.<0x>é日本ｱ😀\x00") for _ in range(draw.randint(0, 40)))
        elif k % 4 == 2:
            yield "".join(draw.choice("aaaeeerstnio  ") for _ in range(draw.randint(0, 60)))
        else:
            yield " " * draw.randint(0, 70) + draw.choice(["", "a", "the", "\n"]) + " " * draw.randint(0, 40) + "x"


def test_machine_and_its_state_maps_equal_the_library(pieces, library):
    machine, small = tokencount.Machine(pieces), tokencount.Machine(pieces, most=50)
    for n, text in enumerate(odd_texts(pieces, 3000)):
        expected = len(library.encode(text))
        assert machine.count(text) == expected, text
        whole = tokencount.written(text)
        assert machine.run(machine.start, whole)[1] == expected
        if n % 20 == 0:  # states are dropped and compiled anew
            assert small.count(text) == expected
        if whole:
            maps = [machine.state_map(whole[i : i + 1 + n % 9]) for i in range(0, len(whole), 1 + n % 9)]
            maps = [machine.unpacked(machine.packed(m)) for m in maps]
            assert machine.apply(machine.reduce(maps)) == expected
            prefixes = machine.scan(maps)
            assert machine.apply(prefixes[-1]) == expected and len(prefixes) == len(maps)


def test_two_tokens_agree_as_encoding_says(pieces):
    machine, draw = tokencount.Machine(pieces), random.Random(2)
    names = [p for p in pieces if p.isascii()]
    for _ in range(5000):
        left, right = draw.choice(names), draw.choice(names)
        *_, tokens = tokencount.merges(left + right, pieces)
        assert machine.agree(left, right) == (tokens == [left, right])


def test_scan_gives_every_prefix(pieces):
    machine = tokencount.Machine(pieces)
    text = tokencount.written("the quick brown fox jumps over it all " * 4)
    cuts = [text[i : i + 10] for i in range(0, len(text), 10)]
    prefixes = machine.scan([machine.state_map(c) for c in cuts])
    assert [machine.apply(p) for p in prefixes] == [machine.run(machine.start, text[: 10 * (i + 1)])[1] for i in range(len(cuts))]


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_whole_tables_with_odd_rows(spark, library, pieces, chunk):
    texts = [None, "", " ", "<s>a</s>", "a" * 5000, "word " * 30_000, "x", "x", *odd_texts(pieces, 200)]
    texts = texts if chunk > 7 else [t and t[:2000] for t in texts]
    rows = [(None if i % 7 == 3 else i % 50, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "no": F.lit(1), "map": F.lit("m"), "n_bytes": F.lit("b")})
    got = sorted(tokencount.token_counts(docs, MODEL, limit=100, chunk=chunk).collect(), key=str)
    counts = [len(library.encode(t or "")) for t in texts]
    expected = [(i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, counts, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    empty = tokencount.token_counts(docs.limit(0), MODEL, chunk=chunk)
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and empty.count() == 0


def test_query_equals_library_on_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
