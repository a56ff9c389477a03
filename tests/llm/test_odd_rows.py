"""Null and repeated ids, very long texts, clashing columns, short items, long conversations."""

from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseflow.llm import chat, decontaminate, langid, quality

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the people of the town would often walk along the river in the evening and talk about the weather"
GERMAN = "die leute aus der stadt gingen oft am abend den fluss entlang und sprachen dabei über das wetter"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOC)


def learnable(n=200):
    return [(4 * k, f"{ENGLISH} {k}" if k % 2 else f"{GERMAN} {k}", "en" if k % 2 else "de") for k in range(n)]


def test_only_letters_make_a_language(spark):
    odd = ["²½ ³", "12 _ !", "ª", "日", "é"]
    docs = documents(spark, learnable() + [(10_000 + i, t, None) for i, t in enumerate(odd)] + [(None, None, "en"), (20_000, "", "en"), (20_001, ENGLISH * 3000, None)])
    docs = docs.withColumns({"lang_pred": F.lit("x"), "profile": F.lit(1), "nth": F.lit(2)})
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [got[10_000 + i].lang_pred == "und" for i in range(5)] == [True, True, False, False, False]
    assert got[None].lang_pred == got[20_000].lang_pred == "und" and got[20_001].lang_pred == "en"
    assert sum(r.lang_pred == ("en" if i // 4 % 2 else "de") for i, r in got.items() if i is not None and i < 800) > 190


class Seen(Exception):
    pass


def test_language_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    rows = [(None, ENGLISH, "en")] * 3000 + [(None, f"{GERMAN} {k}", "de") for k in range(3000)] + [(4, ENGLISH, "en")] * 3000
    monkeypatch.setattr(langid, "SAMPLE", 100)

    def stop(x, langs):
        raise Seen(len(langs), langs.count("en"), langs.count("de"))

    monkeypatch.setattr(langid, "Model", stop)
    with pytest.raises(Seen) as found:
        langid.identify(documents(spark, rows))
    total, en, de = found.value.args
    assert en <= 100 and 20 <= de <= 100 and total == en + de


def test_quality_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    labels = spark.createDataFrame([(4 * k, k % 2) for k in range(300)] + [(None, 1)], "doc_id long, quality int").withColumn("row", F.lit(1))
    rows = [(4, f"{ENGLISH} {k}", "en") for k in range(4000)] + [(4 * k, ENGLISH if k % 2 else "x x x", "en") for k in range(300)] + [(None, ENGLISH, "en")] * 50
    monkeypatch.setattr(quality, "SAMPLE", 60)

    def stop(self, x, y, **options):
        raise Seen(len(x))

    monkeypatch.setattr(quality.Machine, "fit", stop)
    with pytest.raises(Seen) as found:
        quality.rate(documents(spark, rows), labels)
    assert 20 <= found.value.args[0] <= 120


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4 * k, k % 2) for k in range(200)] + [(4, None), (None, 0)], "doc_id long, quality int")
    rows = [(4 * k, f"{ENGLISH} {k}" if k % 2 else "$$ # 1 2 3", "en") for k in range(200)] + [(None, None, None), (7, "", "x"), (7, "", "x"), (9, ENGLISH * 2000, "en")]
    docs = documents(spark, rows).withColumns({"quality": F.lit(5), "score": F.lit("s"), "nth": F.lit(1), "predicted": F.lit(3)})
    got = quality.rate(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.rate(docs.limit(0), labels).count() == 0


def test_short_items_are_found_whole(spark):
    items = [(1, "hello"), (2, "hello world"), (3, "one two three four"), (4, "Zebra"), (5, None), (None, "good bye now friend"), (7, " ")]
    texts = [(1, "well hello world again"), (2, "say hello"), (3, "world hello"), (4, "one two three four"), (5, "zebras"), (6, None), (None, "hello world"),
             (8, ("filler " * 20_000) + "a zebra one two three four")]
    docs = documents(spark, [(i, t, "en") for i, t in texts]).withColumns({"item_id": F.lit("x"), "place": F.lit(1), "seed": F.lit(2)})
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("y"))
    got = sorted((str(r.doc_id), r.item_id, r.score, r.start_word, r.end_word) for r in decontaminate.contaminated(docs, benchmark).collect())
    assert got == sorted([("1", 1, 1.0, 1, 2), ("1", 2, 1.0, 1, 3), ("2", 1, 1.0, 1, 2), ("3", 1, 1.0, 1, 2), ("4", 3, 1.0, 0, 4), ("None", 1, 1.0, 0, 1),
                          ("None", 2, 1.0, 0, 2), ("8", 4, 1.0, 20_001, 20_002), ("8", 3, 1.0, 20_002, 20_006)])


def test_long_conversations_are_formatted_in_bearable_time():
    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k} </s> says something of its own") for k in range(3000)]
    start = time.time()
    text, found, loss, rewritten = chat.spans(turns, chat.marked, frozenset({"assistant"}))
    assert time.time() - start < 60 and not rewritten and len(found) == 3000 and len(loss) == 1500
    assert [chat.read_turn(text[a:b]) for a, b in found] == turns


def test_rendered_turns_are_forgotten_beyond_their_bound(monkeypatch):
    monkeypatch.setattr(chat, "_PIECES", type(chat._PIECES)())
    chat._PIECES.most = 1000
    whole = chat.marked([("user", "x" * 90 + str(k)) for k in range(50)])
    assert len(chat._PIECES) < 12 and whole.count("<s>") == 50


def distinct(spark, rows):
    docs = documents(spark, rows).withColumn("component_id", F.lit("clash")).drop("component_id")
    return corpus_pipeline.distinct(spark, docs, "").collect()


def test_pipeline_keeps_different_texts_whatever_their_ids(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    near = words(3) + " and one more"
    rows = [(None, words(0), "en"), (None, words(1), "en"), (7, words(2), "en"), (7, words(3), "en"), (9, near, "en"), (9, near, "en"), (None, words(2), "en")]
    kept = sorted((str(r.doc_id), hashlib.md5(r.text.encode()).hexdigest()) for r in distinct(spark, rows))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    # words(2) is met twice: the row without an id goes before 7; of words(3) and its near copy 7 stays
    assert kept == sorted([("None", md5(words(0))), ("None", md5(words(1))), ("None", md5(words(2))), ("7", md5(words(3)))])


def test_pipeline_stages_take_odd_and_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(4 * k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = learnable() + [(None, None, None), (None, "", "en"), (None, ENGLISH, None), (5, ENGLISH * 500, "en"), (5, GERMAN + " one two three four five six", "de")]
    for name, taken in (("some", rows), ("none", [])):
        docs = documents(spark, taken)
        for stage_name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, sf)
            assert out.columns == docs.columns, stage_name
            assert out.count() <= len(taken), (name, stage_name)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(taken)
