"""The training-data operators against brute force, libraries and planted cases, with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import bpe, chat, decontaminate, html, jaccard, langid, lattice, licences, quality, topk
from caseflow.llm.queries import vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, langs=None):
    """Documents numbered from 0, with columns whose names the operators use inside."""
    rows = [(i, t, None if langs is None else langs[i], "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).withColumn("id", F.lit("x")).withColumn("word", F.lit(1)).withColumn("block", F.lit("b"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_chat_digests_and_odd_rows(spark):
    told = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "[INST]<\\/s></s>"), (2, 0, None, ""), (2, 1, "tool", "[/ROLE] [NAME] x"),
        (None, None, "assistant", "a"), (None, None, "assistant", "a"), (3, 0, "assistant", "é😀" * 50),
    ]
    rows = spark.createDataFrame(told, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(rows)).collect()}
    assert len(got) == 4
    for conv, r in got.items():
        turns = sorted((x for x in told if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        whole = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        said = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_chat_escape_is_reversible_and_leaves_no_control_string():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice(["<", "\\", "/s>", "s>", "[", "INST]", "/INST]", " a", "]"]) for _ in range(12))
        assert chat.unescape(chat.escape(text)) == text
        assert not re.search(r"</?s>|\[/?(INST|SYS|BOT|ROLE|NAME)\]", chat.escape(text))


def test_chat_finds_templates_that_rewrite_history():
    def forgetful(turns):
        return "".join(f"<{r}>{'' if r == 'think' and k < len(turns) - 1 else t};" for k, (r, t) in enumerate(turns))

    *_, rewritten = chat.spans([("user", "a"), ("think", "b"), ("assistant", "c")], forgetful, frozenset(["assistant"]))
    text, turns, loss, _ = chat.spans([("user", "a"), ("think", "b"), ("assistant", "c")], forgetful, frozenset(["assistant"]))
    assert rewritten == [2]
    assert [text[a:b] for a, b in loss] == ["c"]
    assert chat.spans([("user", "a"), ("assistant", "b")], chat.marked, frozenset())[3] == []


def test_language_held_out_and_odd_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = docs(spark, [None, "", "12 34 ###", "x"]).select(*rows.columns).withColumn("doc_id", -F.col("doc_id") - 1)
    got = langid.identify(rows.union(odd)).join(rows.union(odd).select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == rows.count() + 4
    held = [r for r in got if r.held_out and r.doc_id >= 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id < 0}
    assert [odd[i] for i in (-1, -2, -3)] == [("und", 0.0)] * 3
    assert odd[-4][0] != "und"
    assert langid.identify(rows.limit(0)).count() == 0


def test_quality_held_out_and_odd_texts(spark):
    folder = "/root/testdata/sf0.01"
    rows, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    odd = docs(spark, [None, ""]).select(*rows.columns).withColumn("doc_id", -F.col("doc_id") - 1)
    noisy = labels.union(spark.createDataFrame([(None, 1, 0), (10**9, 0, 0), (5, None, None)], labels.schema))
    got = quality.rate(rows.union(odd), noisy)
    assert got.count() == rows.count() + 2
    assert got.where("score not between 0 and 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    known = got.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in known) / len(known) > 0.95
    assert {r.score for r in quality.rate(rows.limit(3), labels.limit(0)).collect()} == {0.5}
    assert quality.rate(rows.limit(0), labels).count() == 0


def test_factorisation_identity():
    machine = quality.Machine(6)
    machine.w[:] = np.arange(6)
    x = np.random.default_rng(0).normal(size=(3, 6))
    pairs = sum((machine.v[i] @ machine.v[j]) * x[:, i] * x[:, j] for i, j in itertools.combinations(range(6), 2))
    assert np.allclose(machine.logits(x), x @ machine.w + pairs)


def test_lattice_equals_brute_force_over_segmentations():
    pieces = lattice.Pieces([("a", 0.0), ("b", -1.0), ("ab", -2.0), ("▁", -3.0), ("▁a", -4.0), ("ba", -5.0)])
    names = ["a", "b", "ab", "▁", "▁a", "ba"]

    def total(text):
        if not text:
            return 1.0
        return sum(math.exp(pieces.log[i]) * total(text[len(p) :]) for i, p in enumerate(names) if text.startswith(p))

    for word in ("a", "ab", "abab", "bba"):
        expected = math.log(total("▁" + word)) + pieces.log[-1]
        assert pieces.words([word])[0] == pytest.approx(expected)
    assert np.isfinite(pieces.words(["日本", "x" * 300])).all()
    before = pieces.words(["abab", "ab"]).sum()
    uses = np.zeros(pieces.size + 2)
    pieces.words(["abab", "ab"], np.ones(2), uses)
    lattice.Pieces.refit(pieces, uses * 1e6)
    assert pieces.words(["abab", "ab"]).sum() > before


def test_lattice_scores_and_odd_texts(spark):
    texts = ["the cat The\tdog", None, "", "the end", "日本 語", "\x1c the\x85", "a " * 3000] + ["the cat sat"] * 20
    got = {r.doc_id: r for r in lattice.score(docs(spark, texts), vocabulary("piece_bpe_32k.model")).collect()}
    counts: dict = {}
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            for w in [*words(t), 0]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        own = [*words(t), 0]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r.score < 0 and math.isfinite(r.score)
    assert lattice.score(docs(spark, texts).limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_licences_planted_and_odd_lines(spark):
    texts = [
        "A b.\nLicensed under the Apache License, Version 2.0.", None, "", "Released under the MIT License.", "He lost his driving licence yesterday.",
        "x\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "words " * 5000,
    ]
    got = licences.scan(docs(spark, texts + texts[:1]))
    found = sorted((r.doc_id, r.paragraph_no, r.family, r.confirmed) for r in got.collect())
    assert found == [(0, 1, "apache", True), (3, 0, "mit", True), (4, 0, "unknown", False), (5, 1, "gpl", True), (5, 2, "cc-by-nc", True), (7, 1, "apache", True)]
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert licences.scan(docs(spark, texts).limit(0)).count() == 0


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    draw = random.Random(2)
    texts = [None, "", " ", "a<|endoftext|><|endoftext|> b", "ab" * 400, "日本語 😀👩‍👩‍👧", "x\x1c\x85\xa0y  \n\n z", "don't I'LL"]
    texts += ["".join(draw.choice("ab <|>endoftx\n\té日1 'st\x1f") for _ in range(draw.randint(0, 80))) for _ in range(100)]
    texts += texts[:8]
    got = {r.doc_id: r for r in bpe.encode(docs(spark, texts), path, keep_ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs(spark, texts).limit(0), path).count() == 0


def test_top_k_equals_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in draw.integers(-9, 9, 8) / 16], 0) for i in range(300)]
    rows += [(i, rows[40][1], 0) for i in range(300, 340)]  # ties
    rows += [(341, None, 0), (342, [float("nan")] * 8, 0), (343, [None] + [0.5] * 7, 0), (344, [0.5] * 3, 0), (360, [float("inf")] * 8, 0), (345, [0.1] * 8, 0), (345, [0.2] * 8, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("block", F.lit(0))
    got = topk.top_k(table, F.col("vec_id") % 20 == 0, k=7)
    usable = [(i, np.floor(64 * np.array(v))) for i, v, _ in rows if v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    usable = usable[:-2] + [(345, np.floor(64 * np.float64(np.float32([x] * 8)))) for x in (0.1, 0.2)]  # stored as 32-bit floats
    expected = {}
    for q, x in usable:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in usable if i != q)[:7]
            expected[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    found: dict = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert found == expected
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(table.where("vec_id < 3"), F.col("vec_id") % 20 == 0).count() == 2


def components_of(texts, num=3, den=4, n=5):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, len(sets[i]), root[i]) for i in range(len(texts))]


def test_jaccard_equals_brute_force(spark):
    draw = random.Random(4)
    vocabulary_ = [f"w{i}" for i in range(60)]
    texts = [None, "", " \t", "one two", "One  two", "a b c d e", "a b c d e f"]
    for size in (3, 6, 7, 8, 9, 11, 14, 20, 40, 120):
        for _ in range(4):
            base = [draw.choice(vocabulary_) for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3):
                own = list(base)
                for _ in range(edits):
                    k = draw.randrange(len(own))
                    own[k : k + 1] = draw.choice([[], ["new"], [own[k], "more"]])
                texts.append(" ".join(own))
    # a chain of copies, and many texts around one long passage
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"t{k}x{i}" for i in range(40)) for k in range(12)]
    texts += [" ".join(f"c{i}" for i in range(k, k + 60)) for k in range(12)]
    got = jaccard.similar(docs(spark, texts))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == components_of(texts)
    assert jaccard.similar(docs(spark, texts).limit(0)).count() == 0


def test_jaccard_large_groups_lose_no_link(spark):
    """One base with many edited copies, whose copies need not resemble each other."""
    draw = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for _ in range(80):
        own = list(base)
        for k in draw.sample(range(80), 2):
            own[k] = f"e{draw.random()}"
        texts.append(" ".join(own))
    got = jaccard.similar(docs(spark, texts))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == components_of(texts)


def test_signatures_of_partners_always_meet():
    """Any two sets within the similarity share a signature that one of them probes."""
    draw, bands = np.random.default_rng(6), jaccard.Bands(3, 4)
    none = np.zeros(0, np.uint64)
    for _ in range(400):
        n = int(draw.integers(2, 60))
        x = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        gone = int(draw.integers(0, max(1, len(x) // 6) + 1))
        y = np.unique(np.concatenate([x[gone:], draw.integers(0, 2**63, int(draw.integers(0, 3))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 4 * both < 3 * (len(x) + len(y) - both):
            continue
        one, two = (jaccard.signatures(s, np.array([0, len(s)]), bands, none) for s in (x, y))
        a, b = ({s for s, p in zip(o[0].tolist(), o[2].tolist(), strict=True) if p} for o in (one, two))
        assert a & set(two[0].tolist()) or b & set(one[0].tolist())


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a>Menu</a></ul></nav><!-- x --><div class='ad'>Buy</div>{}<footer>&copy; me</footer>"


def test_html_articles_templates_and_odd_pages(spark):
    pages = [
        (0, "http://a.org/1", PAGE.replace("{}", "<article><h1>Head &amp; more</h1><p><b>One\n two.<br><p>Three&nbsp;four</p><form>f</form><div class=comments>c</div></article>")),
        (1, None, None), (2, "x", ""), (3, "http://a.org/2", "<p>cut <b>off"), (4, "http://a.org/3", "<article>a < b<script>var t='</p>'</script><p>c<!-- d --></article>"),
    ]
    # a site without declared articles: what recurs on its pages goes
    pages += [(10 + k, f"http://b.org/{k}", f"<body><div>Welcome to the site</div><p>Story number {k} is new.</p><span>x{k}</span></body>") for k in range(8)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("low", F.lit(1)).withColumn("host", F.lit("h"))
    got = {r.page_id: r for r in html.extract(table).collect()}
    assert len(got) == len(pages)
    assert got[0].text == "Head & more\nOne two.\nThree four"
    assert (got[1].text, got[2].text, got[1].n_chars) == ("", "", 0)
    assert got[3].text == "cut off"
    assert got[4].text == "a < b\nc"
    for k in range(8):
        assert got[10 + k].text == f"Story number {k} is new.\nx{k}"
        assert got[10 + k].n_chars == len(got[10 + k].text)
    assert html.extract(table.limit(0)).count() == 0


def test_decontamination_planted_edited_and_clean(spark):
    draw = random.Random(7)
    items = [" ".join(f"q{draw.randrange(5000)}" for _ in range(50)) for _ in range(5)]
    filler = [" ".join(f"z{draw.randrange(300)}" for _ in range(200)) for _ in range(30)]
    edited = items[2].split()
    for k in range(0, 50, 9):
        edited[k] = "other"
    del edited[20:23]
    texts = filler[:10] + [f"{filler[10]} {items[0].upper()} {filler[11]}", f"{filler[12]} {' '.join(edited)}", items[1], None, "", " ".join(items[3].split()[:8])]
    texts += [items[4]] * 40
    benchmark = spark.createDataFrame([*enumerate(items), (99, None), (98, ""), (97, "the end")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.contaminated(docs(spark, texts), benchmark)
    found = {(r.doc_id, r.item_id): r for r in got.collect()}
    assert set(found) == {(10, 0), (11, 2), (12, 1), *((i, 4) for i in range(16, 56))}
    assert (found[10, 0].start_word, found[10, 0].end_word, found[10, 0].score) == (200, 250, 1.0)
    assert found[11, 2].score < 1
    assert decontaminate.contaminated(docs(spark, texts).limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs(spark, texts), benchmark.limit(0)).count() == 0


def test_alignment_equals_the_plain_recursion():
    draw = np.random.default_rng(8)
    for _ in range(30):
        a, b = (draw.integers(0, 4, int(draw.integers(1, 12))).astype(np.uint64) for _ in range(2))
        score = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                score[i + 1, j + 1] = max(0, score[i, j] + (2 if a[i] == b[j] else -1), score[i, j + 1] - 1, score[i + 1, j] - 1)
        assert decontaminate.align([a], [b])[0][0] == score.max()


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    kept = rows
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language", "quality", "distinct", "decontaminated", "encoded"]
    for name, step in pipeline.STAGES[:-1]:
        after = step(spark, kept, folder)
        assert after.columns == rows.columns, name
        kept = spark.createDataFrame(after.collect(), rows.schema)
    texts = [r.text for r in kept.orderBy("doc_id").collect()]
    assert all(root == i for i, _, root in components_of(texts))
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not any(item in t for item in items for t in texts)
    good = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("quality = 1").select("text").collect()
    lost = {r.text for r in good} - set(texts)
    assert len(lost) < len(good) / 3  # copies and leaks alone
    assert pipeline.encoded(spark, kept, folder).count() == len(texts)
