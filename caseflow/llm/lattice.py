"""Document probability under a lattice of subword segmentations.

A word's probability mixes two kinds of path through its lattice. One arc spans the
whole word and carries its share of the training tokens. All other paths are
segmentations into pieces of an existing vocabulary, weighted by piece probabilities;
the forward recursion in log space adds up every one of them. Piece probabilities start
from the vocabulary's own scores and are fitted by expectation maximisation to the
training words, each distinct one once, since the pieces are there for words not seen
before. These have the mass that Good and Turing estimate, the share of words seen once
among all tokens. Over all words the probabilities add up to no more than 1, unlike
those of additive smoothing, which gives its least share to any number of unseen words.

A text's score is a sum over its words. The commonest words, a bounded table, go to
the tasks that read the texts and are summed there; of the others one row per text and
word is joined with the word table. Texts are read twice and neither stored nor shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import crc_remainder, mix, only, received, remainder, share, slices, words_of
from caseflow.sources.scratch import discard, stage

LONGEST = 16  # code points of the longest piece that is used
ROUNDS = 2  # of expectation maximisation
PRIOR = 1_000.0  # how many piece uses the vocabulary's own scores count for
COMMON = 100_000  # words that are sent to all tasks
HELD = 300_000  # words that a task counts before it passes them on
_MUL = 0x5851F42D4C957F2D
_INV = pow(_MUL, -1, 1 << 64)


def _chars(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


class Pieces:
    """A vocabulary in tables by piece length, with a log probability for each piece.

    Two more parameters follow the pieces: a byte of a character that is no piece (all
    bytes alike), and the end of a word. ``start`` marks pieces at a word's beginning.
    """

    def __init__(self, pieces: list[tuple[str, float]], start: str = "▁"):
        kept = sorted(((p, s) for p, s in pieces if 0 < len(p) <= LONGEST), key=lambda x: (-x[1], x[0]))
        self.start, self.size = start, len(kept)
        # Scores say how pieces rank; by rank they get probabilities as words of a language do.
        weight = np.append(1 / (2.7 + np.arange(self.size)), [1e-4, 1.0])
        self.prior = weight / weight.sum()
        self.log = np.log(self.prior)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, LONGEST + 1):
            own = [(i, p) for i, (p, _) in enumerate(kept) if len(p) == n]
            if own:
                codes = np.array([[ord(c) for c in p] for _, p in own])
                keys = (_chars(codes) * _powers(_MUL, n)).sum(axis=1, dtype=np.uint64)
                order = np.argsort(keys)
                self.tables[n] = keys[order], np.array([i for i, _ in own])[order]

    def arcs(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """Piece (or -1) for every length and place in words of one length."""
        n, size = codes.shape
        sums = np.zeros((n, size + 1), dtype=np.uint64)
        np.cumsum(_chars(codes) * _powers(_MUL, size), axis=1, out=sums[:, 1:])
        back = _powers(_INV, size)
        found = {}
        for length, (keys, ids) in self.tables.items():
            if length <= size:
                key = (sums[:, length:] - sums[:, :-length]) * back[: size - length + 1]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                ids_here = np.where(keys[place] == key, ids[place], -1)
                if length == 1 or (ids_here >= 0).any():
                    found[length] = ids_here
        return found

    def run(self, codes: np.ndarray, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        """Log probability of words of one length; adds expected piece uses if asked to."""
        n, size = codes.shape
        found = self.arcs(codes)
        log = np.append(self.log, -np.inf)
        weights = {length: log[ids] for length, ids in found.items()}
        unknown = found[1] < 0
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        weights[1] = np.where(unknown, width * (self.log[self.size] - np.log(256)), weights[1])
        forward = np.full((n, size + 1), -np.inf)
        forward[:, 0] = 0
        for j in range(1, size + 1):
            terms = np.stack([forward[:, j - k] + w[:, j - k] for k, w in weights.items() if k <= j])
            top = terms.max(axis=0)
            forward[:, j] = top + np.log(np.exp(terms - top).sum(axis=0))
        total = forward[:, size]
        if expected is not None:
            backward = np.full((n, size + 1), -np.inf)
            backward[:, size] = 0
            for i in range(size - 1, -1, -1):
                terms = np.stack([w[:, i] + backward[:, i + k] for k, w in weights.items() if i + k <= size])
                top = terms.max(axis=0)
                backward[:, i] = top + np.log(np.exp(terms - top).sum(axis=0))
            for k, w in weights.items():
                use = np.exp(forward[:, : size - k + 1] + w + backward[:, k:] - total[:, None]) * counts[:, None]
                ids = found[k]
                known = ids >= 0
                expected[: self.size] += np.bincount(ids[known], use[known], minlength=self.size)
                if k == 1:
                    expected[self.size] += (use * width)[~known].sum()
            expected[self.size + 1] += counts.sum()
        return total + self.log[self.size + 1]

    def words(self, words: list[str], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word, found for words of one length together."""
        out = np.empty(len(words))
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            size = int(lengths[order[at]]) + len(self.start)
            same = int(np.searchsorted(lengths[order], lengths[order[at]], side="right"))
            stop = min(same, at + max(1, 60_000 // size))
            rows = order[at:stop]
            text = "".join(self.start + words[i] for i in rows.tolist())
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), size).astype(np.int64)
            out[rows] = self.run(codes, None if counts is None else counts[rows], expected)
            at = stop
        return out

    def refit(self, expected: np.ndarray) -> None:
        weight = expected + PRIOR * self.prior
        self.log = np.log(weight / weight.sum())


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
    ]


def score(docs: DataFrame, pieces_path: str, common: int = COMMON) -> DataFrame:
    """log10 probability of every text under a word model and under the lattice.

    ``docs`` needs ``doc_id`` and ``text``; rows whose crc32 of doc_id as text leaves 0
    modulo 10 are held out, all others teach. Per row of ``docs`` the result has doc_id,
    held_out, n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score (add-0.1 smoothing over training tokens) and score (the
    lattice). A null or empty text is the end alone; null ids count as the empty text for
    the split; repeated rows are scored and counted each; an empty table gives an empty
    one. ``common`` words are sent to all tasks; it steers the cost alone. With nothing
    to learn from, the word model is even and the lattice has the
    vocabulary's own scores.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    rows = only(docs, "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = list(seen)
            columns = [pa.array(words, pa.string()), pa.array([taught[w] for w in words], pa.int64()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            taught.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n", "seen"])

        seen, taught = Counter(), Counter()
        for part in slices(batches, "text"):
            for i, text in zip(*part.to_pydict().values(), strict=True):
                words = words_of(text)
                seen.update(words)
                if crc_remainder(i, 10):
                    taught.update(words)
            if len(seen) > HELD:
                yield out()
        yield out()

    counted = rows.mapInArrow(count, "word string, n long, seen long")
    words = stage(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")))
    texts = docs.where(remainder(F.col("doc_id"), 10) != 0).count()
    tokens, kinds, once = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 1)).first()
    tokens, kinds, once = tokens + texts, kinds + (texts > 0), once + (texts == 1)
    escape = min(0.5, max(1, once) / (tokens + 1)) if tokens else 1.0

    model = Pieces(read_pieces(pieces_path))
    for _ in range(ROUNDS if tokens > texts else 0):
        sent = share(spark, model)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces = received(sent)
            expected = np.zeros(pieces.size + 2)
            for batch in batches:
                pieces.words(batch.column(0).to_pylist(), np.ones(batch.num_rows), expected)
            used = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(expected[used])], names=["piece", "uses"])

        # one row per piece: bounded by the vocabulary
        sums = words.where("n > 0").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        expected = np.zeros(model.size + 2)
        for r in sums:
            expected[r.piece] = r.uses
        model.refit(expected)
    sent = share(spark, model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = received(sent)
        for batch in batches:
            n = batch.column(1).to_numpy().astype(np.float64)
            inside = pieces.words(batch.column(0).to_pylist())
            with np.errstate(divide="ignore"):
                whole = np.log((1 - escape) * n / max(1, tokens))
            base = np.log10((n + 0.1) / (tokens + 0.1 * (kinds + 1)))
            value = np.logaddexp(whole, np.log(escape) + inside) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array((n > 0).astype(np.int64)), pa.array(base), pa.array(value)],
                names=["word", "seen", "known", "base", "value"],
            )

    rated = stage(words.mapInArrow(rate, "word string, seen long, known long, base double, value double"))
    discard(words)
    top = rated.orderBy(F.desc("seen"), "word").limit(common).collect()
    usual = share(spark, ({r.word.encode(): i for i, r in enumerate(top)}, np.array([(r.known, r.base, r.value) for r in top], dtype=np.float64).reshape(-1, 3)))
    end_base = float(np.log10((texts + 0.1) / (tokens + 0.1 * (kinds + 1))))
    end_value = float(np.log10((1 - escape) * texts / tokens)) if texts else end_base

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with the sums over its common words, and one per further word."""
        (place, values), row = received(usual), TaskContext.get().partitionId() << 40
        for part in slices(batches, "text"):
            took: list[int | None] = []
            out: list[tuple] = []
            for at, (i, text) in enumerate(zip(*part.to_pydict().values(), strict=True)):
                own = words_of(text)
                row += 1
                found = np.fromiter((place.get(w, -1) for w in own), dtype=np.int64, count=len(own))
                known, base, value = values[found[found >= 0]].sum(axis=0).tolist()
                out.append((row, crc_remainder(i, 10) == 0, len(own) + 1, int(known) + (texts > 0), base + end_base, value + end_value, None, None))
                rare = Counter(own[j] for j in np.flatnonzero(found < 0).tolist())
                out += [(row, None, None, None, None, None, w, n) for w, n in rare.items()]
                took += [at, *[None] * len(rare)]
            columns = [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, part.column(0).take(pa.array(took, pa.int64()))], names)

    names = ["row", "held_out", "n_tokens", "n_known", "base", "value", "word", "times", "doc_id"]
    told = stage(rows.mapInArrow(add_up, f"row long, held_out boolean, n_tokens long, n_known long, base double, value double, word string, times long, doc_id {kind}"))
    times = F.col("times")
    rest = told.where("word IS NOT NULL").select("row", "word", "times").join(rated.select("word", "known", F.col("base").alias("b"), F.col("value").alias("v")), "word")
    rest = rest.groupBy("row").agg(*[F.sum(times * F.col(c)).alias(f"more_{c}") for c in ("known", "b", "v")])
    both = told.where("word IS NULL").join(rest, "row", "left")

    def more(c: str, d: str) -> Column:
        return F.col(c) + F.coalesce(f"more_{d}", F.lit(0))

    return both.select(
        "doc_id", "held_out", "n_tokens", more("n_known", "known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        more("base", "b").alias("base_score"), more("value", "v").alias("score"),
    )
