"""Test items inside training texts, found by rare n-gram seeds and scored by alignment.

Every item's word n-grams are counted in the whole corpus; the rarer half of each item's
n-grams are its seeds, so phrases of everyday words start nothing, yet an item always
keeps seeds however often it was copied. A seed met in a text puts a window there, as
long as the item allows on either side; windows that overlap are one. In it the words of
the item are aligned with those of the text (Smith-Waterman: match 2, mismatch and gap
-1), so edited, cut or extended copies score too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import hash_words, ngrams, ngrams_many, only, received, share, slices

SEED = 3  # words; a shorter item is its own seed
REACH = 0.5  # least share of the best possible alignment score
WORDS = 500_000  # item words, about, that are sent to the tasks at once
MATCH, GAP = 2, 1


class Items:
    """Words and seeds of some items. ``use`` marks the occurrences that serve as seeds."""

    def __init__(self, ids: list, texts: list[str]):
        hashes, starts = hash_words(texts)
        self.ids = ids
        self.words = [hashes[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        grams = [ngrams(w, SEED) for w in self.words]
        self.gram = np.concatenate([*grams, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(ids)), [len(g) for g in grams])
        self.offset = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        self.seeds = np.unique(self.gram)
        self.sizes = sorted({min(SEED, len(w)) for w in self.words if len(w)})  # of seeds, in words
        self.index()

    def keep_rare(self, counts: dict[int, int]) -> None:
        """Keep the rarer half, rounded up, of each item's n-grams."""
        n = np.array([counts.get(i, 0) for i in range(len(self.seeds))], dtype=np.int64)[np.searchsorted(self.seeds, self.gram)]
        order = np.lexsort((self.offset, n, self.item))
        first = np.searchsorted(self.item[order], np.arange(len(self.ids)))
        size = np.bincount(self.item, minlength=len(self.ids))
        rank = np.arange(len(order)) - first[self.item[order]]
        order = order[rank < (size[self.item[order]] + 1) // 2]
        self.gram, self.item, self.offset = self.gram[order], self.item[order], self.offset[order]
        self.index()

    def index(self) -> None:
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.offset = self.gram[order], self.item[order], self.offset[order]
        self.seeds, self.first = np.unique(self.gram, return_index=True)
        self.size = np.diff(np.append(self.first, len(self.gram)))


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair and the place in the window where it ends.

    All pairs advance one word of their item at a time. A gap in the item costs the
    same per word, so the best way to come from the left is a running maximum.
    """
    rows, width = max(map(len, items)), max(map(len, windows))
    text = np.zeros((len(windows), width), dtype=np.uint64)
    real = np.zeros((len(windows), width), dtype=bool)
    for i, w in enumerate(windows):
        text[i, : len(w)], real[i, : len(w)] = w, True
    at = np.arange(width, dtype=np.int32)
    score = np.zeros((len(windows), width), dtype=np.int32)
    best, end = np.zeros(len(windows), dtype=np.int32), np.zeros(len(windows), dtype=np.int64)
    sizes = np.array([len(i) for i in items])
    for r in range(rows):
        live = np.flatnonzero(sizes > r)
        words = np.array([items[i][r] for i in live.tolist()], dtype=np.uint64)
        same = np.where((text[live] == words[:, None]) & real[live], np.int32(MATCH), np.int32(-1))
        old = score[live]
        same[:, 1:] += old[:, :-1]
        new = np.maximum(np.maximum(same, old - GAP), 0)
        new = np.maximum.accumulate(new + GAP * at, axis=1) - GAP * at
        score[live] = new
        top = new.argmax(axis=1)
        value = new[np.arange(len(live)), top]
        better = value > best[live]
        best[live[better]], end[live[better]] = value[better], top[better]
    return best, end


def windows_of(items: Items, grams: np.ndarray, n_words: int) -> list[tuple[int, int, int]]:
    """(item, first word, end word) of every stretch of a text that seeds point at."""
    if not len(items.seeds) or not len(grams):
        return []
    place = np.searchsorted(items.seeds, grams)
    place[place == len(items.seeds)] = 0
    hit = np.flatnonzero(items.seeds[place] == grams)
    if not len(hit):
        return []
    place = place[hit]
    times = items.size[place]
    at = np.repeat(hit, times)
    entry = np.repeat(items.first[place] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
    item, offset = items.item[entry], items.offset[entry]
    length = np.array([len(w) for w in items.words])[item]
    begin = np.maximum(0, at - offset - length // 2)
    stop = np.minimum(n_words, at - offset + length + length // 2)
    out: list[tuple[int, int, int]] = []
    for i, a, b in sorted(zip(item.tolist(), begin.tolist(), stop.tolist(), strict=True)):
        if out and out[-1][0] == i and a <= out[-1][2]:
            out[-1] = (i, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((i, a, b))
    return out


def _pass(docs: DataFrame, items: Items) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    counter = share(docs.sparkSession, items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = received(counter)
        seeds = items.seeds
        total = np.zeros(len(seeds), dtype=np.int64)
        for part in slices(batches, "text"):
            hashed = hash_words(part.column(1).to_pylist())
            for size in items.sizes:
                grams, _ = ngrams_many(*hashed, size)
                place = np.minimum(np.searchsorted(seeds, grams), len(seeds) - 1)
                total += np.bincount(place[seeds[place] == grams], minlength=len(seeds))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["seed", "n"])

    counts = docs.mapInArrow(count, "seed int, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    items.keep_rare({r.seed: r.n for r in counts.toLocalIterator()})
    sent = share(docs.sparkSession, items)
    names = ["doc_id", "place", "score", "start_word", "end_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = received(sent)
        for part in slices(batches, "text"):
            hashes, starts = hash_words(part.column(1).to_pylist())
            found = []
            for size in items.sizes if len(items.seeds) else ():
                grams, ends = ngrams_many(hashes, starts, size)
                near = np.zeros(len(starts) - 1, bool)
                place = np.minimum(np.searchsorted(items.seeds, grams), len(items.seeds) - 1)
                near[np.searchsorted(ends, np.flatnonzero(items.seeds[place] == grams), side="right") - 1] = True
                for d in np.flatnonzero(near).tolist():
                    words = hashes[starts[d] : starts[d + 1]]
                    found += [(d, i, a, words[a:b]) for i, a, b in windows_of(items, grams[ends[d] : ends[d + 1]], len(words))]
            found.sort(key=lambda f: len(f[3]))
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            group, cells = [], 0
            for f in [*found, None]:
                if f is None or cells + len(f[3]) > 200_000:
                    if group:
                        scores, stops = align([items.words[g[1]] for g in group], [g[3] for g in group])
                        most = np.array([MATCH * len(items.words[g[1]]) for g in group])
                        high = np.flatnonzero(scores >= np.maximum(REACH * most, MATCH * np.minimum(most // MATCH, 8)))
                        if len(high):
                            back = [(group[k], int(stops[k]) + 1) for k in high.tolist()]
                            _, firsts = align([items.words[g[1]][::-1] for g, _ in back], [g[3][:s][::-1] for g, s in back])
                            for k, (g, stop), first in zip(high.tolist(), back, firsts.tolist(), strict=True):
                                value = (scores[k] / most[k], g[2] + stop - 1 - first, g[2] + stop)
                                key = (g[0], g[1])
                                if key not in best or (value[0], -value[1]) > (best[key][0], -best[key][1]):
                                    best[key] = value
                    group, cells = [], 0
                if f is not None:
                    group.append(f)
                    cells += len(f[3])
            keys = sorted(best)
            rows = [best[k] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array([d for d, _ in keys], pa.int64())),
                    pa.array([i for _, i in keys], pa.int32()),
                    pa.array([float(r[0]) for r in rows], pa.float64()),
                    pa.array([int(r[1]) for r in rows], pa.int64()),
                    pa.array([int(r[2]) for r in rows], pa.int64()),
                ],
                names=names,
            )

    out = docs.mapInArrow(run, f"doc_id {kind}, place int, score double, start_word long, end_word long")
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Test items that texts contain, in copies that may be edited.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``. The
    result has a row for every row of ``docs`` and item that align over at least half of
    the best possible score and 8 words (a shorter item whole): doc_id, item_id, score (share of the
    best possible), and the words [start_word, end_word) of the best place, the first of
    equals. Words are lower-cased A-Z and split at white space. Null or empty texts and
    items match nothing; items with one text are reported each; repeated rows of
    ``docs`` are reported each. Items go to the tasks in portions of about ``WORDS``
    words, one pass over the texts per portion, so a large benchmark is never sent whole.
    """
    docs, benchmark = only(docs, "doc_id", "text"), only(benchmark, "item_id", "text").where("text is not null")
    words = benchmark.agg(F.sum(F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")))).first()[0] or 0
    portions = max(1, -(-int(words) // WORDS))
    result = None
    for k in range(portions):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == k).collect()
        rows = sorted((r for r in rows if r.text.strip()), key=lambda r: (r.item_id is None, r.item_id, r.text))
        items = Items([r.item_id for r in rows], [r.text for r in rows])
        names = docs.sparkSession.createDataFrame(
            [(i, r.item_id) for i, r in enumerate(rows)], f"place int, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
        )
        found = _pass(docs, items) if len(items.gram) else docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, place int, score double, start_word long, end_word long")
        found = found.join(F.broadcast(names), "place").select("doc_id", "item_id", "score", "start_word", "end_word")
        result = found if result is None else result.union(found)
    return result
