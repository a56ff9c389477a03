"""How the sources of a language differ in their words, exactly.

Terms are counted in the map tasks and shuffled once, by language and term. With p the
smoothed frequency of a term in a source and q that elsewhere, in parts of a thousand
million, a term contributes floor((p - q)^2 / q).

* **Against other sources.** The sum over all kept terms needs no row for a term that
  neither source holds: those are a number times a constant. Terms of one source alone
  are summed by their count, terms of both where they lie, by the pair.
* **Largest terms.** Of two terms in one source, the one with the higher count there,
  the lower count in the language and the earlier name ranks first, whatever the exact
  values. A term with k such *dominators* cannot be among the first k. Every piece of
  a source's terms keeps its k-skyband, the terms with fewer; skybands are merged until
  little is gained; only what is left is valued and ranked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import only, slices
from caseflow.sources.scratch import stage

SMALLEST = 3  # documents of the language that hold a kept term
TOP = 200
SCALE = 1_000_000_000
CHUNK = 1 << 20  # bytes of a text that are cut into terms at a time
HELD = 200_000  # terms that a map task holds before it passes them on
PIECE = 50_000  # terms of one source that a skyband is taken of at a time
BLOCK = 256
CELLS = 128  # of a grid, each way, that rules points out before they are compared

# Terms are runs of letters A-Z, lower-cased, and of all beyond ASCII: every byte of a
# UTF-8 text is one of a term as it stands, a letter to be lower-cased, or a gap.
_BYTES = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8, in lists; of long texts a chunk at a time."""
    data, start = text.encode("utf-8").translate(_BYTES), 0
    while start < len(data):
        stop = data.find(b" ", start + chunk)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) as map tasks hold them, not yet added up: occurrences
    and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.repeat(pa.scalar(name, pa.string()), len(n)) for name in (lang, source)),
                        pa.array(list(n), pa.string()),
                        pa.array(list(n.values()), pa.int64()),
                        pa.array([in_docs[term] for term in n], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for part in slices(batches, "text"):
            for text, lang, source in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                n, in_docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                seen: set = set()
                for found in words(text or ""):
                    n.update(found)
                    seen.update(found)
                in_docs.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from rows()
        yield from rows()

    return only(docs, "text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")


class Grid:
    """Points counted in ``CELLS`` by ``CELLS`` cells of equally many ranks."""

    def __init__(self, whole: np.ndarray, name: np.ndarray):
        cell = max(1, -(-len(whole) // CELLS))
        self.by_whole, self.by_name = np.empty(len(whole), np.int64), np.empty(len(whole), np.int64)
        self.by_whole[np.lexsort((name, whole))] = np.arange(len(whole)) // cell
        self.by_name[np.argsort(name, kind="stable")] = np.arange(len(whole)) // cell
        self.counts = np.zeros((CELLS + 1, CELLS + 1), np.int64)

    def add(self, places: np.ndarray) -> None:
        np.add.at(self.counts, (self.by_whole[places] + 1, self.by_name[places] + 1), 1)

    def least(self, places: np.ndarray) -> np.ndarray:
        """How many points that were added are in cells below in both, and so have no higher ``whole`` and an earlier name."""
        return self.counts.cumsum(axis=0).cumsum(axis=1)[self.by_whole[places], self.by_name[places]]


def skyband(group: np.ndarray, whole: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Positions of the points dominated by fewer than ``k`` others.

    One point dominates another that has no higher ``group``, no lower ``whole`` and a
    later ``name`` (places of names in order, no two alike). Points are visited so that
    dominators come first; k dominators include k that are kept, so only those kept and
    those of the same block are compared. Most points have k in the cells of a grid that
    lie wholly below theirs, and are not compared at all.
    """
    order = np.lexsort((name, whole, -group))
    whole, name = whole[order], name[order]
    grid = Grid(whole, name)
    kept: list[np.ndarray] = []
    kept_whole, kept_name = np.empty(len(order), whole.dtype), np.empty(len(order), name.dtype)
    filled = 0
    for start in range(0, len(order), BLOCK):
        places = np.arange(start, min(start + BLOCK, len(order)))
        if filled >= k:
            places = places[grid.least(places) < k]
        w, m = whole[places], name[places]
        above = np.tri(len(w), k=-1, dtype=bool).T  # the row comes before the column
        count = ((w[:, None] <= w) & (m[:, None] < m) & above).sum(axis=0)
        count += ((kept_whole[:filled, None] <= w) & (kept_name[:filled, None] < m)).sum(axis=0)
        good = places[count < k]
        kept_whole[filled : filled + len(good)], kept_name[filled : filled + len(good)] = whole[good], name[good]
        filled += len(good)
        grid.add(good)
        kept.append(order[good])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def merged_skybands(points: DataFrame, k: int, piece: int = PIECE) -> DataFrame:
    """The terms that may be among the first ``k`` of their (lang, source).

    ``points``: (lang, source, term, n, whole, ...). Every group is dealt into pieces of
    about ``piece`` terms. Pieces give their skybands, which are merged into fewer pieces
    until that leaves more than half of them. A large group is many pieces, never a task.
    """
    keys = ["lang", "source"]

    def run(table: pa.Table) -> pa.Table:
        names = np.empty(table.num_rows, np.int64)
        names[pc.sort_indices(table["term"]).to_numpy()] = np.arange(table.num_rows)  # places in the order of UTF-8
        kept = skyband(table["n"].to_numpy(), table["whole"].to_numpy(), names, k)
        return table.take(pa.array(np.sort(kept)))

    while True:
        sizes = points.groupBy(*keys).agg(F.count("*").alias("size"))
        dealt = points.join(sizes, keys).withColumn("piece", F.expr(f"pmod(xxhash64(term), 1 + size div {piece})")).drop("size")
        before = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
        fields = dealt.schema
        points = stage(dealt.groupBy(*keys, "piece").applyInArrow(run, fields)).drop("piece")
        if before[1] < piece or 2 * points.count() > before[0]:
            return points


def smoothed(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), beyond the range of 64 bits in between."""
    parts = (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", parts, (total + kept).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, *, smallest: int = SMALLEST, top: int = TOP, piece: int = PIECE) -> DataFrame:
    """(lang, source, part, item, value, rank) as the module describes.

    ``part`` is ``pair``, with each other source of the language as item, all of them, or
    ``term``, with the kept terms that are commoner in the source than in the language,
    the ``top`` largest. Null text, lang and source count as empty; sources without terms
    are compared too; repeated rows count as documents of their own; further columns are
    ignored; an empty table gives an empty one. A sum beyond 64 bits fails the job.
    """
    tallies = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = stage(
        tallies.groupBy("lang", "term")
        .agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
        .where(F.col("docs") >= smallest)
    )
    rows = kept.select("lang", "term", "whole", F.inline("held"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_total"))
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    occurring = only(docs, "lang", "source").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "own", "kept", "lang_total")}
    groups = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero)
    groups = stage(groups.withColumn("none", F.when(F.col("kept") > 0, smoothed(F.lit(0), F.col("total"), F.col("kept")))))
    return pairs(rows, groups).unionByName(terms(rows, groups, top, piece))


def pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Every source against every other of its language."""
    a, b = (groups.select("lang", *(F.col(c).alias(f"{side}_{c}") for c in ("source", "total", "own", "none")), *(["kept"] if side == "a" else [])) for side in "ab")
    both = a.join(b, "lang").where("a_source <> b_source")
    # terms by their count in a source: a few thousand rows per source
    counts = rows.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    p, q = (smoothed(F.col("n"), F.col(f"{s}_total"), F.col("kept")) for s in "ab")
    of = ["lang", "a_source", "b_source"]
    only_a = both.join(counts.withColumnRenamed("source", "a_source"), ["lang", "a_source"]).groupBy(*of).agg(F.sum(F.col("terms") * gap(p, F.col("b_none"))).alias("sum_a"))
    only_b = both.join(counts.withColumnRenamed("source", "b_source"), ["lang", "b_source"]).groupBy(*of).agg(F.sum(F.col("terms") * gap(F.col("a_none"), q)).alias("sum_b"))
    # terms of both: right their part in the sums above
    valued = rows.join(groups.select("lang", "source", "total", "none", "kept"), ["lang", "source"]).select(
        "lang", "term", "source", "none", smoothed(F.col("n"), F.col("total"), F.col("kept")).alias("p")
    )
    met = valued.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("held")).where(F.size("held") > 1)
    met = met.select("lang", F.explode("held").alias("a"), "held").select("lang", "a", F.explode("held").alias("b")).where("a.source <> b.source")
    right = gap(F.col("a.p"), F.col("b.p")) - gap(F.col("a.p"), F.col("b.none")) - gap(F.col("a.none"), F.col("b.p"))
    shared = met.groupBy("lang", F.col("a.source").alias("a_source"), F.col("b.source").alias("b_source")).agg(F.count("*").alias("shared"), F.sum(right).alias("right"))
    found = both.join(only_a, of, "left").join(only_b, of, "left").join(shared, of, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("sum_a", "sum_b", "shared", "right")}
    neither = F.col("kept") - F.col("a_own") - F.col("b_own") + zero["shared"]
    value = zero["sum_a"] + zero["sum_b"] + zero["right"] + F.coalesce(neither * gap(F.col("a_none"), F.col("b_none")), F.lit(0))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = found.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), value.alias("value"))
    return out.withColumn("rank", F.row_number().over(order))


def terms(rows: DataFrame, groups: DataFrame, top: int, piece: int) -> DataFrame:
    """The terms of every source that stand out most against the language."""
    p = smoothed(F.col("n"), F.col("total"), F.col("kept"))
    q = smoothed(F.col("whole"), F.col("lang_total"), F.col("kept"))
    commoner = rows.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "whole", p.alias("p"), q.alias("q")).where("p > q")
    found = merged_skybands(stage(commoner), top, piece)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
