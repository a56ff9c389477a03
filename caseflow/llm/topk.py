"""Exact top-k by integer inner product with a pivot table.

Vectors are whole numbers, so |q-x|^2 = |q|^2 + |x|^2 - 2qx. Distances of every vector
to a fixed set of many pivots give, by the triangle inequality, a lower bound of d(q,x),
the largest |d(q,p) - d(x,p)|, and so an upper bound of qx.

Candidates are clustered by their nearest pivot, and of a cluster the table keeps the
range of distances to every pivot: one bound then holds for all of it. Clusters are
packed into blocks, queries into parts; pairs of a block and a part whose ranges leave no
score above any query's threshold go before anything is shuffled. Within a pair each
query takes the clusters in the order of their bounds, a few at a time, and stops once
the next bound is below its k-th score. In a cluster the distances to its own pivot, by
which it is sorted, rule out both ends. What is left is evaluated, many queries at once.
Each query starts from its k-th score among the bounded sample that supplies the pivots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import only, received, share
from caseflow.sources.scratch import stage

PIVOTS = 256
SAMPLE = 2048  # rows, about, and twice that at most, that pivots and first thresholds come from
BLOCK = 4096  # candidates, about, that are sent together
QUERIES = 1024  # queries, about, that are sent together
EXACT = 2.0**53  # products below are exact in doubles
LARGEST = 2.0**62  # and up to here in 64-bit integers
NONE = np.iinfo(np.int64).min


def _whole(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""

    def whole(x: Column) -> Column:
        # Spark may scale components of vectors that it then leaves out: only finite ones fail
        scaled = x.cast("double") * scale
        failed = F.raise_error(F.lit("a component does not fit 64 bits")).cast("long")
        return F.when(F.abs(scaled) < LARGEST, F.floor(scaled)).when(F.abs(x.cast("double")) < float("inf"), failed)

    clean = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return only(vectors, vec_id, embedding).where(F.col(embedding).isNotNull() & clean & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, whole).alias("v")
    )


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Sample rows far from each other: each is the one farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From every row to every pivot, up to the rounding that ``slack`` allows for."""
    squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(0, squares))


def slack(norm: np.ndarray | float) -> np.ndarray | float:
    return 1e-6 * np.sqrt(norm) + 1e-3


def squares(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(axis=1)


class Exact:
    """All inner products of two sets of rows as 64-bit integers, exactly: in doubles where
    no sum can lose a digit, else in integers. A score that may not fit 64 bits fails."""

    def __init__(self, q: np.ndarray, c: np.ndarray):
        reach = math.sqrt(squares(q).max(initial=0) * squares(c).max(initial=0))
        if reach >= LARGEST:
            raise ValueError("inner products do not fit 64 bits")
        kind = np.float64 if reach < EXACT / 2 else np.int64
        self.q, self.c = q.astype(kind), c.astype(kind)

    def __call__(self, rows: np.ndarray | slice, columns: slice) -> np.ndarray:
        return (self.q[rows] @ self.c[columns].T).astype(np.int64)


class Block:
    """Candidates sorted by cluster and, in it, by distance to its pivot."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, nearest: np.ndarray | None = None):
        far = distances(x.astype(np.float64), pivots)
        nearest = far.argmin(axis=1) if nearest is None else nearest
        own = far[np.arange(len(x)), nearest]
        order = np.lexsort((ids, own, nearest))
        self.ids, self.x, self.own, far, nearest = ids[order], x[order], own[order], far[order], nearest[order]
        self.begin = np.flatnonzero(np.concatenate([[True], nearest[1:] != nearest[:-1]]))
        self.end = np.append(self.begin[1:], len(x))
        self.pivot = nearest[self.begin]
        self.low, self.high = np.minimum.reduceat(far, self.begin), np.maximum.reduceat(far, self.begin)
        self.norm = np.maximum.reduceat(squares(self.x), self.begin)


def upper_bounds(q_norm: np.ndarray, q_far: np.ndarray, block: Block) -> np.ndarray:
    """The most that any row of each cluster can score with each query."""
    out = np.empty((len(q_norm), len(block.begin)))
    for j in range(len(block.begin)):
        gap = np.maximum(block.low[j] - q_far, q_far - block.high[j]).max(axis=1)
        gap = np.maximum(0, gap - slack(q_norm) - slack(block.norm[j]))
        out[:, j] = (q_norm + block.norm[j] - gap * gap) / 2
    return out * (1 + 1e-9 * np.sign(out)) + 1


def search_block(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, block: Block, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best candidates of one block for each query, as far as they reach ``least``:
    query place, vec_id, score; and how many pairs were evaluated."""
    product, q_norm, q_far = Exact(q, block.x), squares(q), distances(q.astype(np.float64), pivots)
    upper = upper_bounds(q_norm, q_far, block)
    rank = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1, kind="stable")
    floor, best = least.copy(), np.full((len(q), k), NONE)
    hits: tuple[list, list, list] = ([], [], [])
    evaluated, a, b = 0, 0, 1
    while a < upper.shape[1]:
        # the clusters that are next in the order of bounds, for all queries they may still serve
        due = (rank >= a) & (rank < b) & (upper >= floor[:, None])
        for j in np.flatnonzero(due.any(axis=0)).tolist():
            rows = np.flatnonzero(due[:, j])
            # a candidate farther from the cluster's pivot than this from the query's distance cannot reach the floor
            reach = np.sqrt(np.maximum(0, q_norm[rows] + block.norm[j] - 2 * floor[rows].astype(np.float64))) + slack(q_norm[rows]) + slack(block.norm[j])
            own, mid = block.own[block.begin[j] : block.end[j]], q_far[rows, block.pivot[j]]
            first = block.begin[j] + int(np.searchsorted(own, (mid - reach).min()))
            last = block.begin[j] + int(np.searchsorted(own, (mid + reach).max(), side="right"))
            if first >= last:
                continue
            scores = product(rows, slice(first, last))
            scores[q_ids[rows][:, None] == block.ids[None, first:last]] = NONE
            evaluated += scores.size
            best[rows] = np.partition(np.concatenate([best[rows], scores], axis=1), -k, axis=1)[:, -k:]
            floor[rows] = np.maximum(floor[rows], best[rows].min(axis=1))
            at, place = np.nonzero((scores >= floor[rows][:, None]) & (scores > NONE))
            hits[0].append(rows[at])
            hits[1].append(block.ids[first + place])
            hits[2].append(scores[at, place])
        a, b = b, 2 * b + 1
    place, ids, scores = (np.concatenate([*h, np.zeros(0, np.int64)]) for h in hits)
    keep = scores >= floor[place]
    place, ids, scores = place[keep], ids[keep], scores[keep]
    order = np.lexsort((ids, -scores, place))
    place, ids, scores = place[order], ids[order], scores[order]
    nth = np.arange(len(place)) - np.searchsorted(place, place)
    return place[nth < k], ids[nth < k], scores[nth < k], evaluated


def _numbers(counts: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every pivot the first block of its cluster and over how many it is dealt:
    small clusters share a block, large ones have several."""
    first, pieces = np.zeros(max(counts, default=0) + 1, np.int64), np.ones(max(counts, default=0) + 1, np.int64)
    block = filled = 0
    for pivot in sorted(counts):
        n = counts[pivot]
        if filled and filled + n > size:
            block, filled = block + 1, 0
        first[pivot], pieces[pivot] = block, max(1, math.ceil(n / size))
        if n >= size:
            block += int(pieces[pivot])
        else:
            filled += n
    return first, pieces


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of every query with all other rows.

    A component x counts as floor(scale * x), x as double. ``is_query`` is a condition on
    ``vec_id``. The result has query_id, rank (from 1), vec_id, score; equal scores
    go to the smaller vec_id, and there are fewer rows where there are fewer candidates.
    Vectors that are null or hold null or non-finite components, and rows without an id,
    take no part. Scores are exact; where the lengths of vectors allow one beyond 62 bits
    the job fails. Vectors of other lengths than the query's are no candidates. A
    repeated id is a candidate as often as it occurs, and never for its own queries;
    as a query it counts once, its smallest vector.
    """
    rows = _whole(vectors, vec_id, embedding, scale).withColumn("dims", F.size("v"))
    sizes = {r.dims: (r["count"], r.q) for r in rows.groupBy("dims").agg(F.count("*").alias("count"), F.count_if(is_query).alias("q")).collect()}
    result = None
    for dims, (count, queries) in sorted(sizes.items()):
        if not queries or not dims:
            continue
        own = rows.where(F.col("dims") == dims).select("vec_id", "v")
        below = int(min(1.0, SAMPLE / count) * (1 << 30))
        # copies of one row are drawn together, so the limit alone bounds what comes here
        drawn = own.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < below).limit(2 * SAMPLE).collect()
        drawn = sorted((r.vec_id, r.v) for r in drawn)
        sample_ids = np.array([i for i, _ in drawn], dtype=np.int64)
        sample = np.array([v for _, v in drawn], dtype=np.int64).reshape(len(drawn), dims)
        found = _search(own, is_query, k, dims, sample_ids, sample)
        result = found if result is None else result.union(found)
    if result is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    ranked = result.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(own: DataFrame, is_query: Column, k: int, dims: int, sample_ids: np.ndarray, sample: np.ndarray) -> DataFrame:
    pivots = _pivots(sample.astype(np.float64), PIVOTS)
    if not len(pivots):  # a sample may come out empty; any pivot will do
        pivots = np.zeros((1, dims))
    sent = share(own.sparkSession, (pivots, sample_ids, sample))

    def to_vectors(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, _, _ = received(sent)
        for batch in batches:
            if batch.num_rows:
                nearest = distances(to_vectors(batch.column(1)).astype(np.float64), pivots).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32())], ["vec_id", "v", "pivot"])

    asked = own.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    clustered, asked = (df.mapInArrow(near, "vec_id long, v array<long>, pivot int") for df in (own, asked))

    def dealt(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        """Rows with the block they go to, and how many blocks there are; as many counts as pivots come here."""
        counts = {r.pivot: r["count"] for r in df.groupBy("pivot").count().collect()}
        first, pieces = _numbers(counts, size)
        # copies of one row are spread too
        where = F.expr(f"array({','.join(f'{n}L' for n in first)})[pivot] + pmod(monotonically_increasing_id(), array({','.join(f'{n}L' for n in pieces)})[pivot])")
        return df.withColumn("block", where), int((first + pieces).max())

    clustered, blocks = dealt(clustered, BLOCK)
    asked, parts = dealt(asked, QUERIES)

    def pack(table: pa.Table) -> pa.Table:
        """One row: ids and vectors, and the ranges that hold for all of them."""
        pivots, ids_known, known = received(sent)
        ids, x = table.column("vec_id").to_numpy().astype(np.int64), to_vectors(table.column("v").combine_chunks())
        far, norm = distances(x.astype(np.float64), pivots), squares(x)
        least = np.full(len(ids), NONE)
        if len(ids_known) > k:
            product = Exact(x, known)
            for a in range(0, len(ids), 256):
                scores = product(slice(a, a + 256), slice(None))
                scores[ids[a : a + 256, None] == ids_known[None]] = NONE
                least[a : a + 256] = np.partition(scores, -k, axis=1)[:, -k]
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int64()),
            "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()), "least": pa.array([least.tobytes()], pa.binary()),
            "low": pa.array([far.min(axis=0)], pa.list_(pa.float64())), "high": pa.array([far.max(axis=0)], pa.list_(pa.float64())),
            "norm": pa.array([norm.max()], pa.float64()), "floor": pa.array([least.min()], pa.int64()),
        })

    packed = "block long, ids binary, x binary, least binary, low array<double>, high array<double>, norm double, floor long"
    ranges = ["low", "high", "norm", "floor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, _, _ = received(sent)
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, least = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_least"], np.int64)
                q = np.frombuffer(row["q_x"], np.int64).reshape(-1, dims)
                block = Block(np.frombuffer(row["c_ids"], np.int64), np.frombuffer(row["c_x"], np.int64).reshape(-1, dims), pivots)
                place, ids, scores, _ = search_block(q_ids, q, least, block, pivots, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[place], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64()), pa.array(np.arange(len(ids)), pa.int64())],
                    names=["query_id", "vec_id", "score", "copy"],
                )

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col("block").alias("b" if side == "c" else "p"), *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "block"])

    # stored: where a row was dealt must not change between the ranges and the vectors
    left = named(stage(clustered.groupBy("block").applyInArrow(pack, packed)), "c")
    right = named(stage(asked.groupBy("block").applyInArrow(pack, packed)), "q")
    # A pair of block and part can be left out if no distance is so small that a query could reach its threshold.
    gap = F.array_max(F.zip_with(
        F.zip_with("c_low", "q_high", lambda a, b: a - b), F.zip_with("q_low", "c_high", lambda a, b: a - b), lambda a, b: F.greatest(a, b)
    ))
    gap = F.greatest(F.lit(0.0), gap - 1e-6 * (F.sqrt("c_norm") + F.sqrt("q_norm")) - 1e-2)
    most = (F.col("c_norm") + F.col("q_norm") - gap * gap) / 2
    c_ranges = left.select("b", *[f"c_{c}" for c in ranges]).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    q_ranges = right.select("p", *[f"q_{c}" for c in ranges])
    pairs = c_ranges.join(q_ranges, "p").where(most + F.abs(most) * 1e-9 + 1 >= F.col("q_floor")).select("b", "p")
    met = pairs.join(left.select("b", "c_ids", "c_x"), "b").join(right.select("p", "q_ids", "q_x", "q_least"), "p")
    return met.select("c_ids", "c_x", "q_ids", "q_x", "q_least").mapInArrow(run, "query_id long, vec_id long, score long, copy long")
