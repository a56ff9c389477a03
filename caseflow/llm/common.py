"""Helpers that several operators share."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Send a value of bounded size to all executors along with the classes it needs."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> object:
    return cloudpickle.loads(sent.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, matched exactly, so that further columns cannot clash."""
    return df.select(*(df[f"`{c}`"] for c in columns))


def remainder(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; of the empty text where it is null."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def crc_remainder(value: object, n: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % n


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8").translate(_LOWER).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit sways every output bit."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words begin.

    The second array has one entry more than there are texts. A word's hash is a
    polynomial in its lower-cased bytes, taken from running sums over all of them at
    once and brought to the same power by the inverse of the base, then mixed.
    """
    raw = [t.encode("utf-8") + b"\n" if t else b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw).translate(_LOWER), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    space = _SPACE[data]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    hashes = (sums[last] - sums[first]) * _powers(_INVERSE, len(data))[first]
    hashes = mix(hashes + (last - first).astype(np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return hashes, np.searchsorted(first, bounds)


_ROLL = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` words, in order; of the whole if there are fewer words."""
    count = len(hashes)
    if count == 0:
        return hashes
    n_used = min(n, count)
    out = np.zeros(count - n_used + 1, dtype=np.uint64)
    for i in range(n_used):
        out += hashes[i : count - n_used + 1 + i] * _ROLL[i % 8]
    return mix(out + np.uint64(n_used))


def ngrams_many(hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of many texts at once, given as ``hash_words`` gives them."""
    counts = np.diff(starts)
    out = np.where(counts == 0, 0, np.maximum(1, counts - n + 1))
    ends = np.concatenate([[0], np.cumsum(out)])
    result = np.empty(ends[-1], dtype=np.uint64)
    long_ = counts >= n
    if long_.any():
        total = len(hashes)
        grams = np.full(total - n + 1, np.uint64(n), dtype=np.uint64)
        for i in range(n):
            grams += hashes[i : total - n + 1 + i] * _ROLL[i % 8]
        inside = np.repeat(long_, counts)[: total - n + 1]
        left = np.repeat(starts[1:], counts)[: total - n + 1] - np.arange(total - n + 1)
        result[np.repeat(long_, out)] = mix(grams[inside & (left >= n)])
    for t in np.flatnonzero(~long_ & (counts > 0)).tolist():
        result[ends[t]] = ngrams(hashes[starts[t] : starts[t + 1]], n)[0]
    return result, ends


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        start, rows = 0, batch.num_rows
        if not rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = column.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False))
        base = 0
        while start < rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def components(links: DataFrame, stage, discard=lambda *tables: None) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b); root is the smallest id reachable.

    Alternates large-star and small-star: each round hangs a node's neighbours on the
    smallest of them, so chains halve and stars settle at once. Every round is a
    minimum per node, combined before its shuffle, and a join on the node; the edges
    are written out per round (``stage``), which cuts the lineage, and those of the round
    before removed (``discard``).
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stage(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(before)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)
