"""Exact self-join on word n-gram Jaccard similarity by partitioning the token universe.

Two sets with J(x, y) >= t differ in at most (1-t)/(1+t) * (|x|+|y|) tokens. Sizes are
cut into bands, each 1/t as wide as the one below, so that partners lie in one band or
in neighbouring ones; a set takes part in the *instance* of its own band and in that of
the next. Instance i with largest size U hashes the universe into a little more than
H+1 segments, H = 2U(1-t)/(1+t). Partners then agree wholly on all but H of them.

* **Index side.** Each set files the content hash of every non-empty segment (and, in
  instances of small sets, of every segment less one token).
* **Probe side.** A set needs segments that cover H(x)+1 differences, H(x) being the
  bound for its own size. An exact segment covers one, a segment with its one-deletion
  neighbourhood two. The cheapest are allocated: segments of more tokens before those
  of few, and last those made only of tokens that a bounded sample of documents shows
  to be common.
* A pair is found if either side probes. Sets that cannot cover H(x)+1 file all their
  tokens too, so that two of these meet there (partners share at least one token).

In a group of sets with one signature up to ``SMALL`` probers are paired with all of it.
Groups with more are not expanded: they give a star around the smallest id. Candidates
must pass two exact bounds before their sets are fetched: the ratio of sizes, and the
parities of hash bins, as many as tokens or more, of which no more can differ than tokens
do. The rest is verified on the whole sets, which are made where the texts lie and sent straight to the
pairs, to all pairs with one first id together. Groups that then still hold several
components are compared across components by the bounds and then on the whole sets, a
block of about ``GROUP`` members at a time. Every component is compared until it is joined:
a meeting of two blocks gives the links that join its components and no others, so never
more of them than it has members. Last the members of large groups are compared within
their components, blocks of whole sets at a time, so that every link is counted.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from caseflow.llm.common import components, hash_words, mix, ngrams_many, only, slices
from caseflow.session import settings
from caseflow.sources.scratch import discard, stage

SMALL = 6  # probers of a group that are paired with all of it
GROUP = 2048  # members of a larger group compared at a time, once stars did not settle it
GROUP_BYTES = 16_000_000  # of their sets, about
PAIRS = 1 << 16  # pairs of members whose parities are compared in one step
BLOCK = 64  # sets of a component, about, that are compared at a time
LEAVES = 256  # partners, about, that one copy of a set is sent to
DELETE = 8  # instances with H up to here file one-deletion neighbourhoods
FLUSH = 1_000_000  # signatures a task gathers before it deals them into buckets
BUCKET_BYTES = 12_000_000  # signatures of one bucket
SAMPLE = 2_000  # documents in the sample that shows common tokens
BITS = 1024  # hash bins, at least, whose parities bound the difference of two sets
STEP_BYTES = 32_000_000  # of parities that are compared in one step
BLOCK_BYTES = 8_000_000  # of sets, about, that are compared at a time
FEW = 500_000  # ids, some megabytes, that may be sent to all executors
K = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text, one after the
    other, and where each begins (one entry more than there are texts)."""
    grams, ends = ngrams_many(*hash_words(texts), n)
    bounds = ends.tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    fresh[ends[:-1][ends[:-1] < len(grams)]] = True
    return grams[fresh], np.concatenate([[0], np.cumsum(fresh)])[ends]


def set_ids(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each set; equal sets have equal ids; 0 for the empty set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens), dtype=np.uint64)])
    sizes = np.diff(starts)
    ids = mix(sums[starts[1:]] - sums[starts[:-1]] + sizes.astype(np.uint64) * K).astype(np.int64)
    return np.where(sizes == 0, 0, np.where(ids == 0, 1, ids))


def parities(tokens: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Whether each of a set's bins holds an odd number of its tokens: ``BITS`` bins, or as
    often twice as many until there are no fewer bins than tokens."""
    bins = (mix(tokens ^ K) >> np.uint64(32)).astype(np.int64)
    bounds = starts.tolist()
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        most = BITS << max(0, math.ceil(math.log2(max(1, b - a) / BITS)))
        out.append(np.packbits((np.bincount(bins[a:b] % most, minlength=most) & 1).astype(np.uint8)).tobytes())
    return out


def folded(parity: list[bytes], width: int) -> np.ndarray:
    """Parities of one length as rows of ``width`` bytes: of more bins those that fall together are added."""
    rows = np.frombuffer(b"".join(parity), np.uint64).reshape(len(parity), -1, width // 8)
    return np.bitwise_xor.reduce(rows, axis=1)


def plausible(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, bands: Bands) -> np.ndarray:
    """Whether sizes n, m and parities p, q (bytes, as objects) leave a link possible."""
    most = (n + m) * (bands.den - bands.num) // (bands.den + bands.num)
    out = bands.den * np.minimum(n, m) >= bands.num * np.maximum(n, m)
    long_p, long_q = (np.fromiter(map(len, c), np.int64, len(c)) for c in (p, q))
    for x, y in np.unique(np.stack([long_p[out], long_q[out]], axis=1), axis=0).tolist():
        places = np.flatnonzero(out & (long_p == x) & (long_q == y))
        for at in range(0, len(places), step := max(1, STEP_BYTES // (x + y))):
            own = places[at : at + step]
            differ = np.bitwise_count(folded(p[own].tolist(), min(x, y)) ^ folded(q[own].tolist(), min(x, y))).sum(axis=1, dtype=np.int64)
            out[own] = differ <= most[own]
    return out


def _objects(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


class Bands:
    """Largest size, difference bound and segment count of each instance."""

    def __init__(self, num: int, den: int, top: int = 2**31):
        self.num, self.den = num, den
        self.upper = [1]
        while self.upper[-1] < top:
            self.upper.append(max(self.upper[-1] + 1, self.upper[-1] * den // num))

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def differ_all(self, upper: np.ndarray) -> np.ndarray:
        return 2 * upper * (self.den - self.num) // (self.den + self.num)

    def segments(self, i: int) -> int:
        return math.ceil(1.2 * (self.differ(self.upper[i], self.upper[i]) + 1)) + 1

    def bound(self, size: int, i: int) -> int:
        """Most differences between a set of this size and any partner in instance i."""
        return self.differ(size, min(self.upper[i], size * self.den // self.num))


def signatures(tokens: np.ndarray, starts: np.ndarray, bands: Bands, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of non-empty sets, the place of the set each belongs to, whether it probes.

    A set's tokens are sorted, and segments are equal ranges of the hashed universe, so
    a segment is a run of neighbours.
    """
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    usual = np.zeros(len(tokens), bool)
    if len(common):
        usual = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
    own_band = np.array([bisect_left(bands.upper, n) for n in sizes.tolist()], dtype=np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in (0, 1):
        band = own_band + step
        upper = np.array([bands.upper[i] for i in band.tolist()], dtype=np.int64)
        m = np.array([bands.segments(i) for i in band.tolist()], dtype=np.uint64)
        need = np.array([bands.bound(n, i) + 1 for n, i in zip(sizes.tolist(), band.tolist(), strict=True)])
        place = ((tokens >> np.uint64(32)) * m[owner]) >> np.uint64(32)
        new = np.ones(len(tokens), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(tokens)))
        whose = owner[first]
        mixed = mix(tokens + K)
        sums = np.add.reduceat(mixed, first) + mix(place[first] + (band[whose] << 40).astype(np.uint64))
        rare = np.add.reduceat(~usual, first, dtype=np.int64)
        # few tokens agree more easily by chance, and only common ones even more so
        cost = np.where(rare == 0, 3, np.where(length == 1, 2, np.where(length == 2, 1, 0)))
        dear = cost > 1
        begin = np.searchsorted(whose, np.arange(len(sizes)))
        held = np.diff(np.append(begin, len(whose)))
        order = np.argsort(whose * 4 + cost, kind="stable")
        probe = np.empty(len(whose), bool)
        probe[order] = np.arange(len(whose)) - begin[whose] < need[whose]
        small = bands.differ_all(upper) <= DELETE
        deletable = small[whose] & (length >= 2)
        widened = np.zeros(len(whose), bool)
        lacking = np.zeros(len(sizes), bool)
        pays_dear = np.zeros(len(sizes), bool)
        pays_dear[whose[dear & probe]] = True
        for x in np.flatnonzero((pays_dear & small) | (held < need)).tolist():
            a, b = int(begin[x]), int(begin[x] + held[x])
            probe[a:b], widened[a:b], covered = allocate(dear[a:b], deletable[a:b], int(need[x]))
            lacking[x] = covered < need[x]
        out.append((mix(sums), whose, probe))
        if deletable.any():
            segment = np.repeat(np.arange(len(whose)), length)
            keep = deletable[segment]
            segment = segment[keep]
            out.append((mix(sums[segment] - mixed[keep]), whose[segment], widened[segment]))
        if lacking.any():
            keep = lacking[owner]
            salt = mix((band[owner[keep]] + 1).astype(np.uint64))
            out.append((mix(tokens[keep] + salt), owner[keep], np.ones(int(keep.sum()), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def allocate(dear: np.ndarray, deletable: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which segments of one set probe, which with their deletions, and what that covers.

    Cheap segments first; then a deletion neighbourhood of a cheap segment, which covers
    one difference more; then segments of common tokens alone; then their neighbourhoods.
    """
    probe, widened, covered = np.zeros(len(dear), bool), np.zeros(len(dear), bool), 0
    for target, places in (
        (probe, np.flatnonzero(~dear)), (widened, np.flatnonzero(~dear & deletable)),
        (probe, np.flatnonzero(dear)), (widened, np.flatnonzero(dear & deletable)),
    ):
        taken = places[: max(0, need - covered)]
        target[taken] = True
        covered += len(taken)
    return probe, widened, covered


_PACKED = "bucket int, chunk binary, groups binary"
_U40 = np.uint64((1 << 40) - 1)


def _deal(docs: DataFrame, shingle: int, bands: Bands, common: np.ndarray, buckets: int) -> DataFrame:
    """Signatures of all sets, packed into one row per bucket and flush.

    ``chunk`` holds the ids, then for each signature its 40 low bits, place of its id
    and probe flag. Of a signature that more than ``SMALL`` sets of one flush share, the
    chunk holds the smallest id alone; ``groups`` lists the members.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def flush(numbers: np.ndarray, sig: np.ndarray, owner: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
        bucket = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((sig & _U40, bucket))
        sig, owner, probe, bucket = sig[order] & _U40, owner[order], probe[order], bucket[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (bucket[1:] != bucket[:-1])])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(sig)))
        keep = np.ones(len(sig), bool)
        large: dict[int, list[np.ndarray]] = {}
        for s in np.flatnonzero(length > SMALL).tolist():
            a, b = int(start[s]), int(start[s] + length[s])
            members = np.unique(numbers[owner[a:b]])
            if len(members) > SMALL:
                head = np.array([sig[a].astype(np.int64), len(members)], dtype=np.int64)
                large.setdefault(int(bucket[a]), []).append(np.concatenate([head, members]))
                keep[a:b] = False
                keep[a] = True
                owner[a] = owner[a:b][np.argmin(numbers[owner[a:b]])]
                probe[a] = probe[a:b].any()
        sig, owner, probe, bucket = sig[keep], owner[keep], probe[keep], bucket[keep]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
        rows: tuple[list, list, list] = ([], [], [])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            used, local = np.unique(owner[a:b], return_inverse=True)
            s = sig[a:b]
            chunk = b"".join((
                np.array([len(used), b - a], dtype=np.int64).tobytes(), numbers[used].tobytes(),
                (s & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (s >> np.uint64(32)).astype(np.uint8).tobytes(),
                ((local.astype(np.uint32) << 1) | probe[a:b]).astype(np.uint32).tobytes() if len(used) > 32000
                else ((local.astype(np.uint16) << 1) | probe[a:b]).astype(np.uint16).tobytes(),
            ))
            rows[0].append(int(bucket[a]))
            rows[1].append(chunk)
            groups = large.get(int(bucket[a]))
            rows[2].append(np.concatenate(groups).tobytes() if groups else None)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())],
            names=["bucket", "chunk", "groups"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        ids: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = held = 0
        for part in slices(batches, "text"):
            tokens, starts = shingle_sets(part.column(0).to_pylist(), shingle)
            numbers = set_ids(tokens, starts)
            fresh = np.zeros(len(numbers), bool)
            if len(seen) >= 100_000:
                seen.clear()
            for i, number in enumerate(numbers.tolist()):
                if number and number not in seen:  # an exact copy met by this task files nothing new
                    seen.add(number)
                    fresh[i] = True
            if not fresh.any():
                continue
            sizes = np.diff(starts)
            tokens = tokens[np.repeat(fresh, sizes)]
            sig, owner, probe = signatures(tokens, np.concatenate([[0], np.cumsum(sizes[fresh])]), bands, shared.value)
            ids.append(numbers[fresh])
            parts.append((sig, owner + count, probe))
            count += int(fresh.sum())
            held += len(sig)
            if held >= FLUSH:
                yield flush(np.concatenate(ids), *(np.concatenate(x) for x in zip(*parts, strict=True)))
                ids, parts, count, held = [], [], 0, 0
        if ids:
            yield flush(np.concatenate(ids), *(np.concatenate(x) for x in zip(*parts, strict=True)))

    return only(docs, "text").mapInArrow(run, _PACKED)


def _unpack(chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count, rows = np.frombuffer(chunk, dtype=np.int64, count=2).tolist()
    at = 16
    ids = np.frombuffer(chunk, dtype=np.int64, count=count, offset=at)
    at += 8 * count
    low = np.frombuffer(chunk, dtype=np.uint32, count=rows, offset=at).astype(np.uint64)
    at += 4 * rows
    high = np.frombuffer(chunk, dtype=np.uint8, count=rows, offset=at).astype(np.uint64)
    at += rows
    flagged = np.frombuffer(chunk, dtype=np.uint32 if count > 32000 else np.uint16, count=rows, offset=at)
    return low | (high << np.uint64(32)), ids[flagged >> 1], (flagged & 1).astype(bool)


def _meet(packed: DataFrame) -> DataFrame:
    """Candidates (a, b) and large groups (a: signature, b: bucket, members) of each bucket."""

    def run(t: pa.Table) -> pa.Table:
        sig, ids, probe = (np.concatenate(x) for x in zip(*map(_unpack, t.column("chunk").to_pylist()), strict=True))
        bucket = t.column("bucket")[0].as_py()
        listed: dict[int, list[np.ndarray]] = {}
        for blob in t.column("groups").to_pylist():
            data = np.frombuffer(blob, dtype=np.int64) if blob else ()
            at = 0
            while at < len(data):
                size = int(data[at + 1])
                listed.setdefault(int(data[at]), []).append(data[at + 2 : at + 2 + size])
                at += 2 + size
        order = np.lexsort((ids, sig))
        sig, ids, probe = sig[order], ids[order], probe[order]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        length = np.diff(np.append(start, len(sig)))
        found = np.logical_or.reduceat(probe, start)
        many = np.isin(sig[start], np.array(list(listed), dtype=np.uint64)) if listed else np.zeros(len(start), bool)
        pairs, groups = [], []
        two = found & ~many & (length == 2)
        pairs.append(np.stack([ids[start[two]], ids[start[two] + 1]], axis=1))
        for s in np.flatnonzero(found & (many | (length > 2))).tolist():
            own = slice(start[s], start[s] + length[s])
            lists = listed.get(int(sig[start[s]]), ())
            members = np.unique(np.concatenate([ids[own], *lists]))
            asking = np.unique(np.concatenate([ids[own][probe[own]], *lists]))
            if len(asking) <= SMALL:  # only pairs with a prober count
                i, j = np.repeat(asking, len(members)), np.tile(members, len(asking))
                pairs.append(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1))
            else:
                pairs.append(np.stack([np.full(len(members) - 1, members[0]), members[1:]], axis=1))
                groups.append((int(sig[start[s]]), members))
        both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        both = both[both[:, 0] != both[:, 1]]
        same: dict[bytes, tuple[int, np.ndarray]] = {}
        for s, members in groups:  # many signatures of near copies list the same members
            same.setdefault(members.tobytes(), (s, members))
        return pa.table({
            "a": pa.array([*both[:, 0].tolist(), *(s for s, _ in same.values())], pa.int64()),
            "b": pa.array([*both[:, 1].tolist(), *(bucket for _ in same)], pa.int64()),
            "members": pa.array([None] * len(both) + [m for _, m in same.values()], pa.list_(pa.int64())),
        })

    return packed.groupBy("bucket").applyInArrow(run, "a long, b long, members array<long>")


def _bounded(pairs: DataFrame, traits: DataFrame, bands: Bands) -> DataFrame:
    """Those pairs (a, b) that the bounds leave; traits: (id, n, parity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(i).to_numpy() for i in (2, 3))
                p, q = (_objects(batch.column(i)) for i in (4, 5))
                yield batch.select([0, 1]).filter(pa.array(plausible(n, m, p, q, bands)))

    left = traits.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("parity").alias("p"))
    right = traits.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("parity").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "p", "q").mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return den * common >= num * (len(x) + len(y) - common)


def _meetings(pairs: DataFrame) -> DataFrame:
    """(id, to) of every id in ``pairs`` (a, b): where its set is needed, as (hub, piece, leaf).
    The pairs of one ``a`` meet there, about ``LEAVES`` of them in a piece."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEAVES).cast("int").alias("parts"))
    piece = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("piece")
    ends = F.array(F.struct(F.col("b").alias("id"), F.lit(True).alias("leaf")), F.struct(F.col("a").alias("id"), F.lit(False).alias("leaf")))
    met = pairs.join(parts, "a").select(F.col("a").alias("hub"), piece, F.explode(ends).alias("end"))
    return met.select("end.id", "hub", "piece", "end.leaf").distinct().groupBy("id").agg(F.collect_list(F.struct("hub", "piece", "leaf")).alias("to"))


def _verify(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose sets reach the similarity; sets: (id, tokens binary, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: of each hub and piece the hub's own set first, then its partners'."""
        hub, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            pairs: tuple[list, list] = ([], [])
            for a, leaf, b, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if not leaf:
                    hub, x = a, np.frombuffer(tokens.as_buffer(), dtype=np.uint64).copy()
                elif hub == a and _linked(x, np.frombuffer(tokens.as_buffer(), dtype=np.uint64), num, den):
                    pairs[0].append(a)
                    pairs[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in pairs], names=["a", "b"])

    # one exchange carries both sides: each set as often as it is needed
    sent = sets.select("id", "tokens", F.inline("to")).select("hub", "piece", "leaf", "id", "tokens")
    met = sent.repartition("hub", "piece").sortWithinPartitions("hub", "piece", "leaf")
    return met.mapInArrow(run, "a long, b long").distinct()


def similar(docs: DataFrame, shingle: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """Component of every row under links J >= num/den between distinct shingle sets.

    ``docs`` needs ``doc_id`` and ``text``. The result has one row per row of ``docs``:
    doc_id, n_shingles, component_id, the smallest doc_id reachable by links (of a
    row's equals too), n_links, the number of different sets its set is linked with
    directly. A text with fewer words than ``shingle`` is one shingle; null or empty
    texts have the empty set, which links with nothing: their component_id is their
    own doc_id. Null ids are passed over when looking for the smallest. Repeated rows
    stay repeated. Shingles and sets are compared by 64-bit hashes.
    """
    bands = Bands(num, den)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = only(docs, "doc_id", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            tokens, starts = shingle_sets(part.column(1).to_pylist(), shingle)
            ids = set_ids(tokens, starts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(starts), pa.int64()), pa.array(ids, pa.int64(), mask=ids == 0), pa.array(parities(tokens, starts), pa.binary())],
                names=["doc_id", "n_shingles", "id", "parity"],
            )

    rows = stage(docs.mapInArrow(measure, f"doc_id {kind}, n_shingles long, id long, parity binary"))
    total, filled = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("id")).first()

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            tokens, starts = shingle_sets(part.column(0).to_pylist(), shingle)
            ids, raw, at = set_ids(tokens, starts), tokens.tobytes(), (starts * 8).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=ids == 0), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=["id", "tokens"],
            )

    # A sample of documents, its size bounded by SAMPLE, shows which tokens are common;
    # this steers the cost of probing alone, never what is found.
    share = min(1.0, SAMPLE / max(1, filled))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.substring("text", 1, 100_000).alias("text"))

    def tokens_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            tokens, _ = shingle_sets(part.column(0).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])

    counted = drawn.mapInArrow(tokens_only, "token long").groupBy("token").count().where("count >= 4")
    common = np.sort(np.array([r.token for r in counted.orderBy(F.desc("count")).limit(100_000).collect()], dtype=np.int64).view(np.uint64))

    buckets = max(1, math.ceil(total * 8 / BUCKET_BYTES))
    candidates = stage(_meet(_deal(docs, shingle, bands, common, buckets)))
    pairs = candidates.where("members is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    groups = candidates.where("members is not null")
    per_set = rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity"))
    per_set = stage(per_set)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(id, tokens, ...) of the wanted (id, ...): one document for each set, then its shingles again."""
        wanted = stage(wanted.join(per_set.select("id", "doc_id"), "id"))
        more = [f for f in wanted.schema if f.name not in ("id", "doc_id")]
        extra = [f.name for f in more]
        schema = StructType([StructField("id", LongType()), StructField("tokens", BinaryType()), *more])

        def wanted_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # texts of a repeated doc_id may differ, and copies need be sent once
            seen: set[int] = set()
            for part in slices(batches, "text"):
                tokens, starts = shingle_sets(part.column(0).to_pylist(), shingle)
                raw, at, ids = tokens.tobytes(), (starts * 8).tolist(), set_ids(tokens, starts).tolist()
                keep = []
                for i, (found, asked) in enumerate(zip(ids, part.column(1).to_pylist(), strict=True)):
                    if found == asked and found not in seen:
                        keep.append(i)
                        seen.add(found)
                kept = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(1), pa.array([raw[at[i] : at[i + 1]] for i in keep], pa.binary()), *kept.columns[2:]], names=["id", "tokens", *extra]
                )

        chosen = wanted.where("doc_id is not null")
        if not extra and chosen.count() <= FEW or extra and (chosen.agg(F.sum(F.size("to"))).first()[0] or 0) <= FEW:
            chosen = F.broadcast(chosen)  # spares a shuffle of all texts; beyond, Spark joins by shuffle
        named = docs.join(chosen, "doc_id").select("text", "id", *extra).mapInArrow(wanted_only, schema)
        # rows without doc_id cannot be chosen by it: their sets are
        unnamed = docs.where("doc_id is null").select("text").mapInArrow(tokens_of, "id long, tokens binary")
        unnamed = unnamed.join(wanted.where("doc_id is null").drop("doc_id"), "id").select("id", "tokens", *extra).dropDuplicates(["id"])
        return named.union(unnamed)

    bounded = stage(_bounded(pairs, per_set.select("id", "n", "parity"), bands))
    links = stage(_verify(sets_of(_meetings(bounded)), num, den))
    discard(bounded)
    roots = components(links, stage, discard)

    # Groups that the stars left in several components: compare across these. What is known
    # of a member is joined to it once, with the list of its groups, not once for each of them.
    placed = _merged(groups).groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("to"))
    placed = placed.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(per_set.select("id", "n", "parity"), "id")
    placed = stage(placed)
    flat = placed.select("id", "root", "n", "parity", F.inline("to"))
    open_ = flat.groupBy("a", "b").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("a", "b", "size")
    met = stage(flat.join(open_, ["a", "b"]))
    discard(placed)
    if not met.isEmpty():
        sets = sets_of(met.select("id").distinct()).dropDuplicates(["id"])
        with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):
            joined = stage(_across(met, bands, sets))
        links = stage(links.union(joined))
        roots = components(links, stage, discard)

    # Links within the components of large groups, of which the stars tell nothing.
    members = groups.select(F.explode("members").alias("id")).distinct().join(roots, "id").join(per_set.select("id", "n", "parity"), "id")
    members = stage(members.select("id", "root", "n", "parity"))
    ends = links.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    if members.isEmpty():
        ends = ends.groupBy("id").agg(F.count("*").alias("n_links"))
    else:
        sets = sets_of(members.select("id")).dropDuplicates(["id"])
        # a row is two blocks of sets: few to an Arrow batch
        with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
            inside = stage(_within(members, sets, bands))
        # links of two members are counted there, those of others here
        both = links.join(members.select(F.col("id").alias("a")), "a", "left_semi").join(members.select(F.col("id").alias("b")), "b", "left_semi")
        ends = ends.join(both, ["a", "b"], "left_anti").groupBy("id").agg(F.count("*").alias("n_links"))
        ends = ends.union(inside.select("id", "n_links")).groupBy("id").agg(F.sum("n_links").alias("n_links"))

    # Counts and minima per set first: copies of one set may hold a third of all rows.
    per_set = per_set.select("id", F.col("doc_id").alias("least")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    per_root = per_set.groupBy("root").agg(F.min("least").alias("component_id"))
    per_set = per_set.join(per_root, "root").join(ends, "id", "left").select("id", "component_id", "n_links")
    return rows.join(per_set, "id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _merged(groups: DataFrame) -> DataFrame:
    """(a, b, id) of every member of ``groups`` (a, b, members), groups in one where that
    leaves fewer pairs to compare: many signatures of near copies list nearly the same
    members, and so have the same member of the smallest hash."""
    flat = groups.select("a", "b", F.size("members").alias("size"), F.explode("members").alias("id"))
    flat = flat.withColumn("hash", F.xxhash64("id"))
    keyed = flat.groupBy("a", "b").agg(F.min("hash").alias("key"), F.first("size").cast("double").alias("size"))
    apart = keyed.groupBy("key").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
    flat = stage(flat.drop("hash", "size").join(keyed.select("a", "b", "key"), ["a", "b"]))
    together = flat.groupBy("key", "id").agg(F.lit(1).alias("one"))
    worth = together.groupBy("key").agg(F.count("*").cast("double").alias("union")).join(apart, "key")
    worth = stage(worth.select("key", (F.col("union") * F.col("union") <= F.col("pairs")).alias("merge")))
    # signatures are of 40 bits and buckets above -1: a merged group is none of them
    flat = flat.join(worth, "key").select("id", F.when(F.col("merge"), F.col("key")).otherwise(F.col("a")).alias("a"), F.when(F.col("merge"), -1).otherwise(F.col("b")).cast("long").alias("b"))
    return stage(flat.distinct())


def _joining(p: np.ndarray, q: np.ndarray, label: np.ndarray, tokens: np.ndarray, bands: Bands) -> list[int]:
    """Which pairs of places p, q are links that join two labels; those become one in ``label``."""
    out = []
    for at, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        if label[x] != label[y] and _linked(np.frombuffer(tokens[x], np.uint64), np.frombuffer(tokens[y], np.uint64), bands.num, bands.den):
            label[label == label[y]] = label[x]
            out.append(at)
    return out


def _across(flat: DataFrame, bands: Bands, sets: DataFrame | None = None) -> DataFrame:
    """Pairs across components of groups (a, b, size, id, root, n, parity) that the bounds
    leave, block against block. With sets (id, tokens) only links, and of these in each
    meeting one for every two components that it joins."""
    parts = F.ceil(F.greatest(F.max("size") / GROUP, F.sum("n") * 8 / GROUP_BYTES)).cast("int").alias("parts")
    dealt = flat.join(flat.groupBy("a", "b").agg(parts), ["a", "b"])
    if sets is not None:
        # a set is joined to its member once: its groups, no more than it has signatures, wait in a list
        lists = dealt.groupBy("id").agg(*(F.first(c).alias(c) for c in ("root", "n", "parity")), F.collect_list(F.struct("a", "b", "parts")).alias("to"))
        dealt = lists.join(sets, "id").select("id", "root", "n", "parity", "tokens", F.inline("to"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # blocks i <= j meet: a member is sent to every meeting of its block, once
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meeting = ["a", "b", "i", "j"]
    traits = ["id", "root", "n", "parity"] if sets is None else ["id", "root", "n", "parity", "tokens"]
    sent = sent.select("a", "b", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *traits)

    def compare(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        i, j, block, ids, root, n, parity, *tokens = own
        label = root.copy()
        x = np.flatnonzero(block == i[0])
        y = x if i[0] == j[0] else np.flatnonzero(block == j[0])
        step = max(1, PAIRS // max(1, len(y)))
        for at in range(0, len(x), step):
            rows = x[at : at + step]
            far = (label[rows][:, None] != label[y][None]) & (bands.den * np.minimum(n[rows][:, None], n[y][None]) >= bands.num * np.maximum(n[rows][:, None], n[y][None]))
            if i[0] == j[0]:
                far &= ids[rows][:, None] < ids[y][None]
            p, q = np.nonzero(far)
            p, q = rows[p], y[q]
            keep = plausible(n[p], n[q], parity[p], parity[q], bands)
            p, q = p[keep], q[keep]
            if tokens:
                keep = _joining(p, q, label, tokens[0], bands)
                p, q = p[keep], q[keep]
            p, q = ids[p], ids[q]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q), pa.int64()), pa.array(np.maximum(p, q), pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by meeting; one may go on in the next batch."""
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(8)]
            fresh += [_objects(c) for c in batch.columns[8:]]
            held = fresh if held is None else [np.concatenate(c) for c in zip(held, fresh, strict=True)]
            new = np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)
            edges = [0, *(np.flatnonzero(new) + 1).tolist()]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                yield from compare([c[start:stop] for c in held[2:]])
            held = [c[edges[-1] :] for c in held]
        if held is not None:
            yield from compare(held[2:])

    met = sent.repartition(*meeting).sortWithinPartitions(*meeting)
    return met.mapInArrow(run, "a long, b long").distinct()


def _within(members: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """With how many ``members`` (id, root, n, parity) of its root each is linked, (id, n_links),
    block against block; sets: (id, tokens)."""
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("parts"))
    dealt = members.join(sets, "id").join(sizes.where("parts > 0"), "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    packed = dealt.groupBy("root", "block").agg(F.collect_list(F.struct("id", "n", "parity", "tokens")).alias("m"), F.first("parts").alias("parts"))
    packed = stage(packed)
    own = packed.select("root", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("parts") - 1)).alias("j"), F.col("m").alias("x"))
    other = packed.select("root", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("m").alias("y"))

    def arrays(members: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        ids, n = (np.array([m[c] for m in members], dtype=np.int64) for c in ("id", "n"))
        parity = np.empty(len(ids), object)
        parity[:] = [m["parity"] for m in members]
        return ids, n, parity, [np.frombuffer(m["tokens"], np.uint64) for m in members]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x_id, x_n, x_p, x_t = arrays(x.as_py())
                y_id, y_n, y_p, y_t = arrays(y.as_py())
                # of a block that meets itself each pair is taken once
                i, j = np.nonzero(x_id[:, None] < y_id[None] if same else x_id[:, None] != y_id[None])
                keep = plausible(x_n[i], y_n[j], x_p[i], y_p[j], bands)
                i, j = i[keep], j[keep]
                linked = np.array([_linked(x_t[a], y_t[b], bands.num, bands.den) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)
                ids, counts = np.unique(np.concatenate([x_id[i[linked]], y_id[j[linked]]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_links"])

    met = own.join(other, ["root", "i", "j"]).select("x", "y", (F.col("i") == F.col("j")).alias("same"))
    return met.mapInArrow(run, "id long, n_links long").groupBy("id").agg(F.sum("n_links").alias("n_links"))
