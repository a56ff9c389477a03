"""Byte-level BPE by segment trees over the ranks of adjacent pairs.

Each piece of text is a row of bytes. The leaves of its tree are the ranks of the
pairs (token, next token); a node holds the smaller of its children, so the root is
the lowest rank and going left on ties finds its leftmost place. A merge changes
three leaves, each a walk to the root. It ends when the root holds no rank.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from caseflow.llm.common import only, slices

NONE = np.int32(2**31 - 1)
SHORT = 32  # bytes: pieces up to here are encoded many at a time

# FIXED: how this kind of tokenizer cuts a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges and added tokens, read from a tokenizer file's JSON text."""

    def __init__(self, text: str):
        data = json.loads(text)
        ids = data["model"]["vocab"]
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([ids[c] for c in letters], dtype=np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*ids.values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added
        longest_first = sorted(added, key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        keys = np.array([(a << 32) | b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        values = np.array(list(self.pairs.values()), dtype=np.int32).reshape(-1, 2)[order]
        self.ranks = np.append(values[:, 0], NONE)
        self.merged = np.append(values[:, 1], -1)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; no rank where either side is missing (-1)."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys[:-1], key)
        at[(self.keys[at] != key) | (left < 0) | (right < 0)] = len(self.keys) - 1
        return self.ranks[at], self.merged[at]


def encode_long(piece: bytes, v: Vocabulary) -> list[int]:
    """One piece by one tree; O(n log n) for n bytes."""
    n = len(piece)
    tokens = [int(v.byte_ids[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1 << max(0, (n - 1).bit_length())
    none = int(NONE)
    tree = [none] * (2 * width)
    pair = v.pairs.get
    for i in range(n - 1):
        if found := pair((tokens[i], tokens[i + 1])):
            tree[width + i] = found[0]
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, rank: int) -> None:
        i += width
        tree[i] = rank
        while i > 1:
            i >>= 1
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low

    while tree[1] != none:
        at = 1
        while at < width:
            at = 2 * at if tree[2 * at] == tree[1] else 2 * at + 1
        i = at - width
        j = after[i]
        tokens[i] = pair((tokens[i], tokens[j]))[1]
        after[i] = after[j]
        put(j, none) if j < width else None
        if after[i] < n:
            before[after[i]] = i
            found = pair((tokens[i], tokens[after[i]]))
            put(i, found[0] if found else none)
        else:
            put(i, none)
        if before[i] >= 0:
            found = pair((tokens[before[i]], tokens[i]))
            put(before[i], found[0] if found else none)
    out, i = [], 0
    while i < n:
        out.append(tokens[i])
        i = after[i]
    return out


def encode_forest(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """Pieces of up to ``SHORT`` bytes, a tree for each, all advanced one merge at a time.

    Ids come as little-endian unsigned 32-bit integers.
    """
    count = len(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=count)
    longest = int(lengths.max())
    width = 1 << max(0, (longest - 1).bit_length())
    flat = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in pieces), dtype=np.uint8).reshape(count, longest)
    tokens = np.full((count, longest + 1), -1, dtype=np.int64)
    tokens[:, :longest] = v.byte_ids[flat]
    tokens[np.arange(longest + 1)[None, :] >= lengths[:, None]] = -1
    after = np.tile(np.arange(1, longest + 2), (count, 1))
    before = np.tile(np.arange(-1, longest), (count, 1))
    tree = np.full((count, 2 * width), NONE, dtype=np.int32)
    if longest > 1:
        ranks, _ = v.look_up(tokens[:, : longest - 1].ravel(), tokens[:, 1:longest].ravel())
        tree[:, width : width + longest - 1] = ranks.reshape(count, longest - 1)
    level = width
    while level > 1:
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
        level //= 2

    def put(rows: np.ndarray, leaf: np.ndarray, ranks: np.ndarray) -> None:
        at = leaf + width
        tree[rows, at] = ranks
        for _ in range(width.bit_length() - 1):
            tree[rows, at >> 1] = np.minimum(tree[rows, at], tree[rows, at ^ 1])
            at = at >> 1

    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        root = tree[live, 1]
        at = np.ones(len(live), dtype=np.int64)
        for _ in range(width.bit_length() - 1):
            at = 2 * at + (tree[live, 2 * at] != root)
        i = at - width
        j = after[live, i]
        _, merged = v.look_up(tokens[live, i], tokens[live, j])
        k = after[live, j]
        tokens[live, i], tokens[live, j] = merged, -1
        after[live, i] = k
        before[live, np.minimum(k, longest)] = i
        put(live, np.minimum(j, width - 1), np.where(j < width, NONE, tree[live, 2 * width - 1]))
        put(live, i, v.look_up(tokens[live, i], tokens[live, np.minimum(k, longest)])[0])
        p = before[live, i]
        some = p >= 0
        if some.any():
            rows, p = live[some], p[some]
            put(rows, p, v.look_up(tokens[rows, p], tokens[rows, i[some]])[0])
        live = live[tree[live, 1] != NONE]
    kept = tokens >= 0
    ids = tokens[kept].astype("<u4").tobytes()
    ends = np.cumsum(kept.sum(axis=1)) * 4
    return [ids[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]


class Encoder:
    """Text to ids and back; remembers up to ``most`` pieces."""

    def __init__(self, vocabulary: Vocabulary, most: int = 200_000):
        self.v, self.most, self.known = vocabulary, most, {}
        self.pieces = regex.compile(PIECES)

    def cut(self, text: str) -> list[str | int]:
        """Pieces in order; an added token inside the text is its id."""
        if self.v.added_pattern is None or not self.v.added_pattern.search(text):
            return self.pieces.findall(text)
        out: list[str | int] = []
        for part in self.v.added_pattern.split(text):
            out.extend([self.v.added[part]] if part in self.v.added else self.pieces.findall(part))
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        new = {p for p in set().union(*cut) if p not in self.known}
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set().union(*cut)
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            if isinstance(piece, int):
                self.known[piece] = piece.to_bytes(4, "little")
                continue
            raw = piece.encode("utf-8")
            if len(raw) > SHORT:
                self.known[piece] = np.array(encode_long(raw, self.v), dtype="<u4").tobytes()
            else:
                by_width.setdefault(max(0, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for group in by_width.values():
            for start in range(0, len(group), 20_000):
                part = group[start : start + 20_000]
                self.known.update(zip([p for p, _ in part], encode_forest([r for _, r in part], self.v), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        get = self.v.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary_path: str, keep_ids: bool = False) -> DataFrame:
    """Encode ``text`` of every row, decode it again, and return both as digests.

    ``docs`` needs ``doc_id`` and ``text``; the result has doc_id, n_tokens,
    ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array<int>). A null text
    counts as empty; empty texts have no ids. Repeated rows stay repeated, further
    columns are ignored, an empty table gives an empty one. The vocabulary file is
    read on the driver (its size does not depend on the data) and sent to the tasks.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        text = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(text.value))
        for part in slices(batches, "text"):
            ids = encoder.encode_many([t or "" for t in part.column(1).to_pylist()])
            columns = [
                part.column(0),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(encoder.decode(i).encode("utf-8")).hexdigest() for i in ids]),
            ]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(i, dtype="<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    names = [part.split()[0] for part in schema.split(", ")]
    return only(docs, "doc_id", "text").mapInArrow(run, schema)
