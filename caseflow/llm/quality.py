"""Text quality by a factorisation machine.

The input of a text is one sparse row: hashed words, structure statistics, and its
length and layout as metadata. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

which weighs every pair of inputs by the inner product of their factors in time linear
in the inputs. It is fitted on the driver on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import crc_remainder, hash_words, only, received, remainder, share, slices

WORDS = 1024  # hashed words
FACTORS = 6
SAMPLE = 6000  # labelled rows expected in the sample
THRESHOLD = 0.7

_KIND = np.zeros((256, 7), dtype=np.float64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [
        _b >= 128 or _c.isalpha(), _b < 128 and _c.isupper(), _b < 128 and _c.isdigit(), _c in ".,;:?'\"-()",
        _b < 128 and not _c.isalnum() and not _c.isspace() and _c not in ".,;:?'\"-()", _b < 128 and _c.isspace(), _c in "|<>{}[]\\=_",
    ]
STRUCTURE = 24


def inputs(texts: list[str | None]) -> np.ndarray:
    """One dense row per text: hashed words, then structure and metadata in 0 to 1."""
    hashes, starts = hash_words(texts)
    out = np.zeros((len(texts), WORDS + STRUCTURE), dtype=np.float32)
    for i, text in enumerate(texts):
        text = text or ""
        own = hashes[starts[i] : starts[i + 1]]
        n = len(own)
        if n:
            words = np.sqrt(np.bincount((own % np.uint64(WORDS)).astype(np.int64), minlength=WORDS))
            out[i, :WORDS] = words / np.sqrt(words @ words)
        data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        size = max(1, len(data))
        part = np.bincount(data, minlength=256) @ _KIND / size
        lines = [x for x in text.split("\n") if x.strip()]
        distinct = len(np.unique(own)) / n if n else 0.0
        unique_lines = len(set(lines)) / len(lines) if lines else 0.0
        repeats = float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0
        longest = max(map(len, lines)) / max(1, len(text)) if lines else 0.0
        out[i, WORDS:] = [
            *part, n == 0, min(1.0, n / 50), min(1.0, np.log1p(n) / 12), distinct, unique_lines, repeats, longest,
            min(1.0, len(lines) / 100), min(1.0, size / max(1, n) / 20), part[1] / max(part[0], 1e-3), min(1.0, 10 * part[4]), min(1.0, 50 * part[4]),
            min(1.0, 20 * part[6]), distinct < 0.4, unique_lines < 0.7, part[1] > 0.3 * max(part[0], 1e-3), n < 5,
        ]
    return out


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, size: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = draw.normal(0, 0.05, (size, FACTORS))

    def logits(self, x: np.ndarray) -> np.ndarray:
        pairs = ((x @ self.v) ** 2 - (x * x) @ (self.v**2)).sum(axis=1) / 2
        return self.w0 + x @ self.w + pairs

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.05, decay: float = 1e-5) -> Machine:
        """Adaptive gradient steps on the log loss, the same for the same rows in the same order."""
        draw = np.random.default_rng(7)
        sum0, sum_w, sum_v = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for start in range(0, len(x), batch):
                rows = x[order[start : start + batch]].astype(np.float64)
                error = (self.scores(rows) - y[order[start : start + batch]]) / len(rows)
                inner = rows @ self.v
                g0, gw = error.sum(), rows.T @ error + decay * self.w
                gv = rows.T @ (error[:, None] * inner) - self.v * ((rows * rows).T @ error)[:, None] + decay * self.v
                sum0, sum_w, sum_v = sum0 + g0 * g0, sum_w + gw * gw, sum_v + gv * gv
                self.w0 -= rate * g0 / np.sqrt(sum0)
                self.w -= rate * gw / np.sqrt(sum_w)
                self.v -= rate * gv / np.sqrt(sum_v)
        return self


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every text; learn from labels of documents that are not held out.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``quality``; held
    out are rows whose crc32 of doc_id as text leaves 2 modulo 4. The result has one row
    per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.7 on).
    Null texts count as empty and are scored too. Labels that are null teach nothing;
    several for one document count as their mean, rounded half up; a label of no document is ignored; of rows that
    share a doc_id one teaches. With
    no usable label at all every score is 0.5.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = only(docs, "doc_id", "text")
    known = only(labels, "doc_id", "quality").where((remainder(F.col("doc_id"), 4) != 2) & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.round(F.avg("quality")).alias("quality"))
    total = known.count()
    below = int(min(1.0, SAMPLE / max(1, total)) * (1 << 30))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < below).limit(2 * SAMPLE)
    # of rows that share a doc_id one teaches: at most as many rows as labels, whatever the size of the tables
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    taught = docs.join(F.broadcast(drawn), "doc_id").withColumn("nth", nth).where("nth = 1")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array([r.astype(np.float16).tobytes() for r in inputs(part.column(0).to_pylist())], pa.binary())], names=["quality", "row"]
            )

    sample = taught.select("text", "quality").mapInArrow(rows_of, "quality double, row binary").toPandas()
    sample = sample.sort_values(["quality", "row"])
    x = np.frombuffer(b"".join(sample["row"]), dtype=np.float16).astype(np.float32).reshape(len(sample), WORDS + STRUCTURE)
    machine = Machine(WORDS + STRUCTURE)
    if len(sample):
        machine.fit(x, (sample["quality"].to_numpy() >= 0.5).astype(np.float64))
    else:
        machine.v[:] = 0
    sent = share(docs.sparkSession, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = received(sent)
        for part in slices(batches, "text"):
            scores = machine.scores(inputs(part.column(1).to_pylist()).astype(np.float64))
            held = [crc_remainder(i, 4) == 2 for i in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
