"""Language identification in two levels: the family, then pairwise machines within it.

A text becomes the normalised root counts of its hashed byte 1- to 3-grams. Linear
support vector machines (squared hinge) tell each family from the rest; within the
family with the largest margin one machine for every pair of its languages votes.
Machines are fitted on the driver on a bounded sample of labelled rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import crc_remainder, only, received, remainder, share, slices

DIMENSIONS = 4096
SAMPLE = 2400  # labelled rows in the sample, about, shared equally by the languages; each has at most twice its share
LETTER = regex.compile(r"\p{L}")

# FIXED: languages (ISO 639-1) by family; a learned language in none of them joins "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "turkic": "tr az uz kk ky tk tt",
    "uralic": "fi et hu",
}


def family_of(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, members in FAMILIES.items() if base in members.split()), "other")


def profile(text: str) -> np.ndarray:
    """Normalised root counts of hashed byte n-grams; anything but letters counts as a space."""
    data = np.frombuffer(text.lower().encode("utf-8"), dtype=np.uint8).astype(np.uint32)
    letters = ((data >= 97) & (data <= 122)) | (data >= 128)
    data = np.concatenate([[32], np.where(letters, data, 32), [32]]).astype(np.uint32)
    pairs = data[1:] + np.uint32(257) * data[:-1]
    triples = pairs[1:] * np.uint32(263) + data[:-2] * np.uint32(65537)
    inside = (data[1:-1] != 32) | (data[:-2] != 32)
    mixed = np.concatenate([data[letters.nonzero()[0] + 1] * np.uint32(40503), pairs[1:][inside] * np.uint32(2654435), triples[inside] * np.uint32(2654435761)])
    counts = np.sqrt(np.bincount((mixed ^ (mixed >> np.uint32(15))) % DIMENSIONS, minlength=DIMENSIONS).astype(np.float32))
    return counts / max(float(np.sqrt(counts @ counts)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights, the intercept last, of a squared-hinge machine by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = 1 / (4 + decay)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (decay * ahead - 2 * (x.T @ (share * y * slack)))
        ahead = new + (t / (t + 3)) * (new - w)
        w = new
    return w.astype(np.float32)


class Model:
    """Machines per family and per pair of languages within one family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.members: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.members.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(self.members)
        own = np.array(langs, dtype=object)
        home = np.array([family_of(lang) for lang in langs], dtype=object)
        self.by_family = [fit_svm(x, np.where(home == f, 1, -1).astype(np.float32)) for f in self.families] if len(self.families) > 1 else []
        self.by_pair: dict[str, list[tuple[int, int, np.ndarray]]] = {}
        for family, members in self.members.items():
            self.by_pair[family] = []
            for (i, a), (j, b) in itertools.combinations(enumerate(members), 2):
                rows = (own == a) | (own == b)
                self.by_pair[family].append((i, j, fit_svm(x[rows], np.where(own[rows] == a, 1, -1).astype(np.float32))))

    def predict(self, p: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return "und", 0.0
        best, sure = 0, 1.0
        if self.by_family:
            margins = np.array([w[:-1] @ p + w[-1] for w in self.by_family], dtype=np.float64)
            best = int(np.argmax(margins))
            spread = np.exp(np.clip(4 * (margins - margins[best]), -50, 0))
            sure = 1 / float(spread.sum())
        family = self.families[best]
        members = self.members[family]
        votes = np.zeros(len(members))
        support = np.zeros(len(members))
        for i, j, w in self.by_pair[family]:
            chance = 1 / (1 + np.exp(-np.clip(4 * float(w[:-1] @ p + w[-1]), -50, 50)))
            votes[i if chance >= 0.5 else j] += 1
            support[i] += chance
            support[j] += 1 - chance
        winner = max(range(len(members)), key=lambda k: (votes[k], support[k]))
        within = support[winner] / max(1, len(members) - 1) if len(members) > 1 else 1.0
        return members[winner], float(min(1.0, sure * within))


def identify(docs: DataFrame) -> DataFrame:
    """Predict the language of every text; learn from rows with a lang that are not held out.

    ``docs`` needs ``doc_id``, ``text`` and ``lang``; held out are rows whose crc32 of
    doc_id as text leaves 2 modulo 4. The result has one row per row of ``docs``:
    doc_id, held_out, lang_pred, score. ``und`` with score 0 is given to null texts and
    texts without a letter, and to all if nothing can be learned. Null texts teach
    nothing; a null doc_id counts as the empty text for the split. The prediction sees
    the whole text and nothing else.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = only(docs, "doc_id", "text", "lang")
    labelled = docs.where((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    each = max(20, SAMPLE // max(1, len(counts)))
    chosen = F.lit(False)
    if counts:
        shares = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, each / n) * (1 << 30)))))
        # by id and text: rows without an id are spread too
        chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < shares[F.col("lang")]
    # copies of one row are drawn together; the number of rows is bounded all the same
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text")))
    drawn = labelled.where(chosen).select("text", "lang", nth.alias("nth")).where(F.col("nth") <= 2 * each)

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [(lang, profile(t)) for t, lang in zip(*part.to_pydict().values(), strict=True) if LETTER.search(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, _ in rows], pa.string()), pa.array([p.tobytes() for _, p in rows], pa.binary())], names=["lang", "profile"]
            )

    sample = drawn.select("text", "lang").mapInArrow(profiles, "lang string, profile binary").toPandas()
    sample = sample.sort_values(["lang", "profile"])
    x = np.frombuffer(b"".join(sample["profile"]), dtype=np.float32).reshape(len(sample), DIMENSIONS)
    sent = share(docs.sparkSession, Model(x, list(sample["lang"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(sent)
        for part in slices(batches, "text"):
            found = [
                model.predict(profile(t)) if t and LETTER.search(t) else ("und", 0.0) for t in part.column(1).to_pylist()
            ]
            held = [crc_remainder(i, 4) == 2 for i in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(held, pa.bool_()), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
