"""Quality grades by ordinal regression on hashed text.

A cumulative-link model with the logistic link: one weight for each hashed feature, shared by all grades, and a
threshold between each two neighbouring grades, in order.  Features are relative frequencies, so length alone doesn't
count: trigrams of characters by class (letters, capitals, digits, white space, each other byte), words, and words that
repeat their predecessor.  The model gives the expected grade and the probability of reaching a grade, by which
documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import features
from graphloom.llm.features import crc32_of_id
from graphloom.llm.toxicity import marks

BITS = 16
#: Bounds of the training sample for each grade, parameters of :func:`quality`: whole documents, and bytes of them together.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 8 << 20
STEPS = 60
SHAPES, WORDS, REPEATS = 0, 1 << BITS, 2 << BITS
TOTAL = (2 << BITS) + 1

#: Characters by class.
CLASS = np.arange(256, dtype=np.uint32)
CLASS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = ord("a")
CLASS[[*range(ord("A"), ord("Z") + 1)]] = ord("A")
CLASS[[*range(ord("0"), ord("9") + 1)]] = ord("0")
CLASS[[9, 11, 12, 13, 32]] = 32


def located(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, feature, weight)`` of everything in a slice; the weights of a kind add up to 1 in each row."""
    rows = len(offsets) - 1
    own = np.repeat(np.arange(rows), np.diff(offsets))
    out_row, out_what, out_weight = [], [], []

    def add(row: np.ndarray, what: np.ndarray) -> None:
        n = np.bincount(row, minlength=rows)
        out_row.append(row)
        out_what.append(what.astype(np.int64))
        out_weight.append(1.0 / np.maximum(n, 1)[row])

    if len(raw) > 2:
        x = CLASS[raw]
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        inside = own[:-2] == own[2:]
        add(own[:-2][inside], SHAPES + ((code[inside] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64))
    starts, ends, row = features.words(raw, offsets)
    if len(starts):
        h = features.stretch(features.sums(raw), starts, ends)
        add(row, WORDS + (h >> np.uint64(64 - BITS)).astype(np.int64))
        again = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1]))
        n = np.bincount(row, minlength=rows)
        out_row.append(row[again])
        out_what.append(np.full(int(again.sum()), REPEATS))
        out_weight.append(1.0 / np.maximum(n, 1)[row[again]])
    if not out_row:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(out_row), np.concatenate(out_what), np.concatenate(out_weight)


def _vectors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row * TOTAL + feature, amount)``: one entry for each feature of a row, the root of its relative frequency."""
    row, what, weight = located(raw, offsets)
    key, inverse = np.unique(row * TOTAL + what, return_inverse=True)
    return key, np.sqrt(np.bincount(inverse, weight, len(key)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    grades: list[int]
    weight: np.ndarray
    cuts: np.ndarray  # ascending, one fewer than grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """The probability of a grade above each cut: a column for each."""
        return _sigmoid(score[:, None] - self.cuts[None, :])


def fit(texts: list[str], graded: list[int], steps: int = STEPS, decay: float = 1e-3) -> Model:
    """Maximum likelihood with AdaGrad steps; thresholds stay in order as sums of positive gaps.  Grades count equally,
    however many documents each has.  With fewer than two grades every document gets the one there is."""
    grades = sorted(set(graded))
    k = len(grades) - 1
    if k < 1:
        return Model(grades or [0], np.zeros(TOTAL), np.empty(0))
    y = np.searchsorted(grades, graded)
    parts = [(k + row0 * TOTAL, a) for row0, raw, offsets in features.slices(pa.array([t or "" for t in texts], pa.string())) for k, a in [_vectors(raw, offsets)]]
    key, amount = (np.concatenate([p[i] for p in parts]) for i in range(2))
    row, what = (key // TOTAL).astype(np.int32), (key % TOTAL).astype(np.int32)
    share = 1.0 / np.bincount(y, minlength=k + 1)
    importance = share[y] / (k + 1)
    weight, base, gaps = np.zeros(TOTAL), 0.0, np.zeros(max(0, k - 1))
    square_w, square_t = np.full(TOTAL, 1e-8), np.full(k, 1e-8)
    for _ in range(steps):
        cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(row, weight[what] * amount, len(texts))
        tail = _sigmoid(score[:, None] - cuts[None, :])
        edge = np.concatenate([np.ones((len(y), 1)), tail, np.zeros((len(y), 1))], 1)  # P(grade >= g)
        at = np.arange(len(y))
        p = np.maximum(edge[at, y] - edge[at, y + 1], 1e-12)
        slope = edge * (1 - edge)
        d_score = -(slope[at, y] - slope[at, y + 1]) / p * importance
        d_cut = np.zeros((len(y), k + 2))
        d_cut[at, y] += slope[at, y] / p * importance
        d_cut[at, y + 1] -= slope[at, y + 1] / p * importance
        g_cut = d_cut[:, 1:-1].sum(axis=0)
        g = np.bincount(what, d_score[row] * amount, TOTAL) + decay * weight
        square_w += g * g
        weight -= 0.5 * g / np.sqrt(square_w)
        below = np.cumsum(g_cut[::-1])[::-1]
        g_t = np.concatenate([[below[0]], below[1:] * np.exp(gaps)])
        square_t += g_t * g_t
        step = 0.3 * g_t / np.sqrt(square_t)
        base -= step[0]
        gaps = gaps - step[1:]
    return Model(grades, weight, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    for row0, raw, offsets in features.slices(texts):
        key, amount = _vectors(raw, offsets)
        rows = len(offsets) - 1
        out[row0 : row0 + rows] = np.bincount(key // TOTAL, model.weight[key % TOTAL] * amount, rows)
    return out


GRADED = "expected_grade double, tail_probability double, selected boolean"


def _graded(batches: Iterator[pa.RecordBatch], model: Model, at_least: int, threshold: float) -> Iterator[pa.RecordBatch]:
    grades = np.array(model.grades, float)
    for batch in batches:
        tails = model.tails(_scores(batch.column(1), model))
        expected = grades[0] + tails @ np.diff(grades)
        above = [g for g in model.grades if g >= at_least]
        cut = model.grades.index(above[0]) if above else None
        tail = np.zeros(batch.num_rows) if cut is None else np.ones(batch.num_rows) if cut == 0 else tails[:, cut - 1]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= threshold)], names=["doc_id", "expected_grade", "tail_probability", "selected"])


def grade(docs: DataFrame, model: Model, at_least: int, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, expected_grade, tail_probability, selected)``: the expected grade, the probability of a grade of at least
    ``at_least``, and whether that reaches ``threshold``, for every row's whole text.  Null and empty texts have no
    features and so the score 0.  Repeated rows and null ids are kept; an empty table gives no rows; other columns
    are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_graded, model=model, at_least=at_least, threshold=threshold), f"doc_id long, {GRADED}")


def quality(
    docs: DataFrame, labels: DataFrame, column: str = "quality", at_least: int = 1, threshold: float = 0.5, folds: int = 5, held: int = 0, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """Fit on a bounded sample of whole labelled documents of each grade (:func:`features.sample`) whose ``crc32(doc_id) mod
    folds`` isn't ``held``, and grade every row: ``(doc_id, held_out, expected_grade, tail_probability, selected)``.  A null
    ``doc_id`` isn't held out."""
    fold = crc32_of_id() % folds
    rows = features.sample(docs, marks(labels, column, fold != held), sample_docs, sample_bytes)
    model = fit([r[2] for r in rows], [r[1] for r in rows])
    return grade(docs, model, at_least, threshold).select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "expected_grade", "tail_probability", "selected")
