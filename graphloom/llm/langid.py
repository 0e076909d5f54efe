"""Language identification by nearest centroids.

A text is a vector of byte n-grams of its lower-cased words (hashed, weighted by term frequency and inverse document
frequency, of length 1).  Each language has several centroids, found by spherical k-means on labelled texts, so that
registers of one language needn't share a centre.  The nearest centroid by cosine gives the language; a text farther from
it than nearly all training texts of that language were is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import features

BITS = 14
SIZES = (1, 2, 3)
CENTROIDS = 4
#: Bounds of the training sample for each language, parameters of :func:`identify`: whole texts, and bytes of them together.
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 16 << 20
#: A text is rejected if it is farther from its centroid than this share of the training texts, times a margin.
QUANTILE, MARGIN = 0.999, 1.25
UNKNOWN = "und"


def _clean(raw: np.ndarray) -> np.ndarray:
    """Bytes with everything but letters replaced by a space."""
    return np.where(features.LETTER[raw], raw, 32).astype(np.uint8)


def grams(raw: np.ndarray) -> np.ndarray:
    """Hashed n-grams of a text's bytes, white space included as word borders."""
    x = _clean(raw)
    x = np.concatenate([[32], x, [32]]).astype(np.uint32)
    x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]  # runs of borders are one
    out = []
    for n in SIZES:
        if len(x) < n:
            break
        code = np.zeros(len(x) - n + 1, np.uint32)
        for i in range(n):
            code = code * np.uint32(257) + x[i : len(x) - n + 1 + i] + np.uint32(1)
        out.append((code * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def counts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(features, how often)`` of one text."""
    all_ = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(raw), 1 << 20):  # a long text in pieces; the grams that cross two pieces belong to the first
        all_ += np.bincount(grams(raw[at : at + (1 << 20) + SIZES[-1] - 1]), minlength=1 << BITS)
    what = np.flatnonzero(all_)
    return what, all_[what]


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # the language of each centroid
    centres: np.ndarray  # centroids, each of length 1
    idf: np.ndarray
    reach: np.ndarray  # the largest cosine distance accepted, for each centroid

    def nearest(self, raw: np.ndarray) -> tuple[int, float]:
        """The nearest centroid and the cosine with it; (-1, 0) for a text without features."""
        what, n = counts(raw)
        if not len(what) or not len(self.centres):
            return -1, 0.0
        v = (1 + np.log(n)) * self.idf[what]
        size = np.sqrt((v * v).sum())
        if not size:
            return -1, 0.0
        cosines = self.centres[:, what] @ v / size
        i = int(cosines.argmax())
        return i, float(min(max(cosines[i], 0.0), 1.0))


def _vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for row0, raw, offsets in features.slices(pa.array([t or "" for t in texts], pa.string()), lower=True):
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            what, n = counts(raw[a:b])
            out[row0 + i, what] = (1 + np.log(n)) * idf[what]
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def _spherical(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centres are chosen far from each other."""
    k = min(k, len(points))
    centres = points[:1]
    while len(centres) < k:
        centres = np.concatenate([centres, points[[int((points @ centres.T).max(axis=1).argmin())]]])
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.stack([points[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(k)])
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    return centres


def fit(rows: list[tuple[str, str]], idf: np.ndarray, centroids: int = CENTROIDS) -> Model:
    """Centroids of ``(language, text)`` rows."""
    languages = sorted({r[0] for r in rows})
    owner, centres, reach = [], [], []
    for i, name in enumerate(languages):
        points = _vectors([r[1] for r in rows if r[0] == name], idf)
        points = points[(points != 0).any(axis=1)]
        if not len(points):
            continue
        own = _spherical(points, centroids)
        far = 1 - (points @ own.T).max(axis=1)
        limit = min(1.0, float(np.quantile(far, QUANTILE)) * MARGIN)
        owner += [i] * len(own)
        centres.append(own)
        reach += [limit] * len(own)
    return Model(languages, np.array(owner, int), np.concatenate(centres) if centres else np.zeros((0, 1 << BITS), np.float32), idf, np.array(reach))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, found = 0, np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for _, raw, offsets in features.slices(batch.column(0), lower=True):
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                found[counts(raw[a:b])[0]] += 1
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([-1, *range(1 << BITS)], pa.int32()), pa.array([n, *found.tolist()], pa.int64())], names=["feature", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all rows of ``texts (text)``: counts are summed in each task, then by feature, and only
    ``2 ** BITS`` sums reach the driver."""
    got = texts.mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = np.zeros((1 << BITS) + 1)
    for r in got:
        found[r["feature"]] = r["n"]
    return np.log((1 + found[-1]) / (1 + found[:-1])) + 1


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


PREDICTED = "lang_pred string, score double, distance double, rejected boolean"


def _decide(texts: pa.Array, model: Model) -> list[tuple[str, float, float, bool]]:
    """Language, cosine, distance and rejection of each text."""
    lettered = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False)
    out: list[tuple[str, float, float, bool]] = []
    for row0, raw, offsets in features.slices(texts, lower=True):
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True), row0):
            if not lettered[i].as_py() and not has_letter(texts[i].as_py() or ""):
                out.append((UNKNOWN, 0.0, 1.0, True))
                continue
            c, cosine = model.nearest(raw[a:b])
            out.append((UNKNOWN, 0.0, 1.0, True) if c < 0 else (model.languages[model.owner[c]], cosine, 1 - cosine, bool(1 - cosine > model.reach[c])))
    return out


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = list(zip(*_decide(batch.column(1), model), strict=True)) or [()] * 4
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "lang_pred", "score", "distance", "rejected"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, distance, rejected)`` of every row's whole text.

    ``und``, score 0 and rejected for a null text or one without a letter.  Repeated rows and null ids are kept, an
    empty table gives no rows, other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_predicted, model=model), f"doc_id long, {PREDICTED}")


def train(docs: DataFrame, training: Column, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on rows of ``docs (doc_id, text, lang)`` where ``training`` holds and ``lang`` isn't null: document frequencies
    from all of them, centroids from a sample of whole texts of each language (:func:`features.sample`)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label")).where(training).where("label IS NOT NULL AND text IS NOT NULL")
    idf = inverse_frequencies(rows.select("text"))
    return fit(sorted((r[1], r[2]) for r in features.sample(rows, rows.select("doc_id", "label").where("doc_id IS NOT NULL"), sample_docs, sample_bytes)), idf)


def identify(docs: DataFrame, folds: int = 4, held: int = 2, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, distance, rejected)`` for every row; documents whose ``crc32(doc_id) mod folds``
    is ``held`` are never learned from.  A null ``doc_id`` counts as held out."""
    fold = features.crc32_of_id() % folds
    model = train(docs, F.coalesce(fold != held, F.lit(False)), sample_docs, sample_bytes)
    return predict(docs, model).select("doc_id", F.coalesce(fold == held, F.lit(True)).alias("held_out"), "lang_pred", "score", "distance", "rejected")


def keep_known(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """``docs`` without the rows that identification rejects; all columns stay, nothing is shuffled."""
    model = train(docs, F.coalesce(features.crc32_of_id() % folds != held, F.lit(False)))

    @F.arrow_udf("boolean")
    def rejected(texts: pa.Array) -> pa.Array:
        return pa.array([x[3] for x in _decide(texts, model)], pa.bool_())

    return docs.where(~rejected(F.col("text").cast("string")))
