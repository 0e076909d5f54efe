"""Toxic spans by a linear-chain conditional random field over words.

Two tags, clean and toxic.  The potentials of a word are sums of hashed features (the word and its beginnings of
4, 5 and 6 bytes, so that inflected forms of a stem share weight); two tags in a row have potentials of their own.
Training sees labelled words: in documents marked toxic, the words whose features stand out against the clean
documents; every other word is clean.  Documents that are near copies count once when that is judged.

Scoring computes forward-backward marginals of every word of a whole text.  The largest marginal gives the document's
score, through a logistic curve fitted with the field; words whose marginal reaches one half are the offending spans.
The recursions are Moebius maps of one ratio, which are composed block-wise: exact for any length, without a Python
step for each word.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import features
from graphloom.llm.features import crc32_of_id

BITS = 19
PREFIXES = (4, 5, 6)
#: Bounds of the training sample for each label, parameters of :func:`toxicity`: whole documents, and bytes of them together.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 8 << 20
#: A feature marks toxic words if it is in at least so many toxic documents, so many times more often than in clean
#: ones, and its log-likelihood ratio is at least so large.
SUPPORT, RATIO, EVIDENCE = 3, 15.0, 16.0
STEPS = 30
LIMIT = 30.0
PART_WORDS = 1 << 17


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, block: int = 512) -> np.ndarray:
    """All ``x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t])`` with ``x[-1] = 1``; numbers are positive or 0."""
    n = len(a)
    k = -(-n // block) or 1
    pad = k * block - n
    grid = [np.concatenate([v, np.full(pad, f)]).reshape(k, block).T.copy() for v, f in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0))]
    top, low = np.tile([1.0, 0.0], (k, 1)), np.tile([0.0, 1.0], (k, 1))
    for a1, b1, c1, d1 in zip(*grid, strict=True):  # the map of each block
        top, low = a1[:, None] * top + b1[:, None] * low, c1[:, None] * top + d1[:, None] * low
        size = (top + low).sum(axis=1, keepdims=True)
        top /= size
        low /= size
    first = np.empty(k)
    x = 1.0
    for i, ((p, q), (r, s)) in enumerate(zip(top.tolist(), low.tolist(), strict=True)):
        first[i] = x
        x = (p * x + q) / max(r * x + s, 1e-300)
    out = np.empty((block, k))
    x = first
    for t, (a1, b1, c1, d1) in enumerate(zip(*grid, strict=True)):
        x = np.minimum((a1 * x + b1) / np.maximum(c1 * x + d1, 1e-300), 1e200)
        out[t] = x
    return out.T.reshape(-1)[:n]


def _parts(first: np.ndarray) -> list[int]:
    """Where words are cut into parts of about ``PART_WORDS``, at the borders of rows, whose first words are marked."""
    n = len(first)
    if n <= 2 * PART_WORDS:
        return [0, n]
    rows = np.flatnonzero(first)
    return np.unique(np.append(rows[np.searchsorted(rows, np.arange(PART_WORDS, n - PART_WORDS, PART_WORDS), side="right") - 1], [0, n])).tolist()


@dataclass
class Field:
    """Weights of the hashed features, potentials of tag pairs ``move[from, to]`` and of the first tag, the curve."""

    weight: np.ndarray
    move: np.ndarray
    start: float
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The marginal of toxic for each word, and the ratios before and after; ``first`` marks rows' first words."""
        n = len(score)
        if not n:
            return score, score, score
        if len(cuts := _parts(first)) > 2:
            parts = [self.marginals(score[a:b], first[a:b]) for a, b in itertools.pairwise(cuts)]
            return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
        w = np.exp(np.clip(score, -LIMIT, LIMIT))
        (oo, ot), (to, tt) = np.exp(self.move)
        zero, one = np.zeros(n), np.ones(n)
        ahead = scan(np.where(first, zero, w * tt), np.where(first, w * np.exp(self.start), w * ot), np.where(first, zero, to * one), np.where(first, one, oo * one))
        last = np.append(first[1:], True)
        after = np.append(w[1:], 1.0)  # backward: from a word's successor to the word
        back = scan(*(np.where(last, e, v)[::-1] for v, e in ((tt * after, zero), (to * one, one), (ot * after, zero), (oo * one, one))))[::-1]
        odds = ahead * back
        return odds / (1 + odds), ahead, back


def indices(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, row, features)`` of the words of a slice; a word has one feature for each column."""
    starts, ends, row = features.words(raw, offsets)
    total = features.sums(raw)
    cols = []
    for salt, size in enumerate((0, *PREFIXES)):
        stop = ends if not size else np.minimum(starts + size, ends)
        h = features.stretch(total, starts, stop) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        cols.append((features.mix(h) >> np.uint64(64 - BITS)).astype(np.int32))
    return starts, ends, row, np.stack(cols, 1) if cols else np.empty((0, 0), np.int32)


def _distinct_documents(rows: list[np.ndarray]) -> np.ndarray:
    """False for documents that share two of four minima of hashed words with an earlier one: near copies."""
    seen: set[tuple] = set()
    out = np.ones(len(rows), bool)
    for i, words in enumerate(rows):
        if not len(words):
            continue
        with np.errstate(over="ignore"):
            least = [int(features.mix(words.astype(np.uint64) * np.uint64(2 * s + 1) + np.uint64(s)).min()) for s in range(1, 5)]
        pairs = {(s, t, least[s], least[t]) for s in range(4) for t in range(s)}
        out[i] = not pairs & seen
        seen |= pairs
    return out


def fit(texts: list[str], toxic: list[int], steps: int = STEPS) -> Field:
    """Train on labelled documents.  Without documents of both kinds the field finds nothing toxic."""
    field = Field(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), -3.0)
    label = np.asarray(toxic, int)
    parts = []
    for row0, raw, offsets in features.slices(pa.array([t or "" for t in texts], pa.string()), lower=True):
        _, _, row, index = indices(raw, offsets)
        parts.append(((row + row0).astype(np.int32), index))
    if not parts or not 0 < label.sum() < len(label):
        field.move[:] = 0
        field.shift, field.start = -5.0, -LIMIT
        field.weight[:] = -LIMIT / 4
        return field
    row, index = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    alone = _distinct_documents([index[a:b, 0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    # In how many toxic and clean documents is each feature?
    in_toxic, in_clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for some, found in parts:
        pairs = np.unique((some[:, None].astype(np.int64) << BITS | found)[alone[some]].reshape(-1))
        what, where = pairs & (1 << BITS) - 1, pairs >> BITS
        in_toxic += np.bincount(what, label[where], 1 << BITS)
        in_clean += np.bincount(what, 1 - label[where], 1 << BITS)
    del parts
    n1, n0 = max(1, int(label[alone].sum())), max(1, int((1 - label[alone]).sum()))
    with np.errstate(divide="ignore", invalid="ignore"):
        share = (in_toxic + in_clean) / (n1 + n0)
        g = 2 * (np.where(in_toxic > 0, in_toxic * np.log(in_toxic / (n1 * share)), 0) + np.where(in_clean > 0, in_clean * np.log(in_clean / (n0 * share)), 0))
    stands_out = (in_toxic >= SUPPORT) & (in_toxic / n1 >= RATIO * (in_clean + 0.5) / n0) & (g >= EVIDENCE)
    y = (stands_out[index].any(axis=1) & (label[row] == 1)).astype(float)
    # Words of toxic documents decide the rest; of the clean documents all words count.
    first = np.append(True, row[1:] != row[:-1])
    squares = np.full(1 << BITS, 1e-6)
    moved = np.full(5, 1e-6)
    field.weight[:] = -1.0
    cuts = _parts(first)
    for _ in range(steps):
        g, g5 = 0.02 * field.weight.astype(float), np.zeros(5)
        for a, b in itertools.pairwise(cuts):  # whole rows, for the sake of memory
            some, real, begin = index[a:b], y[a:b], first[a:b]
            score = field.weight[some].sum(axis=1)
            p, ahead, back = field.marginals(score, begin)
            for k in range(some.shape[1]):
                g += np.bincount(some[:, k], p - real, 1 << BITS)
            w = np.exp(np.clip(score, -LIMIT, LIMIT))[1:]
            (oo, ot), (to, tt) = np.exp(field.move)
            cells = np.stack([oo * np.ones(len(w)), ot * w * back[1:], to * ahead[:-1], tt * ahead[:-1] * w * back[1:]])
            cells /= cells.sum(axis=0)
            was, now, same = real[:-1], real[1:], ~begin[1:]
            observed = ((1 - was) * (1 - now), (1 - was) * now, was * (1 - now), was * now)
            g5 += [((c - o) * same).sum() for c, o in zip(cells, observed, strict=True)] + [((p - real) * begin).sum()]
        squares += g * g
        field.weight -= (1.0 * g / np.sqrt(squares)).astype(np.float32)
        moved += g5 * g5
        change = 0.3 * g5 / np.sqrt(moved)
        field.move -= change[:4].reshape(2, 2)
        field.start -= change[4]
        field.move -= field.move[0, 0]
    p = np.concatenate([field.marginals(field.weight[index[a:b]].sum(axis=1), first[a:b])[0] for a, b in itertools.pairwise(cuts)])
    top = _largest(p, row, len(texts))
    x, a, b = _logit(top), 1.0, 0.0
    marked = np.bincount(row, y, len(texts)) > 0
    clear = marked | (label == 0)  # what was marked toxic without any word that stands out says nothing here
    x, aim = x[clear], np.where(label == 1, 0.98, 0.02)[clear]
    for _ in range(300):
        q = 1 / (1 + np.exp(-(a * x + b)))
        a, b = max(0.05, a - 0.02 * ((q - aim) * x).mean()), b - 0.2 * (q - aim).mean()
    field.slope, field.shift = float(a), float(b)
    return field


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _largest(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows)
    np.maximum.at(out, row, p)
    return out


SCORED = "score double, spans array<struct<start:int,length:int,marginal:double>>"


def _scored(batches: Iterator[pa.RecordBatch], field: Field, keys: int, spans: bool) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("marginal", pa.float64())]))
    for batch in batches:
        texts = batch.column(keys)
        score, found = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
        for row0, raw, offsets in features.slices(texts, lower=True):
            starts, ends, row, index = indices(raw, offsets)
            first = np.append(True, row[1:] != row[:-1]) if len(row) else np.empty(0, bool)
            p, *_ = field.marginals(field.weight[index].sum(axis=1), first)
            rows = len(offsets) - 1
            score[row0 : row0 + rows] = _largest(p, row, rows)
            if spans and len(hits := np.flatnonzero(p >= 0.5)):
                begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that begin before each byte
                at, stop, origin = begun[starts[hits]], begun[ends[hits]], begun[offsets[row[hits]]]
                for r, start, n, m in zip(row[hits].tolist(), (at - origin).tolist(), (stop - at).tolist(), p[hits].tolist(), strict=True):
                    found[row0 + r].append((start, n, m))
        score = 1 / (1 + np.exp(-(field.slope * _logit(score) + field.shift)))
        names = [batch.schema.names[i] for i in range(keys)]
        merged = pa.array([[{"start": s, "length": n, "marginal": m} for s, n, m in f] for f in found], kind)
        yield pa.RecordBatch.from_arrays([*batch.columns[:keys], pa.array(score), merged], names=[*names, "score", "spans"])


def score(docs: DataFrame, field: Field, spans: bool = True) -> DataFrame:
    """``(doc_id, score, spans)`` of every row's whole text; a span has its offset and length in characters of the lower-cased text
    and its marginal.  Null and empty texts have the score of a text without toxic words.  Repeated rows and null ids
    are kept; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_scored, field=field, keys=1, spans=spans), f"doc_id long, {SCORED}")


def marks(labels: DataFrame, column: str, training) -> DataFrame:
    """``(doc_id, label)`` of the labelled documents for which ``training``, a condition on ``doc_id``, holds; of several
    labels of a document the largest."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(training)
    return rows.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` for every row of ``docs``.

    Only labelled rows whose ``crc32(doc_id) mod folds`` isn't ``held`` are learned from, a bounded sample of whole documents
    of each label (:func:`features.sample`).  A null ``doc_id`` counts as not held out.
    """
    fold = crc32_of_id() % folds
    rows = features.sample(docs, marks(labels, "toxic", fold != held), sample_docs, sample_bytes)
    field = fit([r[2] for r in rows], [r[1] for r in rows])
    return score(docs, field).select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")
