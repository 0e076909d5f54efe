"""Hashed features of texts, computed on whole Arrow buffers at once.

Texts are taken in slices of bounded size at row borders (a longer text is a slice of its own) as one array of
bytes with row offsets.  Hashes are polynomial in the bytes, modulo 2 ** 64, so a hash of any stretch is the
difference of two running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def slices(texts: pa.Array, most: int = SLICE_BYTES, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets of the rows)``; null counts as empty.  Only a slice at a time is copied or lower-cased."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(size, size[row] + most, side="right")) - 1)
        part = pc.fill_null(texts.slice(row, end - row).cast(pa.large_string()), "")
        if lower:
            part = pc.utf8_lower(part)
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        yield row, raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        row = end


#: Bytes that belong to words: ASCII letters and all bytes of other characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True


def words(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray = LETTER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, row)`` of all runs of member bytes; a run doesn't cross rows."""
    inside = member[raw]
    change = np.empty(len(raw) + 1, bool)
    change[0], change[-1] = (inside[0], inside[-1]) if len(raw) else (False, False)
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    both = np.unique(cut[inside[cut] & inside[cut - 1]])
    edges = np.flatnonzero(change)
    starts = np.sort(np.concatenate([edges[::2], both]))
    ends = np.sort(np.concatenate([edges[1::2], both]))
    row = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, row


def sums(raw: np.ndarray) -> np.ndarray:
    """Running sums of which :func:`stretch` takes differences."""
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw))[0], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a finaliser of the usual shift-and-multiply kind)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def stretch(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the bytes between ``starts`` and ``ends``, wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((total[ends] - total[starts]) * powers(len(total))[1][starts])


def row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The sum of values for each row."""
    return np.bincount(row, values, rows)


def lowest(rows, column: str, most: int):
    """``(doc_id, column)``: for each value of ``column`` the ``most`` different ids (at most) that hash lowest.  From a large
    table only ids are sorted that can be among the lowest: four times as many as needed are expected, and 200 more."""
    from pyspark.sql import functions as F

    kinds = {r[column]: r["n"] for r in rows.groupBy(column).agg(F.approx_count_distinct("doc_id").alias("n")).collect()}  # as many rows as values
    out = rows.select("doc_id", column).limit(0)
    for value, n in sorted(kinds.items()):
        some = rows.where(F.col(column) == value).select(F.xxhash64("doc_id").alias("_h"), "doc_id", column)
        share = (4 * most + 200) / max(n, 1)
        if share < 1:
            some = some.where(F.col("_h") < int(share * (1 << 64)) - (1 << 63))
        out = out.union(some.distinct().orderBy("_h", "doc_id").select("doc_id", column).limit(most))
    return out


def sample(docs, marks, most_docs: int, most_bytes: int) -> list[tuple[int, object, str]]:
    """``(doc_id, label, text)`` of a bounded sample of the labelled documents ``marks (doc_id, label)``, whole texts all:
    for each label the ids that hash lowest, at most ``most_docs`` of them and until their texts are ``most_bytes`` together.
    A text that is longer than that alone is never in a sample.  Of rows with one id, the least text and label count."""
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = lowest(marks, "label", most_docs)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.max(F.octet_length("text")).alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    room: dict[object, int] = {}
    ids = []
    for r in sorted(found, key=lambda r: r["h"]):
        n = room.get(r["label"], most_bytes) - (r["n"] or 0)
        if n >= 0:
            room[r["label"]] = n
            ids.append((r["doc_id"], r["label"]))
    if not ids:
        return []
    small = spark.createDataFrame(ids, marks.schema)  # at most `most_docs` ids of each label
    got = texts.join(F.broadcast(small), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return sorted(((r["doc_id"], r["label"], r["text"]) for r in got), key=lambda r: r[0])


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id's decimal text, as a Column: the folds of the classifiers."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string").cast("binary"))
