"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a span of tokens; the tokens at its ignored positions may differ.  Hashes of all masked
spans of the benchmark are an index, the same hashes of every document are looked up in it, and around a hit the
document and the benchmark item are compared token by token along the hit's diagonal.  The longest stretch there with a
high enough share of matches, which is also the one of most matches, is an overlap if it has enough of them.

The index of a block of the benchmark, of bounded size, is broadcast; a larger benchmark is taken in several blocks,
each a scan of the documents.  Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import features

#: 1 is a token that must agree, 0 one that is ignored.
MASKS = ("1111101", "110110011", "1011001101", "11000110011")
#: An overlap has at least so many agreeing tokens (or the item's share, if it is shorter) and such a share of them.
MIN_TOKENS, IDENTITY = 13, 0.8
#: Tokens of the benchmark in a block, 64 bytes each with four masks.
BLOCK_TOKENS = 500_000
BITMAP = 24

MEMBER = features.LETTER.copy()
MEMBER[[*range(ord("0"), ord("9") + 1)]] = True


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, row, hash)`` of the lower-cased words of a slice."""
    starts, ends, row = features.words(raw, offsets, MEMBER)
    return starts, ends, row, features.stretch(features.sums(raw), starts, ends)


def _spaced(word: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of every span of ``word`` under a mask."""
    n = len(word) - len(mask) + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i, used in enumerate(mask):
            if used == "1":
                out = out * np.uint64(0x9E3779B97F4A7C15) + word[i : i + n]
    return features.mix(out)


@dataclass
class Index:
    """The seeds of some benchmark items."""

    masks: tuple[str, ...]
    items: list = field(default_factory=list)  # their ids
    words: list[np.ndarray] = field(default_factory=list)  # their tokens
    seeds: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted
    item: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    place: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    bitmap: np.ndarray = field(default_factory=lambda: np.empty(0, bool))


def _masks_for(n: int, masks: tuple[str, ...]) -> tuple[str, ...]:
    """The masks that fit an item of ``n`` tokens; one shorter than all of them is looked for as a whole."""
    fit = tuple(m for m in masks if len(m) <= n)
    return fit or ("1" * n,) if n else ()


def build(items: list[tuple[object, str | None]], masks: tuple[str, ...] = MASKS) -> Index:
    """The index of ``(item_id, text)`` rows.  Items without tokens are in nothing."""
    out = Index(masks)
    found, which, where = [], [], []
    whole: set[str] = set()
    for row0, raw, offsets in features.slices(pa.array([t or "" for _, t in items], pa.string()), lower=True):
        _, _, row, word = tokens(raw, offsets)
        for i, (a, b) in enumerate(zip(*(np.searchsorted(row, np.arange(len(offsets) - 1), s) for s in ("left", "right")), strict=True)):
            out.items.append(items[row0 + i][0])
            out.words.append(word[a:b])
            for mask in _masks_for(int(b - a), masks):
                if mask not in masks:
                    whole.add(mask)
                h = _spaced(word[a:b], mask, len(mask))
                found.append(h)
                which.append(np.full(len(h), len(out.items) - 1, np.int32))
                where.append(np.arange(len(h), dtype=np.int32))
    out.masks = (*masks, *sorted(whole))
    if found:
        seeds = np.concatenate(found)
        order = np.argsort(seeds, kind="stable")
        out.seeds, out.item, out.place = seeds[order], np.concatenate(which)[order], np.concatenate(where)[order]
    out.bitmap = np.zeros(1 << BITMAP, bool)
    out.bitmap[(out.seeds >> np.uint64(64 - BITMAP)).astype(np.int64)] = True
    return out


def _longest(same: np.ndarray) -> tuple[int, int]:
    """The longest stretch ``(start, end)`` along a diagonal of which a share of ``IDENTITY`` agrees, without the tokens at
    its ends that don't.  No other has more agreeing tokens: one that had could be extended beyond it."""
    share = int(round(IDENTITY * 100))
    worth = np.concatenate([[0], np.cumsum(np.where(same, 100 - share, -share))])
    low = np.minimum.accumulate(worth)
    starts = np.searchsorted(-low, -worth)  # the first place that is as low as the end
    start = int(starts[(np.arange(len(worth)) - starts).argmax()])
    at = start + np.flatnonzero(same[start : start + int((np.arange(len(worth)) - starts).max())])
    return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)


def _overlap(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """``(start in the text, length, agreeing tokens)`` of the overlap on a diagonal (text place minus item place)."""
    a, b = max(0, diagonal), min(len(text), diagonal + len(item))
    same = text[a:b] == item[a - diagonal : b - diagonal]
    start, end = _longest(same)
    agree = int(same[start:end].sum())
    need = min(MIN_TOKENS, int(np.ceil(IDENTITY * len(item))))
    if agree < max(1, need):
        return None
    return a + start, end - start, agree


def overlaps(raw: np.ndarray, offsets: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """``(row, item, first token, tokens, agreeing, first byte, last byte + 1)``: the best overlap of each row and item."""
    starts, ends, row, word = tokens(raw, offsets)
    hits: list[np.ndarray] = []
    for mask in index.masks:
        h = _spaced(word, mask, len(mask))
        if not len(h) or not len(index.seeds):
            continue
        some = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - BITMAP)).astype(np.int64)] & (row[: len(h)] == row[len(mask) - 1 :]))
        left, right = (np.searchsorted(index.seeds, h[some], s) for s in ("left", "right"))
        n = right - left
        place = np.repeat(some, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
        hits.append(np.stack([row[place], index.item[at], place - index.place[at]], 1))
    if not hits:
        return
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, item, diagonal in np.unique(np.concatenate(hits), axis=0).tolist():
        a, b = int(bounds[r]), int(bounds[r + 1])
        found = _overlap(word[a:b], index.words[item], diagonal - a)
        if found and ((r, item) not in best or (found[2], -found[0]) > (best[r, item][2], -best[r, item][0])):
            best[r, item] = found
    for (r, item), (start, length, agree) in sorted(best.items()):
        first = int(bounds[r]) + start
        yield r, item, start, length, agree, int(starts[first] - offsets[r]), int(ends[first + length - 1] - offsets[r])


FOUND = "first_token int, tokens int, agreeing int, identity double, start int, length int"


def _search(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    known: Index = index.value
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
    for batch in batches:
        rows: list[int] = []
        items, out = [], []
        for row0, raw, offsets in features.slices(batch.column(1), lower=True):
            for r, item, first, n, agree, a, b in overlaps(raw, offsets, known):
                text = raw[offsets[r] : offsets[r + 1]]
                start = len(text[:a].tobytes().decode("utf-8", "replace"))
                rows.append(row0 + r)
                items.append(known.items[item])
                out.append((first, n, agree, agree / n, start, len(text[a:b].tobytes().decode("utf-8", "replace"))))
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "item_id", "first_token", "tokens", "agreeing", "identity", "start", "length"])


def _blocks(spark: SparkSession, benchmark: DataFrame, masks: tuple[str, ...], block_tokens: int) -> list:
    """Broadcast indexes of the benchmark, each of about ``block_tokens`` tokens; at least one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # A token has at least one character and one between it and the next.
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_tokens))
    out = []
    for block in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        out.append(spark.sparkContext.broadcast(build([(r["item_id"], r["text"]) for r in some.orderBy("item_id", "text").collect()], masks)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The best overlap of each document and item that have one: ``doc_id, item_id, first_token, tokens, agreeing, identity,
    start, length``; the last two are a character offset and length in the lower-cased text.

    Null and empty texts overlap with nothing, on either side.  Items of equal text are separate.  Repeated rows of a
    document give repeated rows; null ids are kept.  An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _blocks(docs.sparkSession, benchmark, masks, block_tokens):
        found = rows.mapInArrow(partial(_search, index=index), f"doc_id long, item_id long, {FOUND}")
        out = found if out is None else out.union(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the rows whose text overlaps with an item; all columns stay, nothing is shuffled."""

    def flag(index):
        @F.arrow_udf("boolean")
        def overlapping(texts: pa.Array) -> pa.Array:
            out = np.zeros(len(texts), bool)
            for row0, raw, offsets in features.slices(texts, lower=True):
                out[[row0 + r for r, *_ in overlaps(raw, offsets, index.value)]] = True
            return pa.array(out)

        return overlapping(F.col("text").cast("string"))

    clean = docs
    for index in _blocks(docs.sparkSession, benchmark, masks, block_tokens):
        clean = clean.where(~flag(index))
    return clean
