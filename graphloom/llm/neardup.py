"""Near duplicates of whole texts: SimHash fingerprints link texts, an exact similarity join links the rest.

Texts whose fingerprints (:mod:`graphloom.llm.simhash`, five-word shingles, repeats included) differ in at most 3 bits are
linked, as that operator links them.  As shingles count as often as they occur, these are also texts that repeat the same
passages and differ in little else, whose sets of shingles may have little in common.  Edited copies are often further apart than
3 bits, so an exact join by Jaccard similarity goes on from there.  The tokens of a text are the distinct hashes of its shingles
of five lower-cased words, across lines (a shorter text is one token).  Sets are made, ordered and filtered as for lines
(:mod:`graphloom.llm.linededup`): two texts of similarity ``t`` or more share a token of their prefixes, and what passes the
length and positional filters and that of the parities is verified on the whole sets, so no pair is missed.

Groups are connected components of all links of either kind.  Equal sets are one node.  The texts that share a token are first
compared with one of them, if fingerprints don't link the two; then only pairs that aren't yet connected are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import features, simhash
from graphloom.llm.store import components, drop, free, keep, small

SHINGLE = 5
BUCKET_BITS = 16
#: Texts hashed at a time: a quarter of the usual, as each token takes several arrays here.
SLICE_BYTES = 512 << 10
#: The parity of a set has at least as many bits as tokens, a power of two up to this; more only tell apart less.
PARITY_BITS = 1 << 16
#: Bytes of words: all but ASCII white space.
MEMBER = np.ones(256, bool)
MEMBER[[9, 10, 11, 12, 13, 32]] = False


def _hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, line, first, hashes)``: row and line number of each line with words in a slice, and where its shingles begin in
    ``hashes``, closed by their number."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    bounds = np.append(starts, len(raw))
    begin, end, of = features.words(raw, bounds, MEMBER)
    word = features.stretch(features.sums(raw), begin, end)
    n = np.bincount(of, minlength=len(starts))
    lines = np.flatnonzero(n)
    n = n[lines]
    first_word = np.cumsum(n) - n
    shingles = np.maximum(n - SHINGLE + 1, 1)
    first = np.concatenate([[0], np.cumsum(shingles)])
    at = np.repeat(first_word - first[:-1], shingles) + np.arange(first[-1])
    out = np.zeros(len(at), np.uint64)
    size = np.repeat(np.minimum(n, SHINGLE), shingles)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            some = size > i
            out[some] = out[some] * np.uint64(0x9E3779B97F4A7C15) + word[at[some] + i]
        out = features.mix(out + size.astype(np.uint64))
    where = starts[lines]
    row = np.searchsorted(offsets, where, side="right") - 1
    upto = np.searchsorted(breaks, offsets[:-1])
    return row, np.searchsorted(breaks, where) - upto[row], first, out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for _, raw, offsets in features.slices(batch.column(0), SLICE_BYTES, lower=True):
            h = _hashed(raw, offsets)[3]
            found += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(found))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], names=["b", "n"])


def _places(docs: DataFrame) -> np.ndarray:
    """The place of each bucket of hashes, by how often its tokens occur in all lines."""
    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()  # as many rows as buckets
    count = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in got:
        count[r["b"]] = r["n"]
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    return place


def _sorted_sets(raw: np.ndarray, offsets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(row, line, first, keys)`` as of :func:`_hashed`, but the keys of a line are a set in the global order."""
    row, line, first, h = _hashed(raw, offsets)
    rest = np.uint64(64 - BUCKET_BITS)
    with np.errstate(over="ignore"):
        key = ((place[(h >> rest).astype(np.int64)] - (1 << (BUCKET_BITS - 1))) << np.int64(rest)) | (h & np.uint64((1 << int(rest)) - 1)).astype(np.int64)
    own = np.repeat(np.arange(len(row)), np.diff(first))
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])) if len(key) else np.empty(0, bool)
    key, own = key[new], own[new]
    return row, line, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(row)))]), key


def _parities(key: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """The parity of each set of keys: a token changes one bit, so two sets differ in as many tokens as bits at least.  One of
    twice as many bits is made comparable by folding it."""
    n = np.diff(first)
    bits = np.minimum(64 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64), PARITY_BITS)
    begin = np.concatenate([[0], np.cumsum(bits)])
    count = np.bincount(np.repeat(begin[:-1], n) + (key & (np.repeat(bits, n) - 1)), minlength=begin[-1])
    words = np.packbits((count & 1).astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(begin // 64, pa.int32()), pa.array(words))


def _differing(a: str, b: str) -> Column:
    """How many bits of two parities differ, the longer one folded to the length of the other."""
    short = F.least(F.size(a), F.size(b))

    def folded(m: str) -> Column:
        return F.transform(F.slice(m, F.lit(1), short), lambda _, i: F.aggregate(F.sequence(i, F.size(m) - 1, short), F.lit(0).cast("long"), lambda z, j: z.bitwiseXOR(F.get(m, j))))

    plain = F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))).otherwise(F.zip_with(folded(a), folded(b), lambda x, y: x.bitwiseXOR(y)))
    return F.aggregate(plain, F.lit(0), lambda z, x: z + F.bit_count(x))


def _set_rows(batches: Iterator[pa.RecordBatch], places, threshold: float) -> Iterator[pa.RecordBatch]:
    place = places.value
    for batch in batches:
        for row0, raw, offsets in features.slices(batch.column(2), SLICE_BYTES, lower=True):
            row, line, first, key = _sorted_sets(raw, offsets, place)
            n = np.diff(first)
            with np.errstate(over="ignore"):
                total = np.concatenate([[0], np.cumsum(features.mix(key.view(np.uint64)), dtype=np.uint64)]).astype(np.uint64)
                sid = features.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64)
            some = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            keep_ = np.arange(len(key)) - np.repeat(first[:-1], n) < np.repeat(some, n)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]), pa.int32()), pa.array(key[keep_]))
            at = pa.array(row0 + row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()), pa.array(sid), pa.array(n, pa.int32()), prefix, _parities(key, first)], names=["doc_id", "dk", "line", "sid", "n", "p", "m"])


def _whole_rows(batches: Iterator[pa.RecordBatch], places) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row0, raw, offsets in features.slices(batch.column(1), SLICE_BYTES, lower=True):
            row, _, first, key = _sorted_sets(raw, offsets, places.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row0 + row)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(key))], names=["sid", "s"])


def _one_line(docs: DataFrame) -> DataFrame:
    """``(doc_id, dk, text)`` with each text on one line; ``dk`` stands for the row's id and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", " ").alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text")


def _rooted(edges: DataFrame) -> DataFrame:
    """``(sid, root)`` of the sets that are connected to a smaller one."""
    return keep(components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("sid"), F.col("v").alias("root")), "roots")


def _by_fingerprint(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of sets whose texts' fingerprints link them: each set with the least of its fingerprint, and those
    of linked fingerprints with each other.  A set has a fingerprint for each of its texts, as they may repeat shingles."""
    prints = simhash.fingerprints(rows.select(F.col("dk").alias("doc_id"), "text"), shingle_words=SHINGLE).select(F.col("doc_id").alias("dk"), "fp")
    known = keep(sets.select("sid", "dk").join(keep(prints.distinct(), "prints"), "dk").select("sid", "fp").distinct(), "fingerprints")
    least = keep(known.groupBy("fp").agg(F.min("sid").alias("a")), "least")
    pairs = simhash.links(least.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    ends = (least.select(F.col("fp").alias(f), F.col("a").alias(s)) for f, s in (("fa", "x"), ("fb", "y")))
    linked = pairs.join(next(ends), "fa").join(next(ends), "fb").select("x", "y")
    same = known.join(least, "fp").where("sid <> a").select("a", "sid")
    return linked.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def groups(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)`` of every row of ``docs (doc_id, text)`` with words: texts whose fingerprints differ in at most
    3 bits and texts of similarity ``threshold`` or more are linked, ``component_id`` is the smallest non-null ``doc_id``
    reachable, else null."""
    t, spark = F.lit(threshold), docs.sparkSession
    rows = _one_line(docs)
    places = spark.sparkContext.broadcast(_places(rows))
    sets = keep(rows.mapInArrow(partial(_set_rows, places=places, threshold=threshold), "doc_id long, dk long, line int, sid long, n int, p array<long>, m array<long>"), "sets")
    distinct = keep(sets.groupBy("sid").agg(F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in ("dk", "n", "m"))), "distinct")
    postings = sets.select("sid", "n", F.posexplode("p").alias("at", "tok"))
    shared = keep(postings.groupBy("tok").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("tok"), "shared")
    free(spark)
    every = keep(postings.join(small(shared), "tok").groupBy("tok", "sid").agg(F.min("n").alias("n"), F.min("at").alias("at")), "met")
    free(spark)

    def likely(n_sum: Column, n_least: Column, n_most: Column, can: Column) -> Column:
        """Whether two sets pass the length and positional filters, of their sizes and of what can be shared from the token on."""
        return (n_least >= t * n_most - 1e-9) & (can >= t / (1 + t) * n_sum - 1e-9)

    # Many tokens are shared by two sets only that are too different in size, or share it too late: these go first.
    tally = every.groupBy("tok").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max("n").alias("most"), F.min(F.col("n") - F.col("at")).alias("can"))
    live = keep(tally.where((F.col("k") > 2) | likely(F.col("n"), F.col("n") - F.col("most"), F.col("most"), F.col("can"))).select("tok"), "live")
    met = keep(every.join(small(live), "tok"), "met")
    drop(shared, every, live)
    lead = keep(met.groupBy("tok").agg(F.min(F.struct("sid", "n", "at")).alias("y")), "lead")
    free(spark)

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs ``(a, b)`` that pass the length and positional filters, and the parities'."""
        can = 1 + F.least(F.col("x_n") - F.col("x_at") - 1, F.col("y_n") - F.col("y_at") - 1)
        some = pairs.where(likely(F.col("x_n") + F.col("y_n"), F.least("x_n", "y_n"), F.greatest("x_n", "y_n"), can))
        some = keep(some.select(F.least("x_sid", "y_sid").alias("a"), F.greatest("x_sid", "y_sid").alias("b")).distinct(), "candidates")
        x, y = (distinct.select(F.col("sid").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in "nm")) for s in "ab")
        n = F.col("a_n") + F.col("b_n")
        return small(some).join(x, "a").join(y, "b").where((n - _differing("a_m", "b_m")) / 2 >= t / (1 + t) * n - 1e-9).select("a", "b")

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets, made again from one text of each, are similar."""
        wanted = keep(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(distinct, "sid").select("sid", "dk"), "wanted")
        again = rows.join(small(wanted), "dk").select("sid", "text").dropDuplicates(["sid"])
        whole = keep(again.mapInArrow(partial(_whole_rows, places=places), "sid long, s array<long>"), "whole")
        both = small(pairs).join(whole.select(F.col("sid").alias("a"), F.col("s").alias("xs")), "a").join(whole.select(F.col("sid").alias("b"), F.col("s").alias("ys")), "b")
        common = F.size(F.array_intersect("xs", "ys"))
        out = keep(both.where(common >= t * (F.size("xs") + F.size("ys") - common) - 1e-9).select("a", "b"), "similar")
        drop(wanted, whole)
        free(spark)
        return out

    x, y = (met.select("tok", *(F.col(c).alias(f"{s}_{c}") for c in ("sid", "n", "at"))) for s in "xy")
    led = near(x.join(lead.select("tok", *(F.col(f"y.{c}").alias(f"y_{c}") for c in ("sid", "n", "at"))), "tok").where("x_sid <> y_sid"))
    linked = keep(_by_fingerprint(rows, sets), "linked")
    led = keep(led.join(linked, ["a", "b"], "left_anti"), "led")
    first = linked.union(similar(led))
    root = _rooted(first)
    of = lambda s: root.select(F.col("sid").alias(f"{s}_sid"), F.col("root").alias(f"{s}_root"))
    x, y = (side.join(of(s), f"{s}_sid", "left").withColumn(f"{s}_root", F.coalesce(f"{s}_root", f"{s}_sid")) for side, s in ((x, "x"), (y, "y")))
    # Where all of a token's texts are connected already, none are paired.
    apart = keep(x.groupBy("tok").agg(F.min("x_root").alias("a"), F.max("x_root").alias("b")).where("a <> b").select("tok"), "apart")
    rest = x.join(apart, "tok").join(y, "tok").where("x_sid < y_sid AND x_root <> y_root")
    second = similar(keep(near(rest).join(led, ["a", "b"], "left_anti"), "rest"))
    root = _rooted(first.union(second))

    joined = keep(distinct.join(root, "sid", "left").select("sid", "rep", F.coalesce("root", "sid").alias("root")), "joined")
    least = keep(joined.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    known = keep(joined.join(least, "root").select("sid", "component_id"), "known")
    out = keep(sets.select("doc_id", "sid").join(known, "sid").select("doc_id", "component_id"), "groups")
    drop(sets, distinct, met, lead, linked, led, apart, joined, least, known)
    free(spark)
    return out


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest ``doc_id``; all columns are kept.

    Null texts and texts without words are a group of their own.  Rows of a repeated ``doc_id`` stay together.  Rows without
    ``doc_id`` stay, as they can't be told apart.  An empty table gives no rows.
    """
    blank = _one_line(docs).where(~F.col("text").rlike(r"[^\t\n\x0B\f\r ]")).select("doc_id")
    blank = blank.join(F.broadcast(blank.agg(F.min("doc_id").alias("component_id"))))
    found = keep(groups(docs, threshold).union(blank).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti")
