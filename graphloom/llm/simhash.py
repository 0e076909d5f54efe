"""SimHash near-duplicate detection over a byte-position inverted index.

A fingerprint of 64 bits is eight positional bytes.  Two fingerprints that differ in at most ``k`` bits share at
least ``8 - k`` positional bytes, the guaranteed minimum.  The index holds, for every choice of that many
positions, the posting list of each combination of bytes: the intersection of the byte-position lists, so that no
list grows with the share of one byte.  Pairs met in a list are tallied over all eight positions, kept at the
minimum, and verified on the bits.

Only distinct fingerprints are indexed, so copies cost one posting.  A list of at most ``SMALL_LIST`` fingerprints
emits its pairs, at most a fixed number for each posting.  Fingerprints of longer lists (large groups of near copies)
are linked exactly through flipped neighbours instead: ``d(a, b) <= 3`` exactly if some ``c`` has ``d(a, c) <= 1`` and
``d(c, b) <= 2``, and all fingerprints within 2 of such a ``c`` are within 3 of ``a``; one edge to one such ``a`` for
each of them keeps the components whole without a row for each pair.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import components, drop, keep

SMALL_LIST = 24
#: Up to so many lists of three or more, 16 bytes each, are broadcast; more are joined by shuffling.
BROADCAST_LISTS = 1_000_000
#: Shingles hashed at a time; a long text is taken in pieces of this many words.
PIECE_WORDS = 1 << 16


def _bit_counts(digests: bytes) -> np.ndarray:
    """How often each of the 64 bits (most significant first) is set in 8-byte big-endian hashes."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # sums of 255 bits fit a byte, which is much faster to add up
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text: A-Z lower-cased, words between ASCII white space, shingles with repeats,
    a bit set if it is set in over half of the shingles' XXH64.  Fewer words than a shingle: the whole sequence is
    the only shingle.  No words, empty or null: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = partial(xxhash.xxh64_digest, seed=seed)
    if n <= shingle_words:
        counts, total = _bit_counts(digest(b" ".join(words))), 1
    else:
        counts, total = np.zeros(64, np.int64), n - shingle_words + 1
        for at in range(0, total, PIECE_WORDS):
            some = words[at : at + PIECE_WORDS + shingle_words - 1]
            shingles = map(b" ".join, zip(*(itertools.islice(some, i, None) for i in range(shingle_words)), strict=False))
            counts += _bit_counts(b"".join(map(digest, shingles)))
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle_words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py(), shingle_words, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id long, fp long)``: the fingerprint of each row's text, as a signed long with the same bits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle_words=shingle_words, seed=seed), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _postings(fps: DataFrame, shared: int) -> DataFrame:
    """A row ``(list, fp)`` for each fingerprint and choice of ``shared`` byte positions.  The list's number stands
    in a byte that the choice leaves out; lists of different choices that happen to agree only add candidates."""
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(8), shared)):
        mask = sum(0xFF << 8 * p for p in chosen)
        free = next((p for p in range(8) if p not in chosen), None)
        tag = number << 8 * free if free is not None else 0
        keys.append(F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseOR(F.lit(_signed(tag))))
    return fps.select(F.explode(F.array(*keys)).alias("list"), "fp")


def _shared_bytes(x: str, y: str):
    """The tally of a pair: how many positional bytes agree."""
    differ = F.col(x).bitwiseXOR(F.col(y))
    return sum((F.when(differ.bitwiseAND(F.lit(_signed(0xFF << 8 * p))) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def _flips(fps: DataFrame, most: int) -> DataFrame:
    """Rows ``(c, fp)``: each fingerprint with all values within ``most`` (at most 2) bits of it."""
    masks = [0] + [1 << i for i in range(64)] * (most >= 1) + [(1 << i) | (1 << j) for i in range(64) for j in range(i)] * (most >= 2)
    table = fps.sparkSession.createDataFrame([(_signed(m),) for m in masks], "flip long")  # 1, 65 or 2,081 rows
    return fps.join(F.broadcast(table)).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("c"), "fp")


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) whose connected components are those of all
    pairs that differ in at most ``max_bits`` bits (1 to 3)."""
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits is 1, 2 or 3")
    shared = 8 - max_bits
    postings = _postings(fps, shared)
    lists = keep(postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "lists")
    several = lists.where("n > 2").select("list", "n")
    if several.count() <= BROADCAST_LISTS:
        several = F.broadcast(several)  # then the postings needn't be shuffled again
    longer = keep(postings.join(several, "list").select("list", "n", "fp"), "longer")
    members = longer.where(F.col("n") <= SMALL_LIST).groupBy("list").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    met = members.select(F.explode("m").alias("a"), "m").select("a", F.explode(F.filter("m", lambda x: x > F.col("a"))).alias("b"))
    pairs = lists.where("n = 2").select("a", "b").union(met)
    near = (
        pairs.where(_shared_bytes("a", "b") >= shared)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .distinct()
    )
    crowded = keep(longer.where(F.col("n") > SMALL_LIST).select("fp").distinct(), "crowded")
    heads = keep(_flips(crowded, max(0, max_bits - 2)).groupBy("c").agg(F.min("fp").alias("a")), "heads")
    around = _flips(crowded, min(2, max_bits)).join(heads, "c").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return near.union(around.where(_shared_bytes("a", "b") >= shared))


def groups(docs: DataFrame, max_bits: int = 3, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs (doc_id, text)``: fingerprints within ``max_bits`` bits
    are linked, ``component_id`` is the smallest ``doc_id`` reachable.

    Null and empty texts and texts without words have fingerprint 0 and are linked like any other.  Repeated rows
    give repeated rows; a null ``doc_id`` keeps its row, counts last as a representative and gets the smallest
    non-null one of its component, else null.  An empty table gives no rows.  Other columns are ignored.
    """
    prints = keep(fingerprints(docs, shingle_words, seed), "prints")
    distinct = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    edges = keep(links(distinct.select("fp"), max_bits), "links")
    # Components of fingerprints first; representatives follow, so that null ids disturb nothing.
    joined = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = keep(distinct.join(joined, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    least = keep(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    known = keep(rooted.join(least.select("root", "component_id"), "root").select("fp", "component_id"), "known")
    drop(edges, rooted, least)
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = 3, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """The query's shape: ``(doc_id, fingerprint 16 hex digits, component_id)``; see :func:`groups`."""
    return groups(docs, max_bits, shingle_words, seed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = 3, shingle_words: int = 5, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest ``doc_id``; all columns are kept.

    Rows of a repeated ``doc_id`` stay together.  Rows without ``doc_id`` stay, as they can't be told apart.
    """
    found = keep(groups(docs, max_bits, shingle_words, seed).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti")
