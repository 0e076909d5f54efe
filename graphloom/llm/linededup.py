"""Line deduplication by an exact set-similarity join, without Python; loops over tokens are compiled (:mod:`graphloom.llm.loops`).

The tokens of a line are the pairs of neighbouring lower-cased words (``shingle`` words in general; a line of fewer words is
one token).  A global order of tokens puts rare ones first.  Two lines whose sets have a Jaccard similarity of at least ``t``
share a token among the first ``n - ceil(t n) + 1`` of each (prefix filter); sizes and the places of the shared token bound
what they can still share (length and positional filters); a parity of 64 bits for each set, 128 for long lines, bounds it too, as
a token that only one set has changes one bit.  What passes is verified on the whole sets.  A line is removed if it is similar to
any line before it, in order of document and line.

Single words can be tokens too (``shingle=1``), but their number hardly grows with the corpus, so the lists of lines that share
one do, and the pairs to be looked at with their square; pairs of words stay rare.

How it stays linear: lines are read from the documents again where they are needed, which takes less than keeping their words;
equal sets are collapsed first and only their first line is compared; rarity comes from counts of all words in a fixed number of hash buckets, so the order is a table of
fixed size that any task can hold, and frequent tokens stay out of prefixes; only tokens that two different sets share are
looked up again.  Where a token is in very many prefixes, its lines are first compared with the earliest of them, which is
enough to remove most; only lines that are still there are compared with all earlier ones.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.loops import each
from graphloom.llm.store import drop, free, keep, small

SHINGLE = 2
#: Words are counted in 2 ** 17 buckets of their hashes, a table of half a megabyte.  Any order gives the same decisions.
BUCKET_BITS = 17
#: Sets of more tokens have a parity of 128 bits instead of 64, which their tokens would fill: ``m`` of all tokens, ``h`` of half.
LONG_LINE = 30
SPACES = "\t\x0b\f\r"


def _plain(text: Column) -> Column:
    held = reduce(or_, (text.contains(x) for x in SPACES))
    return F.when(held, F.translate(text, SPACES, " " * len(SPACES))).otherwise(text)


def _lines(docs: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """``(doc_id, dk, line, words)``: every line with words; ``dk`` stands for the row's id and text.  ``within``: a small table
    of the ``dk`` to look at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text")
    if within is not None:
        rows = rows.join(F.broadcast(within.select("dk")), "dk", "left_semi")
    rows = rows.select("doc_id", "dk", F.lower(_plain(F.col("text"))).alias("text"))
    return rows.select("doc_id", "dk", F.posexplode(F.split("text", "\n", -1)).alias("line", "words")).where(F.trim("words") != "")


def _hashes(words: str) -> Column:
    """The hashes of a line's words in order."""
    return each(F.array_remove(F.split(words, " ", -1), ""), "string", lambda w: F.hash(w))


def _shingles(words: str, shingle: int, token) -> Column:
    """``token(words)`` of each shingle; beyond the end its words are null, so a line of fewer words is one token."""
    n = F.greatest(F.size(words) - (shingle - 1), F.lit(1))
    near = F.arrays_zip(*(F.slice(words, F.lit(j + 1), n).alias(f"w{j}") for j in range(shingle)))
    return each(near, ", ".join(f"w{j} int" for j in range(shingle)), lambda x: token([x[f"w{j}"] for j in range(shingle)]))


def _levels(lines: DataFrame) -> DataFrame:
    """One row with the level of each bucket of word hashes: the logarithm of how often its words occur, in 16ths."""
    words = lines.select(F.explode(F.split("words", " ", -1)).alias("w")).where("w <> ''").select(F.shiftrightunsigned(F.hash("w"), 32 - BUCKET_BITS).alias("b"))
    # Four buckets are counted in a row, so all rows fit into the small table that Spark's generated code looks into first.
    each_of = [F.sum((F.col("b").bitwiseAND(F.lit(3)) == i).cast("long")).alias(f"n{i}") for i in range(4)]
    met = words.groupBy(F.shiftright("b", 2).alias("b")).agg(*each_of).select("b", F.array("n0", "n1", "n2", "n3").alias("n"))
    met = met.select(F.col("b"), F.posexplode("n").alias("i", "n")).select((F.col("b") * 4 + F.col("i")).alias("b"), "n")
    every = words.sparkSession.range(1 << BUCKET_BITS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("n"))
    level = every.union(met).groupBy("b").agg(F.round(16 * F.log1p(F.sum("n"))).cast("int").alias("level"))
    return keep(level.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "level"))), lambda x: x["level"]).alias("level")), "levels")


def _ordered(words: DataFrame, levels: DataFrame, shingle: int) -> DataFrame:
    """``w`` replaced by the sorted set ``s`` of its tokens: the levels of a token's words, added up, then 52 bits of its hash.
    The sum stands for how rare the words are expected to meet, so rare tokens come first."""
    held = words.withColumn("level", levels.scalar())  # used once below, so it stays a constant and fills no column

    def key(some: list[Column]) -> Column:
        each = (F.coalesce(F.get("level", F.shiftrightunsigned(x, 32 - BUCKET_BITS)), F.lit(0)) for x in some)
        return F.shiftleft(F.least(sum(each, F.lit(0)), F.lit(2047)).cast("long"), 52).bitwiseOR(F.xxhash64(*some).bitwiseAND(F.lit((1 << 52) - 1)))

    return held.select(*(c for c in words.columns if c != "w"), F.sort_array(F.array_distinct(_shingles("w", shingle, key))).alias("s"))


def removed_lines(docs: DataFrame, threshold: float = 0.8, shingle: int = SHINGLE) -> DataFrame:
    """``(dk, line)`` of the lines to remove; ``dk`` is ``xxhash64(doc_id, text)``."""
    t, spark = F.lit(threshold), docs.sparkSession
    lines = _lines(docs)
    levels = _levels(lines)
    prefix = F.slice("s", F.lit(1), F.size("s") - F.ceil(F.size("s") * t - 1e-9).cast("int") + 1)

    def parity(bit) -> Column:
        return F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", bit(x), x.bitwiseAND(F.lit(63)).cast("int"))))

    whole = parity(lambda x: F.lit(1).cast("long"))
    half = F.when(F.size("s") > LONG_LINE, parity(lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(1).cast("long")))).otherwise(F.lit(0).cast("long"))
    words = lines.select("doc_id", "dk", "line", _hashes("words").alias("w"))
    sets = keep(_ordered(words, levels, shingle).select("doc_id", "dk", "line", F.xxhash64("s").alias("sid"), F.size("s").alias("n"), whole.alias("m"), half.alias("h"), prefix.alias("p")), "sets")
    first = keep(sets.groupBy("sid").agg(F.min(F.struct("doc_id", "dk", "line")).alias("o"), F.count(F.lit(1)).alias("lines"), *(F.min(c).alias(c) for c in ("n", "m", "h")), F.first("p").alias("p")), "first")
    free(spark)

    # The smaller of two similar sets has a shared token in a still shorter prefix; ``k`` counts the sets of a token, and in
    # its upper half those that have it there.
    early = F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)) - 1e-9)
    postings = first.select("sid", "n", "m", "h", "o", F.posexplode("p").alias("at", "tok"))
    tokens = postings.groupBy("tok").agg(F.sum(F.when(early, F.lit((1 << 32) + 1)).otherwise(F.lit(1).cast("long"))).alias("k"))
    shared = keep(tokens.where((F.col("k") >= F.lit(1 << 32)) & (F.col("k").bitwiseAND(F.lit((1 << 32) - 1)) > 1)).select("tok"), "shared")
    free(spark)
    sized = keep(postings.join(small(shared), "tok").select("tok", "sid", "n", "m", "h", "at", "o"), "sized")
    free(spark)

    def likely(n_sum: Column, n_least: Column, n_most: Column, can: Column, m: Column, h: Column) -> Column:
        """Whether two sets pass the length and positional filters and the parities': of their sizes and of what can be shared
        from the token on the sum, least and most, and what their parities differ by."""
        least = t / (1 + t) * n_sum - 1e-9
        odd = F.when(n_least > LONG_LINE, F.bit_count(h) + F.bit_count(m.bitwiseXOR(h))).otherwise(F.bit_count(m))
        return (n_least >= t * n_most - 1e-9) & (can >= least) & ((n_sum - odd) / 2 >= least)

    # Most tokens are shared by two sets that have little else in common: these go before any set is looked at again.
    tally = sized.groupBy("tok").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max("n").alias("most"), F.min(F.col("n") - F.col("at")).alias("can"), F.bit_xor("m").alias("m"), F.bit_xor("h").alias("h"))
    live = keep(tally.where((F.col("k") > 2) | likely(F.col("n"), F.col("n") - F.col("most"), F.col("most"), F.col("can"), F.col("m"), F.col("h"))).select("tok"), "live")
    drop(shared)
    free(spark)
    placed = keep(sized.join(small(live), "tok"), "placed")
    drop(sized, live)
    free(spark)
    x = placed.select("tok", *(F.col(c).alias(f"x_{c}") for c in ("sid", "n", "m", "h", "at", "o")))

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose later line passes the length and positional filters with the earlier one, and the parities'."""
        can = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))  # if the token is the first that they share
        m, h = (F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}")) for c in "mh")
        return pairs.where(likely(F.col("x_n") + F.col("y_n"), F.least("x_n", "y_n"), F.greatest("x_n", "y_n"), can, m, h)).select("x_sid", "y_sid").distinct()

    def similar(pairs: DataFrame) -> DataFrame:
        """The later lines of the kept pairs whose whole sets, made again from the lines that came first, are similar."""
        wanted = keep(pairs.select(F.col("x_sid").alias("sid")).union(pairs.select("y_sid")).distinct().join(first, "sid").select("sid", "o.dk", "o.line"), "wanted")
        few = small(wanted) is not wanted
        whole = keep(_lines(docs, wanted if few else None).join(small(wanted), ["dk", "line"]).select("sid", "words").dropDuplicates(["sid"]).select("sid", _hashes("words").alias("w")).select("sid", F.array_distinct(_shingles("w", shingle, lambda some: F.xxhash64(*some))).alias("s")), "whole")
        free(spark)
        both = small(pairs).join(whole.select(F.col("sid").alias("x_sid"), F.col("s").alias("xs")), "x_sid").join(whole.select(F.col("sid").alias("y_sid"), F.col("s").alias("ys")), "y_sid")
        shared_by = both.select("x_sid", F.size(F.array_intersect("xs", "ys")).alias("c"), (F.size("xs") + F.size("ys")).alias("n"))
        out = keep(shared_by.where(F.col("c") >= t * (F.col("n") - F.col("c")) - 1e-9).select(F.col("x_sid").alias("sid")).distinct(), "similar")
        drop(wanted, whole)
        free(spark)
        return out

    lead = keep(placed.groupBy("tok").agg(F.min(F.struct("o", "sid", "n", "m", "h", "at")).alias("y")), "lead")
    led = x.join(lead, "tok").where(F.col("x_sid") != F.col("y.sid")).select("x_sid", "x_n", "x_m", "x_h", "x_at", *(F.col(f"y.{c}").alias(f"y_{c}") for c in ("sid", "n", "m", "h", "at")))
    with_lead = keep(near(led), "pairs")
    soon = similar(with_lead)
    left = x.join(soon, x["x_sid"] == soon["sid"], "left_anti")
    y = placed.select("tok", *(F.col(c).alias(f"y_{c}") for c in ("sid", "n", "m", "h", "at", "o")))
    with_all = keep(near(left.join(y, "tok").where("y_o < x_o")).join(with_lead, ["x_sid", "y_sid"], "left_anti"), "pairs")
    late = similar(with_all)

    # Every line of a set that resembles an earlier one goes; of the others all but the first line.
    gone = soon.union(late).distinct()
    repeated = first.where("lines > 1").select("sid", F.struct("o.dk", "o.line").alias("keep"))
    fate = repeated.join(gone.withColumn("all", F.lit(True)), "sid", "full").select("sid", "keep", F.coalesce("all", F.lit(False)).alias("all"))
    out = keep(sets.select("sid", "dk", "line").join(fate, "sid").where(F.col("all") | (F.struct("dk", "line") != F.col("keep"))).select("dk", "line"), "removed-lines")
    drop(levels, placed, lead, with_lead, with_all, soon, late, first, sets)
    free(spark)
    return out


def dedup(docs: DataFrame, threshold: float = 0.8, shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` with repeated lines taken out of ``text``, and ``lines_removed``.

    Lines are what newlines separate; a removed one goes with its newline.  Words are what ASCII white space separates; lines
    without words always stay.  A null text stays null, an empty one empty; a document may become empty, its row stays.  Rows
    of equal ``doc_id`` and text are one document and get the same text; rows without ``doc_id`` come first in the order.  An
    empty table gives no rows.  If ``n_chars`` is a column it is brought up to date.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = removed_lines(docs, threshold, shingle)
    by_row = keep(out.groupBy("dk").agg(F.collect_set("line").alias("_lines")).select(F.col("dk").alias("_dk"), "_lines"), "by-row")
    marked = docs.withColumn("_key", key).join(small(by_row), F.col("_key") == F.col("_dk"), "left")
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col("_lines"), i)), "\n"))
    cut = marked.withColumn("text", text).withColumn("lines_removed", F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns, "lines_removed")
