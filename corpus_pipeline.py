"""A corpus pipeline: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes what its predecessor kept, written as Parquet and read again.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontam, langid, linededup, neardup, packing, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: those that identification rejects go.

    Null and empty texts and texts without a letter are rejected.  Repeated rows and rows without ``doc_id`` are judged by their
    text like any other.  An empty table gives no rows, and other columns stay as they are.
    """
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; ``n_chars`` follows.  Emptied documents stay rows.

    Null texts stay null.  Rows of equal ``doc_id`` and text are one document; rows without ``doc_id`` come first in the order.
    """
    return linededup.dedup(docs, threshold=0.8).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    SimHash fingerprints link texts within 3 bits, an exact join those of similarity 0.8 on five-word shingles.  Texts without words are a group
    of their own.  Rows of a repeated ``doc_id`` stay or go together; rows without ``doc_id`` stay.
    """
    return neardup.keep_one(docs, threshold=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts hold none, and null and empty items are in none.  Repeated rows go together; no ``doc_id`` is needed.
    """
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences of 4,096 tokens.

    A null or empty text is a piece of the end id alone.  Repeated rows are packed as often as they occur, null ids are kept.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("best-fit packing", pack)]

#: Hashing, tokenizers and the packing plan are beyond SQL; the pipeline is tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
