"""Saving and loading graphs, versions of them, and removal of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ModulesPresent(ValueError):
    """Modules of the dump are already there."""


def save(path: str, modules: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
    """Three datasets: ``modules (name)``, ``nodes (node_id, ...)``, ``edges (src, tag, dst, ...)``."""
    modules.select("name").distinct().write.mode("errorifexists").parquet(f"{path}/modules")
    nodes.write.parquet(f"{path}/nodes")
    edges.write.partitionBy("tag").parquet(f"{path}/edges")


def clash(present: DataFrame, new: DataFrame) -> DataFrame:
    """Names in both."""
    return present.select("name").intersect(new.select("name"))


def load(spark: SparkSession, path: str, present: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of a dump with fresh ids that follow those of ``nodes``.  Refused if a module is present."""
    both = clash(present, spark.read.parquet(f"{path}/modules"))
    names = [r["name"] for r in both.orderBy("name").limit(50).collect()]
    if names:
        raise ModulesPresent(", ".join(names))
    got, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("top"))
    ids = renumbered(got.select("node_id").distinct()).join(F.broadcast(top)).select("node_id", (F.col("top") + F.col("n")).alias("new_id"))
    fresh = got.join(ids, "node_id").withColumn("node_id", F.col("new_id")).drop("new_id").select(*got.columns)
    a, b = ids.select(F.col("node_id").alias("src"), F.col("new_id").alias("_s")), ids.select(F.col("node_id").alias("dst"), F.col("new_id").alias("_d"))
    linked = edges.join(a, "src").join(b, "dst").withColumn("src", F.col("_s")).withColumn("dst", F.col("_d")).drop("_s", "_d").select(*edges.columns)
    return fresh, linked


def renumbered(ids: DataFrame, buckets: int = 64) -> DataFrame:
    """``(node_id, n)``, n from 1 without gaps: counted in buckets, so that no task sorts all rows."""
    rows = ids.withColumn("b", F.pmod(F.xxhash64("node_id"), F.lit(buckets)))
    base = rows.groupBy("b").agg(F.count(F.lit(1)).alias("c")).withColumn("base", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # `buckets` rows
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("node_id"))).join(F.broadcast(base), "b").select("node_id", (F.col("base") + F.col("k")).alias("n"))


class Versions:
    """Numbered snapshots of named tables in a folder; undo returns to the one before."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.made = spark, path, 0
        self.numbers: list[int] = []

    def commit(self, **tables: DataFrame) -> int:
        self.made += 1
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{self.made}/{name}")
        self.numbers.append(self.made)
        return self.made

    def table(self, name: str) -> DataFrame:
        if not self.numbers:
            raise ValueError("nothing is stored")
        return self.spark.read.parquet(f"{self.path}/{self.numbers[-1]}/{name}")

    def undo(self) -> int:
        if len(self.numbers) < 2:
            raise ValueError("nothing to undo")
        self.numbers.pop()
        return self.numbers[-1]

    def reset(self) -> None:
        """Empty: all snapshots go, files and all; numbers aren't used again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.numbers = []


def drop_file(tables: dict[str, DataFrame], file_id: int) -> dict[str, DataFrame]:
    """Tables without a file and whatever has its ``file_id``."""
    return {n: df.where(~F.col("file_id").eqNullSafe(file_id)) if "file_id" in df.columns else df for n, df in tables.items()}
