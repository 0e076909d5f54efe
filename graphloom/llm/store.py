"""Tables kept in the shared folder of a cluster, and connected components built on them.

Every intermediate result that is read more than once is written as Parquet to the folder named by
``spark.checkpoint.dir``; that cuts lineage and survives the loss of an executor.  Only where the setting is
missing on a local master (tests, a laptop) a temporary folder takes its place; a cluster is refused.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of this application."""
    base = spark.conf.get(_SETTING, None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"{_SETTING} has to name a folder that the whole cluster shares")
        base = _own.setdefault(app, tempfile.mkdtemp(prefix="graphloom-"))
    return f"{base.rstrip('/')}/graphloom-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """The size of the files of a table written by :func:`keep`."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_path)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def small(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """A kept table to be broadcast if its files are no larger than ``most_bytes``; beyond that it is joined by shuffling."""
    return F.broadcast(df) if stored_bytes(df) <= most_bytes else df


def drop(*tables: DataFrame) -> None:
    """Delete tables written by :func:`keep` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.  It does so for plans that the driver's JVM has found to be
    garbage, and a driver with little to do collects its garbage too rarely for the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges ``(u long, v long)``: one row ``(u, v)`` for every node ``u`` that
    has an edge to a smaller reachable node, ``v`` being the smallest node reachable.  Smallest nodes have no row.

    Alternating large-star and small-star rounds, each written to the shared folder, so neither the edges nor the
    components ever meet in one process.  Per-node minima are aggregated before the shuffle and read back from
    storage before they are joined, which lets adaptive execution split the join of a node with very many edges.
    Self loops and repeated edges are harmless; no edges give no rows.
    """
    now = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            return now
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = keep(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(now, least, large, low)
        now, before, seen = after, seen, _digest(after)
        if seen == before:
            return now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
