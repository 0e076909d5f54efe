"""Intermediate tables in the shared folder of a cluster (``spark.checkpoint.dir``).  Where that is unset a local master takes a
temporary folder, and a cluster is refused."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        base = _own.setdefault(app, tempfile.mkdtemp(prefix="graphloom-"))
    return f"{base.rstrip('/')}/graphloom-{app}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet and read back: cuts the plan and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables written by :func:`keep` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
