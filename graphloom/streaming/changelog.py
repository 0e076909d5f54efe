"""Change notifications of files: ``change_log (seq, file, event, arg)``, events added, dropped, error, present, content, rename."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "seq long, file string, event string, arg string"


def latest(log: DataFrame) -> DataFrame:
    """``(file, event, arg, seq)``: the last event of each file."""
    return log.groupBy("file").agg(F.max_by(F.struct("event", "arg"), "seq").alias("e"), F.max("seq").alias("seq")).select("file", "e.event", "e.arg", "seq")


def present(log: DataFrame) -> DataFrame:
    """Files that haven't been dropped, by their last name."""
    now = latest(log)
    return now.where("event <> 'dropped'").select(F.when(F.col("event") == "rename", F.col("arg")).otherwise(F.col("file")).alias("file"), F.col("event") == "error")


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def follow(stream: DataFrame, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the latest state of each file in a table in memory; ``once`` ends when what is there has been read."""
    writer = latest(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest state in Parquet, a new version for each batch; a replayed batch writes its version again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.select("seq", "file", "event", "arg")
        if number:
            own = own.unionByName(spark.read.parquet(f"{target}/v{number - 1}").select("seq", "file", "event", "arg"))
        latest(own).write.mode("overwrite").parquet(f"{target}/v{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# The events that browsers are told of.
TOLD = ("added", "dropped", "error", "content", "rename")


def notices(log: DataFrame, events: tuple[str, ...] = TOLD) -> DataFrame:
    """``(seq, file, event, arg)`` of the events after which a browser loads a file again; works on a stream too."""
    return log.where(F.col("event").isin(*events)).select("seq", "file", "event", "arg")


def throttled(progress: DataFrame, seconds: int = 3) -> DataFrame:
    """One message of each operation for each stretch of seconds, the last: ``progress (op, file, done, total, ts)``."""
    return progress.groupBy("op", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.max_by(F.struct("file", "done", "total"), F.struct("ts", "done")).alias("m")).select("op", F.col("w.start").alias("ts"), "m.*")
