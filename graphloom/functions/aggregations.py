"""The seven aggregations over rows ``(ord, name, value, found)``; ``found`` is false where a node is missing.

Each returns a DataFrame of its own shape.  Only rows with a value count, except as said; empty input raises where the
result would be undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("tolist", "max", "min", "sum", "avg", "fmaxname", "maxlist")


def _some(value: Column, what: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{what} of nothing")).cast("double"))


def tolist(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ord")


def max_(rows: DataFrame, strict: bool = True) -> DataFrame:
    top = rows.agg(F.max("value").alias("value"))
    return top.select(_some(F.col("value"), "max").alias("value")) if strict else top


def min_(rows: DataFrame, strict: bool = True) -> DataFrame:
    low = rows.agg(F.min("value").alias("value"))
    return low.select(_some(F.col("value"), "min").alias("value")) if strict else low


def sum_(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))


def avg(rows: DataFrame, mode: str = "compatible") -> DataFrame:
    """The mean of the values that aren't 0.  Compatible: rows without a value count in the divisor and zeros don't;
    documented: all rows with a value count."""
    divisor = F.count_if(~F.col("found") | (F.col("value") != 0)) if mode == "compatible" else F.count("value")
    return rows.agg(F.sum("value").alias("s"), divisor.alias("n")).select(F.when(F.col("n") > 0, F.coalesce("s", F.lit(0)) / F.col("n")).otherwise(F.raise_error(F.lit("avg of nothing")).cast("double")).alias("value"))


def fmaxname(rows: DataFrame) -> DataFrame:
    """The first row of the largest value."""
    return rows.where("value IS NOT NULL").agg(F.max_by(F.struct("name", "value"), F.struct("value", (-F.col("ord")).alias("o"))).alias("r")).select("r.name", "r.value")


def maxlist(rows: DataFrame) -> DataFrame:
    """All rows of the largest value, in order."""
    top = rows.agg(F.max("value").alias("_top"))
    return rows.join(F.broadcast(top), F.col("value") == F.col("_top")).drop("_top").orderBy("ord")


def apply(name: str, rows: DataFrame) -> DataFrame:
    known = {"tolist": tolist, "max": max_, "min": min_, "sum": sum_, "avg": avg, "fmaxname": fmaxname, "maxlist": maxlist}
    if name not in known:
        raise KeyError(f"unknown aggregation {name}")
    return known[name](rows)


def ranked(rows: DataFrame, by: str, within: str) -> DataFrame:
    """``rows`` with their rank by a column inside groups."""
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(within).orderBy(F.desc(by))))
