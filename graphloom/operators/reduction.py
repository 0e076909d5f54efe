"""Reduction of the data-flow graph before it is saved: keep what reaches a return, drop loops, contract chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph

FLOW, BACK = "flow", "cons_back"
FIXED = ("fpar", "fret")


def reached_back(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node)`` from which flow edges lead to a ``fret`` node, these included; ``nodes (node, class, kind)``."""
    ends = nodes.where("kind = 'fret'").select("node")
    flow = graph.backward(edges.where(F.col("tag") == FLOW))
    found = graph.closure(ends.select(F.lit(0).alias("origin"), "node"), graph.step_over(flow))
    return found.select("node").union(ends).distinct()


def keep_nodes(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Reached expressions, all parameters and returns, and everything that is no expression; expressions get the role
    ``dflow``."""
    mark = reached.select("node").distinct().withColumn("_reached", F.lit(True))
    some = nodes.join(mark, "node", "left").where((F.col("class") != "expr") | F.col("kind").isin(*FIXED) | F.col("_reached"))
    return some.drop("_reached").withColumn("role", F.when(F.col("class") == "expr", F.lit("dflow")))


def keep_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.induced(edges, nodes)


def add_back_links(edges: DataFrame) -> DataFrame:
    """With a ``cons_back`` link against each ``cons`` link."""
    return edges.unionByName(edges.where("tag = 'cons'").select(F.col("dst").alias("src"), F.lit(BACK).alias("tag"), F.col("src").alias("dst")))


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where(f"NOT (tag = '{FLOW}' AND src = dst)")


def reduce(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All steps: ``nodes (node, class, kind)``, ``edges (src, tag, dst)``."""
    edges = add_back_links(edges).distinct()
    kept = keep_nodes(nodes, reached_back(nodes, edges))
    left = drop_loops(keep_links(edges, kept))
    return graph.contract(kept, left, FLOW, FIXED, BACK)
