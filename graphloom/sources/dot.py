"""Graphs in the DOT language.  Lines are rows ``(ord, line)``, so a drawing of any size is written without a driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The views of a whole graph and the kinds of edges that they show.
VIEWS = {1: ("sem", "struct", "syn", "lex"), 2: ("sem", "struct", "syn"), 3: ("struct", "syn"), 4: ("syn",), 5: ("syn", "lex"), 6: ("lex",), 7: ("token",), 8: ("sem", "struct", "syn", "other")}


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(x.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))


def drawing(vertices: DataFrame, edges: DataFrame, name: str = "G") -> DataFrame:
    """``vertices (node, label, style)`` and ``edges (src, dst, color)``: red edges come first."""
    spark = vertices.sparkSession
    head = spark.createDataFrame([(0, "", f"digraph {name} {{"), (9, "", "}")], "part int, key string, line string")
    style = F.when(F.col("style").isNotNull() & (F.col("style") != ""), F.concat(F.lit(", "), "style")).otherwise("")
    points = vertices.select(F.lit(1), F.col("node").cast("string"), F.concat(_quoted(F.col("node")), F.lit(" [label="), _quoted(F.col("label")), style, F.lit("];")))
    lines = edges.select(F.when(F.col("color") == "red", 2).otherwise(3), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")), F.concat(_quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(" [color="), "color", F.lit("];")))
    return head.union(points).union(lines).orderBy("part", "key")


def modules(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices (node, name)``, ``edges (src, dst, cyclic)``: cycles in red."""
    return drawing(vertices.select("node", F.col("name").alias("label"), F.lit("").alias("style")), edges.select("src", "dst", F.when(F.col("cyclic"), "red").otherwise("black").alias("color")))


def blocks(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices (node)`` are paths; edges are magenta unless they touch Other."""
    from graphloom.functions.text import basename

    points = vertices.select("node", basename(F.col("node")).alias("label"), F.concat(F.lit("tooltip="), _quoted(F.col("node"))).alias("style"))
    other = (F.col("src") == "Other") | (F.col("dst") == "Other")
    return drawing(points, edges.select("src", "dst", F.when(other, "black").otherwise("magenta").alias("color")))


def automaton(states: DataFrame, moves: DataFrame) -> DataFrame:
    """``states (state, start, stop)``, ``moves (src, dst)``: start states green, stop states with a double circle."""
    style = F.concat_ws(", ", F.when(F.col("start"), "color=green"), F.when(F.col("stop"), "shape=doublecircle"))
    return drawing(states.select(F.col("state").alias("node"), F.col("state").alias("label"), style.alias("style")), moves.select("src", "dst", F.lit("black").alias("color")))


def view(edges: DataFrame, number: int) -> DataFrame:
    """The edges ``(src, dst, kind)`` of a numbered view."""
    return edges.where(F.col("kind").isin(*VIEWS[number]))


def write(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("part", "key").select("line").write.text(path)
