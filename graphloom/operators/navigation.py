"""Navigation over the generic tables ``nodes (node_id, class, props)`` and ``edges (src, tag, dst, ord)``.

A path is a function from ``(origin, node)`` to ``(origin, node)``; paths compose with :func:`seq` and :func:`any_of`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph

Path = Callable[[DataFrame], DataFrame]


def starts(nodes: DataFrame, key: str = "node_id") -> DataFrame:
    return nodes.select(F.col(key).alias("origin"), F.col(key).alias("node")).distinct()


def run(starting: DataFrame, path: Path) -> DataFrame:
    """``(origin, node)`` where a path leads, as a set."""
    return path(starting).distinct()


def exactly_one(starting: DataFrame, path: Path, error: str | None = None, default: Column | None = None) -> DataFrame:
    """One node for each origin; none or several raise ``error``, or give ``default``."""
    got = run(starting, path).groupBy("origin").agg(F.count("node").alias("n"), F.min("node").alias("node"))
    rows = starting.select("origin").distinct().join(got, "origin", "left")
    other = default if default is not None else F.raise_error(F.lit(error or "not exactly one node")).cast("long") if error is not None else F.lit(None).cast("long")
    return rows.select("origin", F.when(F.col("n") == 1, F.col("node")).otherwise(other).alias("node"))


def seq(*paths: Path) -> Path:
    def go(rows: DataFrame) -> DataFrame:
        for p in paths:
            rows = p(rows)
        return rows

    return go


def any_of(*paths: Path) -> Path:
    def go(rows: DataFrame) -> DataFrame:
        out = paths[0](rows)
        for p in paths[1:]:
            out = out.union(p(rows))
        return out.distinct()

    return go


def edge(edges: DataFrame, tag: str, nth: int | None = None, back: bool = False, where: Column | None = None, nodes: DataFrame | None = None) -> Path:
    """Follow edges of a tag, backward with ``back``, only the ``nth`` of an ordered edge, only to ``nodes`` that meet ``where``."""
    some = edges.where(F.col("tag") == tag)
    if nth is not None:
        some = some.where(F.col("ord") == nth)
    some = graph.backward(some) if back else some
    if where is not None:
        some = some.join(nodes.where(where).select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return graph.step_over(some)


def step(pairs: DataFrame, src: str, dst: str) -> Path:
    """Follow the pairs of any table."""
    return graph.step_over(pairs.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL"))


def descend(path: Path, with_self: bool = False) -> Path:
    """Everything below, by one step or more."""

    def go(rows: DataFrame) -> DataFrame:
        below = graph.closure(rows, path)
        return below.union(rows.select("origin", "node")).distinct() if with_self else below

    return go


def view(edges: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """The edges of a view of the graph."""
    return edges.where(F.col("tag").isin(*tags))


def walk(edges: DataFrame, tags: tuple[str, ...], from_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes that a view reaches from ``from_nodes (node)``, these included, and the edges among them."""
    seen = view(edges, tags)
    rows = from_nodes.select(F.col("node").alias("origin"), "node")
    found = graph.closure(rows.select(F.lit(0).alias("origin"), "node"), graph.step_over(seen)).select("node").union(rows.select("node")).distinct()
    return found, graph.induced(seen, found)


def text_of(tokens: DataFrame, key: str = "file_id") -> DataFrame:
    """The text of each key from its tokens ``(key, start, text)``."""
    return tokens.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))


def create(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with ``new (class, props)`` rows, whose ids follow the largest one."""
    from pyspark.sql import Window

    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("top"))
    numbered = new.withColumn("n", F.row_number().over(Window.orderBy("class", F.to_json("props")))).crossJoin(F.broadcast(top))  # one row
    return nodes.unionByName(numbered.select((F.col("top") + F.col("n")).alias("node_id"), "class", "props"))


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new.select(*edges.columns)).distinct()
