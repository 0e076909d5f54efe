"""Dependencies between groups of functions (modules, or blocks of modules), their cycles and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import dirname
from graphloom.operators import graph
from graphloom.sources.shared import keep

MISSING = "mod_not_found"


def lifted(calls: DataFrame, owner: DataFrame, placeholder: str | int | None = MISSING) -> DataFrame:
    """``(src, dst)``: distinct owners of which a member calls a member of the other; ``owner (member, owner)``.  Calls to
    members without an owner go to the placeholder."""
    a = owner.select(F.col("member").alias("caller"), F.col("owner").alias("src"))
    b = owner.select(F.col("member").alias("callee"), F.col("owner").alias("dst"))
    met = calls.select("caller", "callee").join(a, "caller").join(b, "callee", "left")
    dst = F.coalesce("dst", F.lit(placeholder)) if placeholder is not None else F.col("dst")
    return met.select("src", dst.alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    """Whatever calls or is called."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def check_cycle(edges: DataFrame) -> list[list] | None:
    """The listed cycles, None if there is none."""
    return graph.greedy_cycles(edges) or None


def named_cycles(edges: DataFrame, names: DataFrame) -> list[list[str]]:
    """Cycles as names; ``names (node, name)``."""
    cycles = graph.greedy_cycles(edges)
    wanted = sorted({n for c in cycles for n in c})
    known = {r["node"]: r["name"] for r in names.where(F.col("node").isin(wanted)).toLocalIterator()} if wanted else {}
    return [[known.get(n, str(n)) for n in c] for c in cycles]


def check_module(edges: DataFrame, start) -> bool:
    """Does what ``start`` reaches, itself included, contain a cycle?"""
    below = subgraph(edges, start)
    return not graph.on_cycles(below).isEmpty()


def subgraph(edges: DataFrame, start) -> DataFrame:
    """The edges among what a vertex reaches, itself included."""
    one = edges.sparkSession.createDataFrame([(start,)], f"node {edges.schema['src'].dataType.simpleString()}")
    rows = one.select(F.col("node").alias("origin"), "node")
    return graph.induced(edges, keep(graph.closure(rows, graph.step_over(edges)).select("node").union(one).distinct(), "below"))


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges with a flag for those inside cycles (both ends mutually reachable)."""
    back = graph.within(edges, graph.strong_components(edges)).select("src", "dst", F.lit(True).alias("cyclic"))
    return edges.join(back, ["src", "dst"], "left").select(*edges.columns, F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def blocks(files: DataFrame, chosen: list | None = None) -> DataFrame:
    """``(mod_id, block)``: modules by directory; ``files (mod_id, path)``.  ``chosen`` keeps some: paths, or ``(base, [names])``."""
    rows = files.select("mod_id", dirname(F.col("path")).alias("block"))
    if chosen is None:
        return rows
    paths = [p for c in chosen for p in ([f"{c[0]}/{n}" for n in c[1]] if isinstance(c, tuple) else [str(c)])]
    return rows.where(F.col("block").isin(paths))


def block_edges(calls: DataFrame, functions: DataFrame, by_module: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """Block to block, without loops; from chosen blocks only, to any block."""
    owner = functions.join(by_module, "mod_id", "left").select(F.col("fun_id").alias("member"), F.coalesce("block", F.lit("Other")).alias("owner"))
    out = lifted(calls, owner, None)
    return out if chosen is None else out.where(F.col("src").isin(chosen))


def relations(edges: DataFrame) -> DataFrame:
    """``(component, members)`` of weakly connected groups of two or more, members in order."""
    found = graph.components(edges)
    return found.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members")).where(F.size("members") > 1)


def is_relation(edges: DataFrame, pair) -> bool:
    """Whether two blocks are together a whole component."""
    if not isinstance(pair, (tuple, list)) or len(pair) != 2:
        raise ValueError("a pair of blocks is needed")
    return not relations(edges).where(F.col("members") == F.array(*(F.lit(p) for p in sorted(pair)))).isEmpty()


def numbered(nodes: DataFrame, column: str = "node") -> DataFrame:
    """Vertices with sequence numbers from 1, for output."""
    return nodes.withColumn("seq", F.row_number().over(Window.orderBy(column)))
