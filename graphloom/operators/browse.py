"""Hierarchical browsing and facts about entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What can be done with an entity of each class.
ACTIONS = {
    "module": ("rename_mod",), "macro": ("rename_mac", "move_mac"), "record": ("rename_rec", "move_rec"), "field": ("rename_recfield",), "variable": ("rename_var", "elim_var"),
    "func": ("rename_fun", "move_fun", "reorder_funpar", "tuple_funpar"), "expr": ("expand_funexpr", "inline_fun", "extract_fun"), "form": (), "clause": (), "file": (),
}


def children(parents: DataFrame, sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(parent, section, ord, child)``: for each section in order, its ``(parent, ord, child)`` rows."""
    out = None
    for i, (name, rows) in enumerate(sections):
        some = rows.select("parent", F.lit(i).alias("section_ord"), F.lit(name).alias("section"), "ord", "child")
        out = some if out is None else out.unionByName(some)
    return out.join(parents.select("parent").distinct(), "parent", "left_semi").select("parent", "section_ord", "section", "ord", "child")


def listed(rows: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """``(key, list)``: the values of each key joined by a comma and a space, in order."""
    item = F.struct(F.col(order or value).alias("o"), F.col(value).cast("string").alias("v"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]), ", ").alias("list"))


def module_info(modules: DataFrame, functions: DataFrame) -> DataFrame:
    """``(mod_id, name, locals, exported, members)``."""
    name = F.concat_ws("/", "name", F.col("arity").cast("string"))
    item = F.array_join(F.array_sort(F.collect_list(name)), ", ")
    f = functions.where("mod_id IS NOT NULL").groupBy("mod_id").agg(F.count(F.lit(1)).alias("locals"), F.count_if("exported").alias("exported"), item.alias("members"))
    return modules.select("mod_id", "name").join(f, "mod_id", "left").select("mod_id", "name", F.coalesce("locals", F.lit(0)).alias("locals"), F.coalesce("exported", F.lit(0)).alias("exported"), F.coalesce("members", F.lit("")).alias("members"))


def find_node(history: DataFrame, nodes: DataFrame) -> DataFrame:
    """The longest prefix of each path ``(path_id, ord, node)`` whose nodes all still exist in ``nodes (node)``."""
    seen = history.join(nodes.select("node").distinct().withColumn("valid", F.lit(1)), "node", "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    run = F.min("valid").over(Window.partitionBy("path_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("run", run).where("run = 1").select("path_id", "ord", "node")


def actions(entities: DataFrame) -> DataFrame:
    """``(node, action)`` for ``entities (node, class)``."""
    rows = [(c, i, a) for c, names in ACTIONS.items() for i, a in enumerate(names)]
    return entities.join(F.broadcast(entities.sparkSession.createDataFrame(rows, "class string, ord int, action string")), "class").select("node", "class", "ord", "action")
