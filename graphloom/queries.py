"""Queries over the star-schema tables, one or more for each operator, and the same in SQL for DuckDB."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.binding import CALLS, EXPR, Star
from graphloom.functions import aggregations, text, typing
from graphloom.operators import automaton, browse, cluster, dependencies, graph, navigation, reduction, transform
from graphloom.plans import metric_language, semantic
from graphloom.sources import dot, dump, files
from graphloom.sources.shared import keep, new_path
from graphloom.streaming import changelog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Star], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def ask(name: str, text_: str, sql: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A query in the semantic language."""
    query(name, sql)(lambda s: (shape or (lambda d: d))(semantic.Compiler(s.catalog()).run(text_)))


def metric(name: str, of: Callable[[Star], DataFrame], sql: str) -> None:
    query(name, sql)(lambda s: of(s).select("node", F.col("value").cast("long").alias("value")))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 2))


C45, C48, C50, ALL_CALLS = (CALLS.format(q=q) for q in (45, 48, 50, 0))
REACH45 = f"WITH RECURSIVE g AS ({C45}), r(a, b) AS (SELECT caller, callee FROM g UNION SELECT r.a, g.callee FROM r JOIN g ON r.b = g.caller)"
REACH48 = REACH45.replace(C45, C48)

# -- the semantic language -------------------------------------------------------------------------------------
ask("q01_initial_selection", "nations", "SELECT n_nationkey AS node FROM nation")
ask("q02_relative_query", "nations[.suppliers].suppliers", "SELECT s_suppkey AS node FROM supplier")
ask("q03_chain", "regions.nations.suppliers.calls45", f"SELECT DISTINCT callee AS node FROM ({C45})")
ask("q04_selection_filter", "nations[key == 3].suppliers[acctbal > 100]", "SELECT s_suppkey AS node FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 100")
ask("q05_iteration_2", "suppliers[key < 20].{calls45}2", f"WITH g AS ({C45}) SELECT DISTINCT y.callee AS node FROM g x JOIN g y ON x.callee = y.caller WHERE x.caller < 20")
ask("q05_iteration_3", "suppliers[key < 20].{calls45}3", f"WITH g AS ({C45}) SELECT DISTINCT z.callee AS node FROM g x JOIN g y ON x.callee = y.caller JOIN g z ON y.callee = z.caller WHERE x.caller < 20")
ask("q06_bounded_closure", "suppliers[key < 5].(calls48)3", f"WITH g AS ({C48}) SELECT callee AS node FROM g WHERE caller < 5 UNION SELECT y.callee FROM g x JOIN g y ON x.callee = y.caller WHERE x.caller < 5 UNION SELECT z.callee FROM g x JOIN g y ON x.callee = y.caller JOIN g z ON y.callee = z.caller WHERE x.caller < 5")
ask("q07_closure", "suppliers[key < 10].(calls48)+", f"{REACH48} SELECT DISTINCT b AS node FROM r WHERE a < 10")
for stat, expr in (("sum", "round(sum(s_acctbal), 2)"), ("max", "max(s_acctbal)"), ("min", "min(s_acctbal)"), ("avg", "round(avg(s_acctbal), 2)")):
    ask(f"q08_stat_{stat}", f"nations[key < 9].suppliers[acctbal > 100].acctbal:{stat}", f"SELECT {expr} AS value FROM supplier WHERE s_nationkey < 9 AND s_acctbal > 100", rounded)
ask("q08_stat_maxlist", "suppliers.nationkey:maxlist", "SELECT s_suppkey AS node, s_nationkey AS value FROM supplier WHERE s_nationkey = (SELECT max(s_nationkey) FROM supplier)", lambda d: d.select(F.col("ord").alias("node"), "value"))
ask("q08_stat_fmaxname", "suppliers.acctbal:fmaxname", "SELECT CAST(arg_max(s_suppkey, s_acctbal) AS VARCHAR) AS name, max(s_acctbal) AS value FROM supplier")
ask("q08_stat_tolist", "nations.key:tolist", "SELECT n_nationkey AS node, n_nationkey AS value FROM nation", lambda d: d.select(F.col("ord").alias("node"), "value"))
ask("q09_or", "suppliers[acctbal < 0 or key < 10; key == 50]", "SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0 OR s_suppkey < 10 OR s_suppkey = 50")
ask("q10_and", "customers[acctbal > 5000 and key < 700, segment == \"BUILDING\"]", "SELECT c_custkey AS node FROM customer WHERE c_acctbal > 5000 AND c_custkey < 700 AND c_mktsegment = 'BUILDING'")
ask("q11_comparison", "suppliers[key >= 5 and key =< 40 and key /= 7 and nationkey < 9 or nationkey =:= 3 or acctbal =/= acctbal]", "SELECT s_suppkey AS node FROM supplier WHERE s_suppkey >= 5 AND s_suppkey <= 40 AND s_suppkey <> 7 AND s_nationkey < 9 OR s_nationkey = 3")
ask("q11_mixed_kinds", "nations[name > 5 and key < name]", "SELECT n_nationkey AS node FROM nation")
ask("q12_like", "nations[name like \"_1|2$\"]", "SELECT n_nationkey AS node FROM nation WHERE regexp_matches(n_name, '_1|2$')")
ask("q13_not", "suppliers[not (key > 60) and not .calls48]", f"SELECT s_suppkey AS node FROM supplier WHERE NOT s_suppkey > 60 AND s_suppkey NOT IN (SELECT caller FROM ({C48}))")
ask("q14_parentheses", "suppliers[(key < 5 or key > 90) and (nationkey < 12)]", "SELECT s_suppkey AS node FROM supplier WHERE (s_suppkey < 5 OR s_suppkey > 90) AND s_nationkey < 12")
ask("q15_in_subquery", "suppliers[nationkey in .calls45.nationkey]", f"SELECT DISTINCT a.s_suppkey AS node FROM supplier a JOIN ({C45}) g ON g.caller = a.s_suppkey JOIN supplier b ON b.s_suppkey = g.callee WHERE a.s_nationkey = b.s_nationkey")
ask("q16_exists_subquery", "nations[.suppliers[acctbal > 9000]]", "SELECT DISTINCT s_nationkey AS node FROM supplier WHERE s_acctbal > 9000")
ask("q16_aggregate_subquery", "nations[.suppliers.acctbal:sum > 20000]", "SELECT s_nationkey AS node FROM supplier GROUP BY 1 HAVING sum(s_acctbal) > 20000")
ask("q17_literals", "orders[status == 'o' or status == \"P\"]", "SELECT o_orderkey AS node FROM orders WHERE o_orderstatus = 'P' OR o_orderstatus = 'o'")
ask("q18_metric_property", "nations[number_of_fun > 4].number_of_fun", "SELECT s_nationkey AS node, count(*) AS value FROM supplier GROUP BY 1 HAVING count(*) > 4")
ask("q_fun_refs", "@fun.refs", f"SELECT DISTINCT caller AS node FROM ({C45}) WHERE callee = 3")

# -- navigation ------------------------------------------------------------------------------------------------
SUPP = "(SELECT s_suppkey, s_nationkey, s_name, s_acctbal FROM supplier)"


def generic(s: Star) -> tuple[DataFrame, DataFrame]:
    """All classes as one graph: regions from 0, nations from 100, suppliers from 1000."""
    none = F.create_map().cast("map<string,string>")
    n, u = s.t("nation"), s.t("supplier")
    nodes = s.t("region").select(F.col("r_regionkey").cast("long").alias("node_id"), F.lit("region").alias("class"), none.alias("props"))
    nodes = nodes.union(n.select(F.col("n_nationkey").cast("long") + 100, F.lit("nation"), F.create_map(F.lit("name"), "n_name"))).union(u.select(F.col("s_suppkey") + 1000, F.lit("supplier"), F.create_map(F.lit("name"), "s_name")))
    edges = n.select(F.col("n_regionkey").cast("long").alias("src"), F.lit("nation").alias("tag"), (F.col("n_nationkey").cast("long") + 100).alias("dst"))
    edges = edges.union(u.select(F.col("s_nationkey").cast("long") + 100, F.lit("supplier"), F.col("s_suppkey") + 1000)).union(s.calls(45).select(F.col("caller") + 1000, F.lit("calls"), F.col("callee") + 1000))
    from pyspark.sql import Window

    return nodes, edges.withColumn("ord", F.row_number().over(Window.partitionBy("src", "tag").orderBy("dst")))


def nav(name: str, path: Callable[[DataFrame, DataFrame], navigation.Path], start: str, sql: str) -> None:
    def go(s: Star) -> DataFrame:
        nodes, edges = generic(s)
        return navigation.run(navigation.starts(nodes.where(start)), path(nodes, edges))

    query(name, sql)(go)


query("n01_exec_root", "SELECT n_nationkey + 100 AS node FROM nation")(lambda s: generic(s)[0].where("class = 'nation'").select(F.col("node_id").alias("node")))
nav("n02_exec_nodes", lambda n, e: navigation.edge(e, "supplier"), "class = 'nation'", "SELECT s_nationkey + 100 AS origin, s_suppkey + 1000 AS node FROM supplier")
query("n03_exec1", "SELECT s_suppkey + 1000 AS origin, s_nationkey + 100 AS node FROM supplier")(lambda s: (lambda n, e: navigation.exactly_one(navigation.starts(n.where("class = 'supplier'")), navigation.edge(e, "supplier", back=True), "no nation"))(*generic(s)))
nav("n04_seq", lambda n, e: navigation.seq(navigation.edge(e, "nation"), navigation.edge(e, "supplier")), "class = 'region'", "SELECT n_regionkey AS origin, s_suppkey + 1000 AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey")
nav("n05_any", lambda n, e: navigation.any_of(navigation.edge(e, "calls"), navigation.edge(e, "supplier", back=True)), "class = 'supplier'", f"SELECT caller + 1000 AS origin, callee + 1000 AS node FROM ({C45}) UNION SELECT s_suppkey + 1000, s_nationkey + 100 FROM supplier")
nav("n06_edge_step", lambda n, e: navigation.edge(e, "calls"), "class = 'supplier'", f"SELECT caller + 1000 AS origin, callee + 1000 AS node FROM ({C45})")
nav("n07_edge_back", lambda n, e: navigation.edge(e, "calls", back=True), "class = 'supplier'", f"SELECT callee + 1000 AS origin, caller + 1000 AS node FROM ({C45})")
nav("n08_edge_nth", lambda n, e: navigation.edge(e, "supplier", nth=2), "class = 'nation'", "SELECT s_nationkey + 100 AS origin, s_suppkey + 1000 AS node FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) WHERE k = 2")
nav("n09_edge_filter", lambda n, e: navigation.edge(e, "nation", where=F.col("props")["name"].like("%1%"), nodes=n), "class = 'region'", "SELECT n_regionkey AS origin, n_nationkey + 100 AS node FROM nation WHERE n_name LIKE '%1%'")
query("n10_mod_all", "SELECT n_nationkey AS mod_id, n_name AS name FROM nation")(lambda s: s.modules().select("mod_id", "name"))
query("n11_mod_find", "SELECT n_nationkey AS mod_id FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")(lambda s: s.modules().join(s.modules().agg(F.min("name").alias("name")), "name").select("mod_id"))
query("n12_mod_locals", "SELECT s_nationkey AS mod_id, s_suppkey AS fun_id FROM supplier")(lambda s: s.modules().select("mod_id").join(s.suppliers(), "mod_id").select("mod_id", "fun_id"))
query("n13_mod_local", "SELECT s_suppkey AS fun_id FROM supplier WHERE s_nationkey < 9 AND s_suppkey % 4 = 1")(lambda s: s.suppliers().where("mod_id < 9 AND arity = 1").select("fun_id"))
query("n14_mod_file_name", "SELECT n_name AS name, '/' || r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda s: s.modules().select("name", "path"))
query("n15_mod_exports", "SELECT s_suppkey AS fun_id FROM supplier WHERE s_acctbal > 0")(lambda s: s.suppliers().where("exported").select("fun_id"))
def children(s: Star) -> DataFrame:
    """Files' forms, by navigation: customers hold their orders."""
    edges = s.t("orders").select(F.col("o_custkey").alias("src"), F.lit("form").alias("tag"), F.col("o_orderkey").alias("dst"), F.lit(0).alias("ord"))
    found = navigation.run(navigation.starts(s.t("customer"), "c_custkey"), navigation.edge(edges, "form"))
    return found.groupBy(F.col("origin").alias("file_id")).agg(F.count("node").alias("forms"), F.min("node").alias("first"))


query("n16_file_children", "SELECT o_custkey AS file_id, count(*) AS forms, min(o_orderkey) AS first FROM orders GROUP BY 1")(children)
query("n17_form_clauses", "SELECT o_orderkey AS form_id, o_custkey AS fun_id FROM orders")(lambda s: s.tree_metrics().code.clause.where("owner_kind = 'function'").select(F.col("clause_id").alias("form_id"), F.col("owner_id").alias("fun_id")))
query("n18_clause_exprs", f"WITH e AS ({EXPR}) SELECT x.o AS clause_id, x.expr_id FROM e x LEFT JOIN e y ON x.o = y.o AND y.n = x.n - 3 WHERE y.expr_id IS NULL")(lambda s: s.tree_metrics().code.expr.where("parent_id IS NULL").select("clause_id", "expr_id"))
query("n19_expr_children", f"WITH e AS ({EXPR}) SELECT y.expr_id AS parent_id, x.expr_id FROM e x JOIN e y ON x.o = y.o AND y.n = x.n - 3")(lambda s: s.tree_metrics().code.expr.where("parent_id IS NOT NULL").select("parent_id", "expr_id"))
query("n20_expr_sub", f"WITH e AS ({EXPR}) SELECT y.expr_id AS origin, x.expr_id AS node FROM e x JOIN e y ON x.o = y.o AND y.n = x.n - 3 UNION SELECT y.expr_id, x.expr_id FROM e x JOIN e z ON x.o = z.o AND z.n = x.n - 3 JOIN e y ON y.o = z.o AND y.n = z.n - 3")(lambda s: (lambda m: graph.closure(m.code.expr.select(F.col("expr_id").alias("origin"), F.col("expr_id").alias("node")), graph.step_over(m._parents())))(s.tree_metrics()))
query("n21_top_deep_sub", f"WITH e AS ({EXPR}), t AS (SELECT x.* FROM e x LEFT JOIN e y ON x.o = y.o AND y.n = x.n - 3 WHERE y.expr_id IS NULL) SELECT expr_id AS top, expr_id FROM t UNION ALL SELECT t.expr_id, x.expr_id FROM t JOIN e x ON x.o = t.o AND x.n = t.n + 3 UNION ALL SELECT t.expr_id, x.expr_id FROM t JOIN e z ON z.o = t.o AND z.n = t.n + 3 JOIN e x ON x.o = z.o AND x.n = z.n + 3")(lambda s: s.tree_metrics()._within())
query("n22_expr_clauses", f"SELECT expr_id, branches AS n FROM ({EXPR}) WHERE kind <> 'application'")(lambda s: s.tree_metrics()._branches())
query("n23_function_of_application", "SELECT a.l_suppkey AS caller, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 45 AND b.l_quantity >= 45 GROUP BY 1")(lambda s: s.applications(45).groupBy("caller").agg(F.count(F.lit(1)).alias("n")))
query("n24_expr_attributes", f"SELECT kind, count(*) AS n FROM ({EXPR}) GROUP BY 1")(lambda s: s.tree_metrics().code.expr.groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
query("n25_fun_attributes", "SELECT s_suppkey AS fun_id, s_name AS name, CAST(s_suppkey % 4 AS INT) AS arity, s_acctbal > 0 AS exported FROM supplier")(lambda s: s.suppliers().select("fun_id", "name", "arity", "exported"))
query("n26_fun_module", "SELECT s_suppkey AS fun_id, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")(lambda s: s.suppliers().select("fun_id", "mod_id").join(s.modules(), "mod_id").select("fun_id", "name"))
query("n27_funcalls", C45)(lambda s: s.calls(45))
query("n28_called", f"SELECT callee AS fun_id, caller FROM ({C45})")(lambda s: s.calls(45).select(F.col("callee").alias("fun_id"), "caller"))
query("n29_applications", "SELECT a.l_suppkey AS caller, b.l_suppkey AS callee, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 48 AND b.l_quantity >= 48 GROUP BY 1, 2")(lambda s: s.applications(48).groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n")))
def occurrences(s: Star) -> DataFrame:
    """Variables' bindings and references, by navigation: users' sign-ups and other events."""
    e = s.t("events").select(F.col("user_id").alias("src"), F.when(F.col("event_type") == "signup", "binding").otherwise("reference").alias("tag"), F.col("event_id").alias("dst"), F.lit(0).alias("ord"))
    users = navigation.starts(s.t("events"), "user_id")
    count = lambda tag: navigation.run(users, navigation.edge(e, tag)).groupBy("origin").agg(F.count("node").alias(tag))
    found = users.select("origin").join(count("binding"), "origin", "left").join(count("reference"), "origin", "left")
    return found.select(F.col("origin").alias("var_id"), F.coalesce("binding", F.lit(0)).alias("bindings"), F.coalesce("reference", F.lit(0)).alias("refs"))


query("n30_variable_bindings", "SELECT user_id AS var_id, count(*) FILTER (WHERE event_type = 'signup') AS bindings, count(*) FILTER (WHERE event_type <> 'signup') AS refs FROM events GROUP BY 1")(occurrences)
query("n31_tree_text", "SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS text FROM conversations GROUP BY 1")(lambda s: navigation.text_of(s.t("conversations").select("conv_id", F.col("turn").alias("start"), "text"), "conv_id"))
query("n32_class", "SELECT 'region' AS class, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier")(lambda s: generic(s)[0].groupBy("class").agg(F.count(F.lit(1)).alias("n")))
query("n33_walk_graph", "SELECT 0 AS node UNION ALL SELECT n_nationkey + 100 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT s_suppkey + 1000 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0")(lambda s: navigation.walk(generic(s)[1], ("nation", "supplier"), s.spark.range(1).select(F.col("id").alias("node")))[0])
query("n34_dataflow_reach", f"{REACH48} SELECT b AS origin, a AS node FROM r")(lambda s: graph.closure(s.edges(48).select(F.col("dst").alias("origin"), F.col("dst").alias("node")).distinct(), graph.step_over(graph.backward(s.edges(48)))))
query("n35_create_link", "SELECT (SELECT max(s_suppkey) + 1000 FROM supplier) + 1 AS node_id, 'region' AS class")(lambda s: (lambda n: navigation.create(n, s.spark.range(1).select(F.lit("region").alias("class"), F.create_map(F.lit("name"), F.lit("new")).alias("props"))).join(n.select("node_id"), "node_id", "left_anti").select("node_id", "class"))(generic(s)[0]))

# -- metrics ---------------------------------------------------------------------------------------------------
LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"
for scope, short in (("module", "m"), ("function", "f")):
    metric(f"m01_line_of_code_{short}", lambda s, c=scope: s.text_metrics().line_of_code(c), f"SELECT doc_id AS node, CAST(len({LINES}) AS BIGINT) AS value FROM documents")
    metric(f"m27_max_length_of_line_{short}", lambda s, c=scope: s.text_metrics().max_length_of_line(c), f"SELECT doc_id AS node, CAST(list_max(list_transform({LINES}, lambda x: length(x))) AS BIGINT) AS value FROM documents")
    metric(f"m28_average_length_of_line_{short}", lambda s, c=scope: s.text_metrics().average_length_of_line(c), f"SELECT doc_id AS node, CAST(list_sum(list_transform({LINES}, lambda x: length(x))) // len({LINES}) AS BIGINT) AS value FROM documents")
metric("m02_char_of_code_m", lambda s: s.text_metrics().char_of_code("module"), "SELECT doc_id AS node, CAST(length(text) AS BIGINT) AS value FROM documents")
metric("m02_char_of_code_f", lambda s: s.text_metrics().char_of_code("function"), "SELECT doc_id AS node, CAST(length(replace(text, chr(10), '')) AS BIGINT) AS value FROM documents")
metric("m29_no_space_after_comma_m", lambda s: s.text_metrics().no_space_after_comma("module"), "SELECT doc_id AS node, CAST(len(list_filter(list_filter(string_split(text, ','), lambda x: x <> '')[2:], lambda x: x[1] <> chr(10))) AS BIGINT) AS value FROM documents")
metric("m29_no_space_after_comma_f", lambda s: s.text_metrics().no_space_after_comma("function"), "SELECT doc_id AS node, CAST(len(list_filter(list_filter(string_split(translate(text, ';', ','), ','), lambda x: x <> '')[2:], lambda x: x[1] NOT IN (' ', chr(10), chr(9)))) AS BIGINT) AS value FROM documents")


def per_nation(counted: str) -> str:
    """Every nation with a count from ``counted (node, value)``, 0 without one."""
    return f"SELECT n_nationkey AS node, CAST(coalesce(value, 0) AS BIGINT) AS value FROM nation LEFT JOIN ({counted}) c ON c.node = n_nationkey"


SOLD = "SELECT s_nationkey AS f, p_brand, p_type, p_size FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 40"
MOD_CALLS = f"SELECT a.s_nationkey AS m1, b.s_nationkey AS m2, caller, callee FROM ({C45}) JOIN supplier a ON a.s_suppkey = caller LEFT JOIN supplier b ON b.s_suppkey = callee"
metric("m03_number_of_fun", lambda s: s.call_metrics(45).number_of_fun(), per_nation("SELECT s_nationkey AS node, count(*) AS value FROM supplier GROUP BY 1"))
metric("m04_number_of_macros", lambda s: s.part_metrics().number_of_macros(), per_nation(f"SELECT f AS node, count(DISTINCT p_brand) AS value FROM ({SOLD}) GROUP BY 1"))
metric("m05_number_of_records", lambda s: s.part_metrics().number_of_records(), per_nation(f"SELECT f AS node, count(DISTINCT p_type) AS value FROM ({SOLD}) GROUP BY 1"))
metric("m06_included_files", lambda s: s.part_metrics().included_files(), per_nation(f"SELECT f AS node, count(DISTINCT p_size % 25) - max(CASE WHEN p_size % 25 = f THEN 1 ELSE 0 END) AS value FROM ({SOLD}) GROUP BY 1"))
metric("m07_imported_modules", lambda s: s.part_metrics().imported_modules(), per_nation(f"SELECT f AS node, count(DISTINCT p_size) AS value FROM ({SOLD}) GROUP BY 1"))
metric("m08_number_of_funpath", lambda s: s.call_metrics(45).number_of_funpath(), per_nation(f"SELECT m AS node, count(*) AS value FROM (SELECT m1 AS m FROM ({MOD_CALLS}) UNION ALL SELECT m2 FROM ({MOD_CALLS}) WHERE m1 <> m2) GROUP BY 1"))
metric("m09_function_calls_in", lambda s: s.call_metrics(45).function_calls_in(), per_nation(f"SELECT m2 AS node, count(*) AS value FROM ({MOD_CALLS}) WHERE m1 <> m2 GROUP BY 1"))
metric("m10_function_calls_out", lambda s: s.call_metrics(45).function_calls_out(), per_nation(f"SELECT m1 AS node, count(*) AS value FROM ({MOD_CALLS}) WHERE m1 IS DISTINCT FROM m2 GROUP BY 1"))
metric("m11_cohesion", lambda s: s.call_metrics(45).cohesion(), per_nation(f"SELECT m1 AS node, count(*) AS value FROM ({MOD_CALLS}) WHERE m1 = m2 GROUP BY 1"))
metric("m12_otp_used", lambda s: s.call_metrics(45).otp_used(), "SELECT n_nationkey AS node, CAST(0 AS BIGINT) AS value FROM nation")
metric("m13_function_sum", lambda s: s.call_metrics(45).function_sum(), "SELECT s_suppkey AS node, CAST(9 AS BIGINT) AS value FROM supplier")
metric("m26_average_size", lambda s: s.call_metrics(45).average_size(), "SELECT n_nationkey AS node, CAST(0 AS BIGINT) AS value FROM nation")
PATHS = f"WITH RECURSIVE g AS ({C48}), p(a, path) AS (SELECT s_suppkey, [s_suppkey] FROM supplier UNION ALL SELECT p.a, list_append(p.path, g.callee) FROM p JOIN g ON p.path[-1] = g.caller WHERE NOT list_contains(p.path, g.callee)), d AS (SELECT a, CAST(max(len(path)) - 1 AS BIGINT) AS value FROM p GROUP BY 1)"
metric("m15_max_depth_of_calling_f", lambda s: s.call_metrics(48).max_depth_of_calling("function"), f"{PATHS} SELECT a AS node, value FROM d")
metric("m15_max_depth_of_calling_m", lambda s: s.call_metrics(48).max_depth_of_calling("module"), f"{PATHS} SELECT n_nationkey AS node, coalesce(max(value), 0) AS value FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN d ON a = s_suppkey GROUP BY 1")
metric("m16_min_depth_of_calling", lambda s: s.call_metrics(48).min_depth_of_calling(), f"{PATHS} SELECT n_nationkey AS node, coalesce(min(CASE WHEN value > 0 THEN value END), 0) AS value FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN d ON a = s_suppkey GROUP BY 1")
APPS = "SELECT a.l_suppkey AS caller, b.l_suppkey AS callee FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 20 AND b.l_quantity >= 20"
metric("m19_branches_of_recursion", lambda s: s.call_metrics(20).branches_of_recursion("module"), per_nation(f"SELECT s_nationkey AS node, count(*) AS value FROM ({APPS}) JOIN supplier ON s_suppkey = caller WHERE caller = callee GROUP BY 1"))
metric("m21_calls_for_function", lambda s: s.call_metrics(20).calls_for_function(), f"SELECT s_suppkey AS node, count(caller) AS value FROM supplier LEFT JOIN ({APPS}) ON callee = s_suppkey GROUP BY 1")
metric("m22_calls_from_function", lambda s: s.call_metrics(45).calls_from_function(), f"SELECT s_suppkey AS node, count(callee) AS value FROM supplier LEFT JOIN ({C45}) ON caller = s_suppkey GROUP BY 1")
TREE = f"WITH e AS ({EXPR}), t AS (SELECT x.*, o_custkey AS c, y.kind AS k1, z.kind AS k2, y.expr_id IS NULL AS top FROM e x JOIN orders ON o_orderkey = x.o LEFT JOIN e y ON y.o = x.o AND y.n = x.n - 3 LEFT JOIN e z ON z.o = x.o AND z.n = x.n - 6 AND y.expr_id IS NOT NULL)"
PER_CUSTOMER = "SELECT c_custkey AS node, CAST(coalesce(value, 0) AS BIGINT) AS value FROM customer LEFT JOIN ({}) v ON v.c = c_custkey"
metric("m14_max_application_depth", lambda s: s.tree_metrics().max_application_depth("function"), f"{TREE} {PER_CUSTOMER.format("SELECT c, max((kind = 'application')::INT + coalesce((k1 = 'application')::INT, 0) + coalesce((k2 = 'application')::INT, 0)) AS value FROM t GROUP BY 1")}")
metric("m17_max_depth_of_cases", lambda s: s.tree_metrics().max_depth_of_cases("function"), f"{TREE} {PER_CUSTOMER.format("SELECT c, max((kind = 'case_expr')::INT + coalesce((k1 = 'case_expr')::INT, 0) + coalesce((k2 = 'case_expr')::INT, 0)) AS value FROM t GROUP BY 1")}")
metric("m18_number_of_funclauses", lambda s: s.tree_metrics().number_of_funclauses("function"), "SELECT c_custkey AS node, count(o_orderkey) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
metric("m20_mccabe", lambda s: s.tree_metrics().mccabe("function"), f"{TREE}, b AS (SELECT c, sum(CASE kind WHEN 'if_expr' THEN branches - 1 WHEN 'case_expr' THEN branches - 2 ELSE 0 END) AS v FROM t GROUP BY 1), k AS (SELECT o_custkey AS c, count(*) AS v FROM orders GROUP BY 1) SELECT c_custkey AS node, CAST(coalesce(k.v, 0) + coalesce(b.v, 0) AS BIGINT) AS value FROM customer LEFT JOIN k ON k.c = c_custkey LEFT JOIN b ON b.c = c_custkey")
metric("m23_number_of_funexpr", lambda s: s.tree_metrics({"application": "fun_expr"}).number_of_funexpr("function"), f"{TREE} {PER_CUSTOMER.format("SELECT c, count(*) AS value FROM t WHERE kind = 'application' GROUP BY 1")}")
metric("m24_number_of_messpass", lambda s: s.tree_metrics({"if_expr": "send_expr"}).number_of_messpass("module"), f"{TREE} {per_nation("SELECT c_nationkey AS node, count(*) AS value FROM t JOIN customer ON c = c_custkey WHERE kind = 'if_expr' GROUP BY 1")}")
metric("m25_fun_return_points", lambda s: s.tree_metrics().fun_return_points("function"), f"{TREE}, l AS (SELECT o, any_value(c) AS c, arg_max(kind, n) AS kind FROM t WHERE top GROUP BY 1) {PER_CUSTOMER.format("SELECT c, count(*) FILTER (WHERE kind = 'application') AS value FROM l GROUP BY 1")}")
metric("m31_module_sum", lambda s: s.call_metrics(48).module_sum(parts=("number_of_fun", "number_of_funpath", "function_calls_in", "function_calls_out", "cohesion", "otp_used", "average_size")), per_nation(f"SELECT m AS node, count(*) AS value FROM (SELECT s_nationkey AS m FROM supplier UNION ALL (WITH g AS ({MOD_CALLS.replace(C45, C48)}) SELECT unnest([m1, m1]) FROM g UNION ALL SELECT unnest([m2, m2]) FROM g WHERE m1 <> m2)) GROUP BY 1"))
TAIL = """, x AS (
  SELECT c, o, n, kind, CASE WHEN k1 IS NULL THEN n WHEN k2 IS NULL THEN n - 3 ELSE n - 6 END AS root,
    kind = 'case_expr' OR (kind = 'if_expr' AND CASE WHEN c % 2 = 1 THEN c + 1 ELSE c - 1 END IN (SELECT c FROM t WHERE kind = 'if_expr')) AS loops FROM t
), tops AS (SELECT c, o, root, bool_or(loops) AS loops, bool_or(loops AND n = root) AS direct FROM x GROUP BY 1, 2, 3),
ends AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o DESC, root DESC) = 1 AS final FROM tops),
v AS (SELECT c, CASE WHEN bool_or(loops AND NOT (final AND direct)) THEN 0 WHEN bool_or(final AND direct) THEN 1 ELSE -1 END AS value FROM ends GROUP BY 1)
SELECT c_custkey AS node, CAST(coalesce(value, -1) AS BIGINT) AS value FROM customer LEFT JOIN v ON v.c = c_custkey"""
metric("m30_is_tail_recursive", lambda s: s.tree_metrics().is_tail_recursive("function"), TREE + TAIL)


# -- the metric language and its aggregations ------------------------------------------------------------------
def evaluator(s: Star) -> metric_language.Evaluator:
    low = s.modules().select(F.col("mod_id").alias("node"), F.lower("name").alias("name"))
    f = s.suppliers().join(low.select(F.col("node").alias("mod_id"), F.col("name").alias("module")), "mod_id").select(F.col("fun_id").alias("node"), "module", F.regexp_replace(F.lower("name"), "[^a-z0-9_]", "_").alias("name"), "arity")
    return metric_language.Evaluator(s.spark, low, f, s.call_metrics(45).table())


NAMED = "SELECT i AS ord, name, (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE lower(n_name) = name) AS value, EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = name) AS found FROM (SELECT unnest([0, 1, 2, 3]) AS i, unnest({names}) AS name)"


def show(name: str, aggregation: str, sql: str) -> None:
    def go(s: Star) -> DataFrame:
        names = [r["n"] for r in s.t("nation").select(F.lower("n_name").alias("n")).orderBy("n").limit(3).collect()]
        listed = ",".join(f"'{n}'" for n in [*names, "nowhere"])
        return evaluator(s).run(f"show number_of_fun for module ({listed}) {aggregation}")

    query(name, sql)(go)


THREE = "WITH n AS (SELECT lower(n_name) AS name, n_nationkey FROM nation ORDER BY 1 LIMIT 3), v AS (SELECT row_number() OVER (ORDER BY name) - 1 AS ord, name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS value FROM n)"
show("mq01_show_module", "", f"{THREE} SELECT CAST(ord AS INT) AS ord, name, value, true AS found FROM v UNION ALL SELECT 3, 'nowhere', NULL, false")
show("a01_tolist", "tolist", f"{THREE} SELECT CAST(ord AS INT) AS ord, name, value, true AS found FROM v UNION ALL SELECT 3, 'nowhere', NULL, false")
show("a02_max", "max", f"{THREE} SELECT CAST(max(value) AS DOUBLE) AS value FROM v")
show("a03_min", "min", f"{THREE} SELECT CAST(min(value) AS DOUBLE) AS value FROM v")
show("a04_sum", "sum", f"{THREE} SELECT CAST(sum(value) AS BIGINT) AS value FROM v")
show("a05_avg", "avg", f"{THREE} SELECT CAST(sum(value) AS DOUBLE) / (count(*) FILTER (WHERE value <> 0) + 1) AS value FROM v")
show("a06_fmaxname", "fmaxname", f"{THREE} SELECT name, value FROM v ORDER BY value DESC, ord LIMIT 1")
show("a07_maxlist", "maxlist", f"{THREE} SELECT CAST(ord AS INT) AS ord, name, value, true AS found FROM v WHERE value = (SELECT max(value) FROM v)")
query("mq02_show_function", f"SELECT CAST(0 AS INT) AS ord, count(callee) AS value, true AS found FROM supplier LEFT JOIN ({C45}) ON caller = s_suppkey WHERE s_suppkey = 1")(
    lambda s: (lambda e: (lambda r: e.run(f"show calls_from_function for function ({{'{r['module']}','{r['name']}',{r['arity']}}})").select("ord", "value", "found"))(e.functions.where("node = 1").first()))(evaluator(s))
)
query("mq04_show_metrics", "SELECT CAST(count(*) AS BIGINT) AS n FROM range(30)")(lambda s: evaluator(s).run("show metrics").agg(F.count(F.lit(1)).alias("n")))
query("mq04_show_filters", "SELECT unnest(['tolist', 'max', 'min', 'sum', 'avg', 'fmaxname', 'maxlist']) AS name")(lambda s: evaluator(s).run("show filters").select("name"))
query("mq07_render", "SELECT 'number_of_fun of the ''' || lower(n_name) || ''' is ' || (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS line FROM nation WHERE n_nationkey = 0")(lambda s: evaluator(s).render(f"show number_of_fun for module ('{s.t('nation').where('n_nationkey = 0').select(F.lower('n_name').alias('n')).first()['n']}')").select("line"))


def refused(s: Star) -> DataFrame:
    rows = []
    for command in ("compare module ('a')", "show mcCabe for module ()", "show nothing for module ('a')", "show cohesion for function ({'a','f',1})", "show cohesion for module ('a') middle", "show ?"):
        try:
            evaluator(s).run(command)
            rows.append((command, "ok"))
        except metric_language.MetricError as e:
            rows.append((command, e.code))
    return s.spark.createDataFrame(rows, "command string, code string")


query("mq05_mq06_refused", "SELECT unnest(['compare module (''a'')', 'show mcCabe for module ()', 'show nothing for module (''a'')', 'show cohesion for function ({''a'',''f'',1})', 'show cohesion for module (''a'') middle', 'show ?']) AS command, unnest(['bad_command', 'parser', 'unknown_metric', 'wrong_type', 'bad_filter', 'scanner']) AS code")(refused)

# -- dependencies ----------------------------------------------------------------------------------------------
NATION_EDGES = f"SELECT DISTINCT m1 AS src, m2 AS dst FROM ({MOD_CALLS}) WHERE m1 <> m2"


def nation_edges(s: Star, q: int = 45) -> DataFrame:
    return dependencies.lifted(s.calls(q), s.suppliers().select(F.col("fun_id").alias("member"), F.col("mod_id").alias("owner")), None)


def block_edges(s: Star, q: int = 45, chosen: list[str] | None = None) -> DataFrame:
    return dependencies.block_edges(s.calls(q), s.suppliers().select("fun_id", "mod_id"), dependencies.blocks(s.modules()), chosen)


BLOCK_EDGES = f"SELECT DISTINCT '/' || x.r_name AS src, '/' || y.r_name AS dst FROM ({MOD_CALLS}) JOIN nation a ON a.n_nationkey = m1 JOIN region x ON x.r_regionkey = a.n_regionkey JOIN nation b ON b.n_nationkey = m2 JOIN region y ON y.r_regionkey = b.n_regionkey WHERE x.r_name <> y.r_name"
query("d01_module_edges", NATION_EDGES)(nation_edges)
query("d02_graph_vertices", f"SELECT src AS node FROM ({NATION_EDGES}) UNION SELECT dst FROM ({NATION_EDGES})")(lambda s: dependencies.vertices(nation_edges(s)))
query("d03_cycle_vertices", f"{REACH45} SELECT DISTINCT a AS node FROM r WHERE a = b")(lambda s: graph.on_cycles(s.edges(45)))
query("d03_strong_components", f"{REACH45} SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1")(lambda s: graph.strong_components(s.edges(45)))
query("d03_check_cycle")(lambda s: s.spark.createDataFrame([(i, j, int(n)) for i, c in enumerate(graph.greedy_cycles(s.edges(45))) for j, n in enumerate(c)], "cycle int, place int, node long"))
query("d04_print_cycle")(lambda s: s.spark.createDataFrame([(i, " -> ".join(c)) for i, c in enumerate(dependencies.named_cycles(nation_edges(s), s.modules().select(F.col("mod_id").alias("node"), "name")))], "cycle int, names string"))
query("d05_check_module", f"{REACH48} SELECT 1 AS node, EXISTS (SELECT 1 FROM r WHERE a = b AND (a = 1 OR a IN (SELECT b FROM r WHERE a = 1))) AS cyclic")(lambda s: s.spark.createDataFrame([(1, dependencies.check_module(s.edges(48), 1))], "node int, cyclic boolean"))
query("d06_reachable_subgraph", f"{REACH48}, n AS (SELECT b AS x FROM r WHERE a IN (SELECT min(caller) FROM g) UNION SELECT min(caller) FROM g) SELECT caller AS src, callee AS dst FROM g WHERE caller IN (SELECT x FROM n) AND callee IN (SELECT x FROM n)")(lambda s: (lambda e: dependencies.subgraph(e, e.agg(F.min("src")).first()[0]))(s.edges(48)))
query("d07_cycle_edges", f"{REACH45} SELECT caller AS src, callee AS dst, EXISTS (SELECT 1 FROM r WHERE a = callee AND b = caller) AS cyclic FROM g")(lambda s: dependencies.cycle_edges(s.edges(45)))
query("d08_blocks", "SELECT n_nationkey AS mod_id, '/' || r_name AS block FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda s: dependencies.blocks(s.modules()))
query("d09_block_edges", BLOCK_EDGES)(block_edges)
NEAR = "WITH RECURSIVE g AS ({}), u AS (SELECT caller AS a, callee AS b FROM g UNION SELECT callee, caller FROM g), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)".format(C48)
query("d10_components", f"{NEAR} SELECT a AS node, min(b) AS component FROM (SELECT a, b FROM r UNION SELECT a, a FROM u) GROUP BY 1")(lambda s: graph.components(s.edges(48)))
query("d10_relations", f"{NEAR}, c AS (SELECT a AS node, min(b) AS component FROM (SELECT a, b FROM r UNION SELECT a, a FROM u) GROUP BY 1) SELECT component, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM c GROUP BY 1 HAVING count(*) > 1")(lambda s: dependencies.relations(s.edges(48)).select("component", F.array_join(F.col("members").cast("array<string>"), ",").alias("members")))
# The whole graph, all lines of all orders, without thinning.
query("d10_components_all", NEAR.replace(C48, ALL_CALLS) + " SELECT a AS node, min(b) AS component FROM (SELECT a, b FROM r UNION SELECT a, a FROM u) GROUP BY 1")(lambda s: graph.components(s.edges(0)))
query("d03_cycle_vertices_all", REACH45.replace(C45, ALL_CALLS) + " SELECT DISTINCT a AS node FROM r WHERE a = b")(lambda s: graph.on_cycles(s.edges(0)))
query("d09_block_edges_all", BLOCK_EDGES.replace(C45, ALL_CALLS))(lambda s: block_edges(s, 0))
metric("m08_number_of_funpath_all", lambda s: s.call_metrics(0).number_of_funpath(), per_nation(f"SELECT m AS node, count(*) AS value FROM (SELECT m1 AS m FROM ({MOD_CALLS}) UNION ALL SELECT m2 FROM ({MOD_CALLS}) WHERE m1 <> m2) GROUP BY 1".replace(C45, ALL_CALLS)))
metric("m21_calls_for_function_all", lambda s: s.call_metrics(0).calls_for_function(), "SELECT s_suppkey AS node, count(a) AS value FROM supplier LEFT JOIN (SELECT y.l_suppkey AS a FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1) ON a = s_suppkey GROUP BY 1")
query("d11_is_relation", f"{NEAR}, c AS (SELECT a AS node, min(b) AS component FROM (SELECT a, b FROM r UNION SELECT a, a FROM u) GROUP BY 1), p AS (SELECT caller, callee FROM g ORDER BY 1, 2 LIMIT 1) SELECT (SELECT count(*) FROM c WHERE component = (SELECT component FROM c JOIN p ON node = caller)) = 2 AS related")(lambda s: (lambda e: (lambda r: s.spark.createDataFrame([(dependencies.is_relation(e, (r["src"], r["dst"])),)], "related boolean"))(e.orderBy("src", "dst").first()))(s.edges(48)))
def checked(s: Star, edges: DataFrame, cycles: list[list]) -> DataFrame:
    """How many listed steps are no edges, and how many vertices the listed cycles have."""
    kind = edges.schema["src"].dataType.simpleString()
    steps = [(a, b) for c in cycles for a, b in zip(c, c[1:] or c, strict=False)]
    listed = s.spark.createDataFrame(steps, f"src {kind}, dst {kind}")
    broken = listed.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("broken"))
    return broken.crossJoin(F.broadcast(listed.agg(F.count_distinct("src").alias("vertices"))))  # one row each


query("d03_cycles_checked", f"{REACH45} SELECT 0 AS broken, count(DISTINCT a) AS vertices FROM r WHERE a = b")(lambda s: (lambda e: checked(s, e, dependencies.check_cycle(e) or []))(s.edges(45)))
query("d04_cycles_checked", f"WITH RECURSIVE g AS ({NATION_EDGES}), r(a, b) AS (SELECT src, dst FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON r.b = g.src) SELECT 0 AS broken, count(DISTINCT a) AS vertices FROM r WHERE a = b")(lambda s: (lambda e, n: checked(s, dependencies.lifted(e, n, None), dependencies.named_cycles(nation_edges(s), s.modules().select(F.col("mod_id").alias("node"), "name"))))(nation_edges(s).toDF("caller", "callee"), s.modules().select(F.col("mod_id").alias("member"), F.col("name").alias("owner"))))
query("d12_block_cycles", f"WITH RECURSIVE g AS ({BLOCK_EDGES}), r(a, b) AS (SELECT src, dst FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON r.b = g.src) SELECT 0 AS broken, count(DISTINCT a) AS vertices FROM r WHERE a = b")(lambda s: (lambda e: checked(s, e, dependencies.check_cycle(e) or []))(block_edges(s)))
query("d13_block_chosen", f"SELECT * FROM ({BLOCK_EDGES}) WHERE src = (SELECT '/' || min(r_name) FROM region)")(lambda s: block_edges(s, chosen=["/" + s.t("region").agg(F.min("r_name")).first()[0]]))
query("d14_numbered", f"SELECT node, row_number() OVER (ORDER BY node) AS seq FROM (SELECT src AS node FROM ({NATION_EDGES}) UNION SELECT dst FROM ({NATION_EDGES}))")(lambda s: dependencies.numbered(dependencies.vertices(nation_edges(s))))


# -- reduction, automata ---------------------------------------------------------------------------------------
def flow(s: Star) -> tuple[DataFrame, DataFrame]:
    nodes = s.t("supplier").select(F.col("s_suppkey").alias("node"), F.lit("expr").alias("class"), F.when(F.col("s_suppkey") % 10 == 0, "fret").when(F.col("s_suppkey") % 10 == 1, "fpar").otherwise("other").alias("kind"))
    return nodes, s.edges(48).select("src", F.lit("flow").alias("tag"), "dst")


BACKED = f"{REACH48}, k AS (SELECT DISTINCT a AS node FROM r WHERE b % 10 = 0 UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0), n AS (SELECT node FROM k UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 1)"
query("g01_walk_view", f"SELECT caller AS src, callee AS dst FROM ({C48})")(lambda s: navigation.view(flow(s)[1], ("flow",)).select("src", "dst"))
query("g02_reachable_back", f"{BACKED} SELECT node FROM k")(lambda s: reduction.reached_back(*flow(s)))
query("g03_keep_nodes", f"{BACKED} SELECT node, 'dflow' AS role FROM n")(lambda s: (lambda n, e: reduction.keep_nodes(n, reduction.reached_back(n, e)).select("node", "role"))(*flow(s)))
query("g04_keep_links", f"{BACKED} SELECT caller AS src, callee AS dst FROM g WHERE caller IN (SELECT node FROM n) AND callee IN (SELECT node FROM n)")(lambda s: (lambda n, e: reduction.keep_links(e, reduction.keep_nodes(n, reduction.reached_back(n, e))).select("src", "dst"))(*flow(s)))
query("g05_contract")(lambda s: reduction.reduce(*flow(s))[1])
query("g06_cons_back", f"SELECT callee AS src, caller AS dst FROM ({C48})")(lambda s: reduction.add_back_links(s.edges(48).select("src", F.lit("cons").alias("tag"), "dst")).where("tag = 'cons_back'").select("src", "dst"))
query("g07_drop_loops", "SELECT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 40 AND b.l_quantity >= 40 AND a.l_suppkey <> b.l_suppkey")(lambda s: reduction.drop_loops(s.applications(40).select(F.col("caller").alias("src"), F.lit("flow").alias("tag"), F.col("callee").alias("dst"))).select("src", "dst"))
MOVES = "SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"
ORDER = ["ts", "event_id"]
query("s01_start_states", "SELECT s_suppkey AS fun_id, s_name AS name FROM supplier WHERE s_acctbal > 0 AND s_name <> 'start_link'")(lambda s: automaton.start_states(s.suppliers()))
query("s02_transitions", f"SELECT src, dst, count(*) AS n FROM ({MOVES}) WHERE dst IS NOT NULL GROUP BY 1, 2")(lambda s: automaton.event_transitions(s.t("events"), "user_id", ORDER, "event_type"))
query("s02_explore", f"WITH m AS (SELECT src, dst, count(*) AS n FROM ({MOVES}) WHERE dst IS NOT NULL GROUP BY 1, 2) SELECT src, dst FROM m WHERE src <> 'signup' OR dst <> 'signup'")(lambda s: automaton.explore(s.spark.createDataFrame([("signup",)], "state string"), automaton.event_transitions(s.t("events"), "user_id", ORDER, "event_type").where("src <> 'signup' OR dst <> 'signup'").select("src", "dst"))[1])
query("s03_start_stop", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1")(lambda s: automaton.event_ends(s.t("events"), "user_id", ORDER, "event_type"))
query("s03_classify", "SELECT o_orderkey AS fun, CASE o_orderstatus WHEN 'O' THEN 'next' WHEN 'F' THEN 'stop' ELSE 'follow' END AS outcome FROM orders")(lambda s: automaton.classify(s.t("orders").select(F.col("o_orderkey").alias("fun"), F.expr("CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'stop' END").alias("tag"), F.col("o_orderpriority").alias("second"), F.lit(None).cast("string").alias("third"), F.col("o_custkey").alias("callee"))).select("fun", "outcome"))
query("s04_resolve", f"{REACH48} SELECT DISTINCT b AS expr, s_name AS state FROM r JOIN supplier ON s_suppkey = a WHERE a % 2 = 0 AND b % 2 = 1 UNION SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")(lambda s: automaton.resolve(s.t("supplier").select(F.col("s_suppkey").alias("expr"), F.when(F.col("s_suppkey") % 2 == 0, "atom").otherwise("variable").alias("kind"), F.col("s_name").alias("value")), s.edges(48), s.t("supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("expr"), F.col("s_name").alias("value"))))
query("s05_state_function", "SELECT s_name AS state, CASE WHEN s_suppkey % 4 IN (2, 3) THEN s_suppkey END AS fun_id FROM supplier")(lambda s: automaton.state_function(s.suppliers().select(F.col("name").alias("state")), s.suppliers()))


# -- sources, sinks, administration ----------------------------------------------------------------------------
def saved(s: Star) -> str:
    path = new_path(s.spark, "dump")
    nodes, edges = generic(s)
    dump.save(path, s.modules().select("name"), nodes.select("node_id", "class"), edges)
    return path


query("io01_save", f"SELECT 'calls' AS tag, count(*) AS n FROM ({C45}) UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier")(lambda s: s.spark.read.parquet(f"{saved(s)}/edges").groupBy("tag").agg(F.count(F.lit(1)).alias("n")))


def loaded(s: Star) -> DataFrame:
    """Saved and loaded again beside the graph: classes of the ends of links survive."""
    old = generic(s)[0].select("node_id", "class")
    nodes, edges = dump.load(s.spark, saved(s), s.spark.createDataFrame([("elsewhere",)], "name string"), old)
    nodes = keep(nodes, "loaded")
    a, b = nodes.select(F.col("node_id").alias("src"), F.col("class").alias("a")), nodes.select(F.col("node_id").alias("dst"), F.col("class").alias("b"))
    return edges.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


query("io02_load", f"SELECT 'supplier' AS a, 'supplier' AS b, count(*) AS n FROM ({C45}) UNION ALL SELECT 'region', 'nation', count(*) FROM nation UNION ALL SELECT 'nation', 'supplier', count(*) FROM supplier")(loaded)
query("io03_clash", "SELECT n_name AS name FROM nation WHERE n_regionkey = 1")(lambda s: dump.clash(s.t("nation").select(F.col("n_name").alias("name")), s.t("nation").where("n_regionkey = 1").select(F.col("n_name").alias("name"))))
query("io04_dot_modules", f"{REACH45.replace(C45, NATION_EDGES.replace('src', 'caller').replace('dst', 'callee'))} SELECT '\"' || caller || '\" -> \"' || callee || '\" [color=' || CASE WHEN EXISTS (SELECT 1 FROM r WHERE a = callee AND b = caller) THEN 'red' ELSE 'black' END || '];' AS line FROM g")(lambda s: (lambda e: dot.modules(dependencies.vertices(e).select("node", F.col("node").cast("string").alias("name")), dependencies.cycle_edges(e)).where("line LIKE '%->%'").select("line"))(keep(nation_edges(s), "nation-edges")))
query("io05_dot_blocks", f"SELECT '\"' || src || '\" -> \"' || dst || '\" [color=magenta];' AS line FROM ({BLOCK_EDGES})")(lambda s: (lambda e: dot.blocks(dependencies.vertices(e), e).where("line LIKE '%->%'").select("line"))(block_edges(s)))
query("io06_dot_automaton", f"SELECT DISTINCT '\"' || src || '\" -> \"' || dst || '\" [color=black];' AS line FROM ({MOVES}) WHERE dst IS NOT NULL")(lambda s: (lambda m: dot.automaton(dependencies.vertices(m).select(F.col("node").alias("state"), (F.col("node") == "signup").alias("start"), (F.col("node") == "purchase").alias("stop")), m).where("line LIKE '%->%'").select("line"))(automaton.event_transitions(s.t("events"), "user_id", ORDER, "event_type")))
query("io07_view", "SELECT n_regionkey AS src, n_nationkey AS dst, 'syn' AS kind FROM nation")(lambda s: dot.view(s.t("nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"), F.lit("syn").alias("kind")).unionByName(s.edges(48).select("src", "dst", F.lit("sem").alias("kind"))), 4))

SAMPLE = {
    "a/m1.erl": "-module(m1).\n-export([f/2, g/0]).\n-import(lists, [map/2]).\n% a comment. with stops.\nf(X, {Y, Z}) -> X + Y;\nf(_, _) -> 0.\ng() -> f(1, {2, 3}).\n",
    "a/b/m2.erl": "-module(m2).\n-record(r, {a, b}).\nh([H | T]) -> case H of 1 -> T; _ -> [] end.\n",
}


def ingested(s: Star) -> DataFrame:
    """Two small files written to shared storage and read back."""
    path = new_path(s.spark, "source")
    for name, content in SAMPLE.items():
        folder, _, _ = name.rpartition("/")
        s.spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("append").option("lineSep", "\n").text(f"{path}/{folder}/{'one' if folder == 'a' else 'two'}")
    return files.add(s.spark, path, recursive=True, pattern="*.txt")


query("io08_add_file", "SELECT * FROM (VALUES ('f', 2, 2), ('g', 0, 1), ('h', 1, 1)) v(name, arity, clauses)")(lambda s: files.functions(ingested(s)).select("name", "arity", F.col("clauses").cast("int").alias("clauses")))
query("io09_add_dir", "SELECT * FROM (VALUES ('module', 2), ('export', 1), ('import', 1), ('record', 1), ('func', 3)) v(type, n)")(lambda s: files.forms(ingested(s)).groupBy("type").agg(F.count(F.lit(1)).cast("int").alias("n")))
query("io10_drop", "SELECT o_orderkey FROM orders WHERE o_custkey <> 7")(lambda s: dump.drop_file({"orders": s.t("orders").withColumn("file_id", F.col("o_custkey"))}, 7)["orders"].select("o_orderkey"))
query("io11_filelist", "SELECT path, error, CASE WHEN lag(block) OVER (ORDER BY path) IS DISTINCT FROM block THEN block END AS heading FROM (SELECT '/' || r_name || '/' || n_name AS path, '/' || r_name AS block, n_nationkey = 3 AS error FROM nation JOIN region ON n_regionkey = r_regionkey)")(lambda s: files.listing(s.modules().select("path", (F.col("file_id") == 3).alias("error"))))
query("io12_status", "SELECT '/' || r_name || '/' || n_name AS path, 'module' AS kind, count(s_suppkey) > 0 AS error, count(s_suppkey) AS errors FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0 GROUP BY 1")(lambda s: files.status(s.modules().withColumn("kind", F.lit("module")), s.t("supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("file_id"))))


def versions(s: Star) -> DataFrame:
    v = dump.Versions(s.spark, new_path(s.spark, "versions"))
    v.commit(nation=s.t("nation"))
    v.commit(nation=s.t("nation").where("n_nationkey < 5"))
    last = v.table("nation").count()
    v.undo()
    return v.table("nation").agg(F.count(F.lit(1)).alias("before")).withColumn("after", F.lit(last).cast("long"))


def emptied(s: Star) -> DataFrame:
    v = dump.Versions(s.spark, new_path(s.spark, "versions"))
    v.commit(nation=s.t("nation"))
    v.reset()
    left = len(v.numbers)
    v.commit(nation=s.t("nation").where("n_nationkey < 5"))
    return v.table("nation").agg(F.count(F.lit(1)).alias("after")).withColumn("left", F.lit(left))


query("io13_reset", 'SELECT count(*) AS after, 0 AS "left" FROM nation WHERE n_nationkey < 5')(emptied)
query("io14_undo", "SELECT count(*) AS before, count(*) FILTER (WHERE n_nationkey < 5) AS after FROM nation")(versions)
query("io15_config", "SELECT * FROM (VALUES ('appbase', '/app'), ('include', ''), ('output', 'original')) v(key, value)")(lambda s: files.settings(s.spark, s.spark.createDataFrame([("appbase", "/old", 1), ("appbase", "/app", 2)], "key string, value string, seq long")))
query("io16_history", "SELECT CAST(user_id AS VARCHAR) AS user, event_type AS query, max(ts) AS ts FROM events WHERE user_id = 7 GROUP BY 1, 2")(lambda s: files.history(s.t("events").select(F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("query"), "ts"), "7"))
query("io16_forget", "SELECT event_id FROM events WHERE event_type <> 'view'")(lambda s: files.forget(s.t("events").select(F.lit("u").alias("user"), F.col("event_type").alias("query"), "event_id"), s.spark.createDataFrame([("u", "view")], "user string, query string")).select("event_id"))
query("io17_highlight", "SELECT doc_id, substring(text, 3, 8) AS part FROM documents")(lambda s: s.t("documents").select("doc_id", files.highlight(F.col("text"), F.lit(2), F.lit(9)).alias("part")))

# -- clustering, duplicates ------------------------------------------------------------------------------------
SELLS = "SELECT DISTINCT s_nationkey AS item, p_brand AS attribute FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49"


def sells(s: Star) -> DataFrame:
    sold = s.t("lineitem").where("l_quantity >= 49").join(s.t("supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey").join(s.t("part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    return sold.select(F.col("s_nationkey").alias("item"), F.col("p_brand").alias("attribute")).distinct()


def agglomerated(s: Star, clusters: int = 4) -> DataFrame:
    f = keep(sells(s), "features")
    return cluster.agglomerate(cluster.distances(f), f.select("item").distinct(), clusters)


query("k01_distances", f"WITH f AS ({SELLS}), n AS (SELECT item, count(*) AS n FROM f GROUP BY 1) SELECT x.item AS a, y.item AS b, round(1 - count(*) / (any_value(p.n) + any_value(q.n) - count(*)), 6) AS distance FROM f x JOIN f y ON x.attribute = y.attribute AND x.item < y.item JOIN n p ON p.item = x.item JOIN n q ON q.item = y.item GROUP BY 1, 2")(lambda s: cluster.distances(sells(s)).withColumn("distance", F.round("distance", 6)))
query("k01_agglomerative_modules")(agglomerated)
query("k02_genetic")(lambda s: cluster.genetic(sells(s), 4))
query("k03_agglomerative_functions")(lambda s: (lambda f: cluster.agglomerate(cluster.distances(f), f.select("item").distinct(), 10))(keep(s.edges(48).select(F.col("src").alias("item"), F.col("dst").alias("attribute")), "features")))
query("k04_options", "SELECT 'algorithm' AS key, 'agglomerative' AS value UNION ALL SELECT 'clusters', '4' UNION ALL SELECT 'entity', 'module' UNION ALL SELECT 'generations', '30' UNION ALL SELECT 'linkage', 'average' UNION ALL SELECT 'populations', '4' UNION ALL SELECT 'save', 'False'")(lambda s: s.spark.createDataFrame([(k, str(v)) for k, v in cluster.OPTIONS.items()], "key string, value string"))
query("k05_duplicates", "SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members FROM documents GROUP BY trim(regexp_replace(text, '\\s+', ' ', 'g')) HAVING count(*) > 1")(lambda s: cluster.duplicates(s.t("documents"), "doc_id", "text").select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members")))


# -- change log ------------------------------------------------------------------------------------------------
def log(s: Star) -> DataFrame:
    return s.t("events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("file"), F.when(F.col("event_type") == "error", "dropped").otherwise(F.col("event_type")).alias("event"), F.col("event_type").alias("arg"))


LOG = "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS file, CASE event_type WHEN 'error' THEN 'dropped' ELSE event_type END AS event, event_type AS arg FROM events"
LATEST = f"SELECT file, arg_max(event, seq) AS event, arg_max(arg, seq) AS arg, max(seq) AS seq FROM ({LOG}) GROUP BY 1"
query("e01_latest", LATEST)(lambda s: changelog.latest(log(s)))
query("e02_present", f"SELECT file, false AS error FROM ({LATEST}) WHERE event <> 'dropped'")(lambda s: changelog.present(log(s)).toDF("file", "error"))
query("e03_throttled", "SELECT event_type AS op, arg_max(event_id, (ts, event_id)) AS done FROM events GROUP BY event_type, CAST(floor(epoch(ts)) AS BIGINT) // 3600")(lambda s: changelog.throttled(s.t("events").select(F.col("event_type").alias("op"), F.lit("f").alias("file"), F.col("event_id").alias("done"), F.lit(0).alias("total"), "ts"), 3600).select("op", "done"))


def streamed(s: Star) -> DataFrame:
    """The change log as a stream of files, its latest state kept by batches."""
    base = new_path(s.spark, "stream")
    log(s).repartition(4).write.parquet(f"{base}/in")
    stream = s.spark.readStream.schema(changelog.SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    run = changelog.upsert(stream, f"{base}/out", f"{base}/checkpoint")
    run.awaitTermination()
    last = run.lastProgress["batchId"]
    for number in range(last, -1, -1):
        try:
            return s.spark.read.parquet(f"{base}/out/v{number}")
        except Exception as e:  # a batch without data writes nothing
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise RuntimeError("the stream wrote nothing")


query("e04_stream_upsert", LATEST)(streamed)
query("e05_reload_broadcast", f"SELECT seq, file, event, arg FROM ({LOG}) WHERE event IN ('dropped', 'purchase')")(lambda s: changelog.notices(log(s), ("dropped", "purchase")))

# -- browsing --------------------------------------------------------------------------------------------------
query("b01_children", "SELECT c_nationkey AS parent, 1 AS section_ord, 'customer' AS section, c_custkey AS ord, c_name AS child FROM customer UNION ALL SELECT s_nationkey, 0, 'supplier', s_suppkey, s_name FROM supplier")(
    lambda s: browse.children(s.t("nation").select(F.col("n_nationkey").alias("parent")), [("supplier", s.t("supplier").select(F.col("s_nationkey").alias("parent"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("child"))), ("customer", s.t("customer").select(F.col("c_nationkey").alias("parent"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("child")))])
)
query("b02_info", "SELECT n_nationkey AS mod_id, n_name AS name, count(s_suppkey) AS locals, count(*) FILTER (WHERE s_acctbal > 0) AS exported, coalesce(string_agg(s_name || '/' || (s_suppkey % 4), ', ' ORDER BY s_name || '/' || (s_suppkey % 4)), '') AS members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")(lambda s: browse.module_info(s.modules(), s.suppliers()))
query("b03_text", "SELECT conv_id, string_agg(role, ', ' ORDER BY turn, role) AS list FROM conversations GROUP BY 1")(lambda s: browse.listed(s.t("conversations"), "conv_id", "role", "turn"))
query("b04_find_node", "WITH h AS (SELECT l_orderkey AS path_id, l_linenumber AS ord, min(l_partkey) AS node FROM lineitem GROUP BY 1, 2), v AS (SELECT *, min(CASE WHEN node % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path_id ORDER BY ord) AS run FROM h) SELECT path_id, ord, node FROM v WHERE run = 1")(lambda s: browse.find_node(s.t("lineitem").groupBy(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("node")), s.t("part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("node"))))
query("b05_actions", "SELECT s_suppkey AS node, unnest(['rename_fun', 'move_fun', 'reorder_funpar', 'tuple_funpar']) AS action FROM supplier")(lambda s: browse.actions(s.t("supplier").select(F.col("s_suppkey").alias("node"), F.lit("func").alias("class"))).select("node", "action"))

# -- types -----------------------------------------------------------------------------------------------------
VAR = lambda n: {"kind": "variable", "value": n}
TREES = [
    {"name": "add", "arity": 2, "clauses": [{"patterns": [VAR("X"), VAR("Y")], "body": [{"kind": "infix_expr", "value": "+", "children": [VAR("X"), VAR("Y")]}]}]},
    {"name": "tag", "arity": 1, "clauses": [{"patterns": [VAR("X")], "guard": {"kind": "application", "value": "is_integer", "children": [VAR("X")]}, "body": [{"kind": "tuple", "children": [{"kind": "atom", "value": "ok"}, VAR("X")]}]}, {"patterns": [{"kind": "atom", "value": "none"}], "body": [{"kind": "atom", "value": "error"}]}]},
    {"name": "use", "arity": 0, "clauses": [{"patterns": [], "body": [{"kind": "application", "value": "tag", "children": [{"kind": "integer", "value": "1"}]}]}]},
]
TYPED = ["add/2 :: (int() | float(), int() | float()) -> int() | float()", "tag/1 :: (int()) -> {ok, int()}; (none) -> error", "use/0 :: () -> {ok, int()}"]
query("t01_infer", f"SELECT unnest({TYPED!r}) AS signature")(lambda s: typing.infer(s.spark.createDataFrame([("m", f["name"], f["arity"], json.dumps(f)) for f in TREES], "module string, name string, arity int, tree string")).select("signature"))
query("t09_infix_types", "SELECT 'div' AS operator, 'int()' AS result UNION ALL SELECT '/', 'float()' UNION ALL SELECT '++', 'list()'")(lambda s: s.spark.createDataFrame(list(typing.operator_table()), "form string, operator string, `left` string, `right` string, result string").where("form = 'infix' AND operator IN ('div', '/', '++')").select("operator", "result"))

# -- transformations -------------------------------------------------------------------------------------------
TABLES = lambda s: {"func": s.suppliers(), "module": s.modules().drop("path"), "file": s.modules().select("file_id", "path")}
query("r15_move_fun", "SELECT s_suppkey AS fun_id, CASE WHEN s_suppkey IN (1, 2) THEN 99 ELSE s_nationkey END AS mod_id FROM supplier")(lambda s: transform.move_fun(TABLES(s), [1, 2], 99)["func"].select("fun_id", "mod_id"))
query("r18_reorder_funpar", f"WITH e AS ({EXPR}) SELECT expr_id, CASE n WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE n END AS ord FROM e")(lambda s: (lambda e: transform.reorder_funpar({"expr": e.withColumn("parent_id", F.lit(1).cast("long"))}, [1], [2, 1])["expr"].select("expr_id", "ord"))(s.tree_metrics().code.expr))
query("r20_rename_fun", "SELECT s_suppkey AS fun_id, CASE WHEN s_suppkey = 5 THEN 'renamed' ELSE s_name END AS name FROM supplier")(lambda s: transform.rename_fun(TABLES(s), 5, "renamed")["func"].select("fun_id", "name"))
query("r23_rename_mod", "SELECT n_nationkey AS mod_id, CASE WHEN n_nationkey = 5 THEN 'renamed' ELSE n_name END AS name FROM nation")(lambda s: transform.rename_mod(TABLES(s), 5, "renamed")["module"].select("mod_id", "name"))
query("r23_rename_mod_file", "SELECT n_nationkey AS file_id, '/' || r_name || '/' || CASE WHEN n_nationkey = 5 THEN 'renamed' ELSE n_name END AS path FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda s: transform.rename_mod(TABLES(s), 5, "renamed")["file"].select("file_id", "path"))
def tupled(s: Star) -> DataFrame:
    """Orders as parameter lists, their lines as parameters: the first two of some become a tuple."""
    e = s.t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.lit("expr").alias("kind")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("expr_id"), F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("ord"), "kind")
    return transform.tuple_funpar(TABLES(s) | {"expr": e}, 7, 1, 2, [3, 1, 2])["expr"]


query("r13_tuple_funpar", "SELECT s_suppkey AS fun_id, CAST(s_suppkey % 4 - CASE WHEN s_suppkey = 7 THEN 1 ELSE 0 END AS INT) AS arity FROM supplier")(lambda s: transform.tuple_funpar(TABLES(s), 7, 1, 2)["func"].select("fun_id", "arity"))
query("r13_tuple_arguments", "WITH e AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS expr_id, l_orderkey AS o, l_linenumber AS n FROM lineitem), m AS (SELECT max(expr_id) AS m FROM e) SELECT expr_id, CASE WHEN o BETWEEN 1 AND 3 AND n <= 2 THEN m + o ELSE o END AS parent_id, CASE WHEN o BETWEEN 1 AND 3 AND n > 2 THEN n - 1 ELSE n END AS ord, 'expr' AS kind FROM e, m UNION ALL SELECT m + p, p, 1, 'tuple' FROM m, (SELECT unnest([1, 2, 3]) AS p)")(tupled)
def qualified(s: Star) -> DataFrame:
    """Nation 3 imports nation 5: calls of suppliers there to exported ones here are named with the module."""
    apps = s.applications(45)
    form = s.t("nation").where("n_nationkey = 5").select(F.lit(1).cast("long").alias("form_id"), F.lit(3).alias("file_id"), F.col("n_name").alias("text"))
    tables = TABLES(s) | {"form": form, "application": apps, "expr": apps.select("expr_id", F.lit("call").alias("value")).distinct()}
    return transform.eliminate_import(tables, 1)["expr"]


query("r05_eliminate_import", f"WITH a AS (SELECT a.l_orderkey * 10 + b.l_linenumber AS expr_id, x.s_nationkey = 3 AND y.s_nationkey = 5 AND y.s_acctbal > 0 AS hit FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN supplier x ON x.s_suppkey = a.l_suppkey JOIN supplier y ON y.s_suppkey = b.l_suppkey WHERE a.l_quantity >= 45 AND b.l_quantity >= 45) SELECT expr_id, CASE WHEN bool_or(hit) THEN (SELECT n_name FROM nation WHERE n_nationkey = 5) || ':call' ELSE 'call' END AS value FROM a GROUP BY 1")(qualified)
query("r16_move_mac", "SELECT p_partkey AS macro_id, CASE WHEN p_partkey BETWEEN 1 AND 3 THEN 77 ELSE p_size END AS file_id FROM part")(lambda s: transform.move_mac({"macro": s.t("part").select(F.col("p_partkey").alias("macro_id"), F.col("p_size").alias("file_id"))}, [1, 2, 3], 77)["macro"])
query("r01_upgrade_calls", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 're' ELSE o_orderstatus END AS module FROM orders")(lambda s: transform.upgrade_calls(s.t("orders").select("o_orderkey", F.col("o_orderstatus").alias("module"), F.lit("match").alias("name")), {("F", "match"): ("re", "run")}).select("o_orderkey", "module"))


def customers_as(s: Star, key: str) -> DataFrame:
    return s.t("customer").select(F.col("c_custkey").alias(key), F.col("c_nationkey").alias("file_id"), F.col("c_name").alias("name"))


def renamed(key: str, where: str = "c_custkey = 5") -> str:
    return f"SELECT c_custkey AS {key}, CASE WHEN {where} THEN 'renamed' ELSE c_name END AS name FROM customer"


def inlined(s: Star) -> DataFrame:
    """Nations as macros, customers as expressions that use them or not."""
    macro = s.t("nation").select(F.col("n_nationkey").cast("long").alias("macro_id"), F.col("n_name").alias("name"), F.concat("n_name", F.lit("!")).alias("text"))
    uses = s.t("customer").join(s.t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    expr = uses.select(F.col("c_custkey").alias("expr_id"), F.when(F.col("c_acctbal") > 0, "macro").otherwise("expr").alias("kind"), F.col("n_name").alias("value"))
    return transform.inline_mac({"macro": macro, "expr": expr}, 5)["expr"]


def without_variable(s: Star) -> DataFrame:
    """Suppliers as expressions: 11 to 13 lie inside 10, which is bound to a variable that 20 and 30 refer to."""
    expr = s.t("supplier").select(F.col("s_suppkey").alias("expr_id"), F.when(F.col("s_suppkey").between(11, 13), 10).cast("long").alias("parent_id"), F.lit("expr").alias("kind"), F.col("s_name").alias("value"))
    occurs = s.t("supplier").where("s_suppkey IN (10, 20, 30)").select(F.lit(1).alias("var_id"), F.col("s_suppkey").alias("expr_id"), F.when(F.col("s_suppkey") == 10, "binding").otherwise("reference").alias("kind"))
    return transform.elim_var({"expr": expr, "var_occurrence": occurs, "variable": s.spark.createDataFrame([(1, "X")], "var_id int, name string")}, 1)["expr"]


query("r03_inline_mac", "SELECT c_custkey AS expr_id, CASE WHEN c_acctbal > 0 AND n_nationkey = 5 THEN 'inlined' WHEN c_acctbal > 0 THEN 'macro' ELSE 'expr' END AS kind, n_name || CASE WHEN c_acctbal > 0 AND n_nationkey = 5 THEN '!' ELSE '' END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")(inlined)
query("r04_elim_var", "WITH b AS (SELECT s_name AS v FROM supplier WHERE s_suppkey = 10), r AS (SELECT s_suppkey AS r FROM supplier WHERE s_suppkey IN (20, 30) AND EXISTS (FROM b)) SELECT s_suppkey AS expr_id, CAST(CASE WHEN s_suppkey BETWEEN 11 AND 13 THEN 10 END AS BIGINT) AS parent_id, 'expr' AS kind, CASE WHEN s_suppkey IN (SELECT r FROM r) THEN (SELECT v FROM b) ELSE s_name END AS value FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY r, s_suppkey), r, 'expr', s_name FROM supplier, r WHERE s_suppkey BETWEEN 11 AND 13")(without_variable)
query("r08_introduce_import", "SELECT o_orderkey AS form_id, o_custkey AS file_id, 0 AS ord, 'func' AS type, o_orderstatus AS text FROM orders UNION ALL SELECT max(o_orderkey) + 1, 7, 1, 'import', 'lists' FROM orders")(lambda s: transform.introduce_import({"form": s.t("orders").select(F.col("o_orderkey").alias("form_id"), F.col("o_custkey").alias("file_id"), F.lit(0).alias("ord"), F.lit("func").alias("type"), F.col("o_orderstatus").alias("text"))}, 7, "lists")["form"])
query("r17_move_rec", "SELECT c_custkey AS rec_id, CASE WHEN c_custkey BETWEEN 1 AND 3 THEN 77 ELSE c_nationkey END AS file_id FROM customer")(lambda s: transform.move_rec({"record": customers_as(s, "rec_id")}, [1, 2, 3], 77)["record"].select("rec_id", "file_id"))
query("r19_rename", renamed("macro_id", "c_custkey = 6"))(lambda s: transform.rename({"macro": customers_as(s, "macro_id")}, "macro", 6, "renamed")["macro"].select("macro_id", "name"))
query("r21_rename_header", "SELECT n_nationkey AS file_id, CASE WHEN n_nationkey = 5 THEN '/new.hrl' ELSE '/' || r_name || '/' || n_name END AS path FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda s: transform.rename_header(TABLES(s), 5, "/new.hrl")["file"])
query("r22_rename_mac", renamed("macro_id"))(lambda s: transform.rename_mac({"macro": customers_as(s, "macro_id")}, 5, "renamed")["macro"].select("macro_id", "name"))
query("r24_rename_rec", renamed("rec_id"))(lambda s: transform.rename_rec({"record": customers_as(s, "rec_id")}, 5, "renamed")["record"].select("rec_id", "name"))
query("r25_rename_recfield", "SELECT c_nationkey AS rec_id, c_custkey AS ord, CASE WHEN c_custkey = 5 THEN 'renamed' ELSE c_name END AS name FROM customer")(lambda s: (lambda f: transform.rename_recfield({"record_field": f}, f.where("ord = 5").first()["rec_id"], 5, "renamed")["record_field"])(s.t("customer").select(F.col("c_nationkey").alias("rec_id"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"))))
query("r26_rename_var", renamed("var_id"))(lambda s: transform.rename_var({"variable": customers_as(s, "var_id").withColumnRenamed("file_id", "clause_id")}, 5, "renamed")["variable"].select("var_id", "name"))

# Type expressions of ``-spec m:f(integer(), {ok, [atom()]}) -> X :: (true | _)`` and of ``-spec g() -> any()``.
SPEC_NODES = [
    (1, None, 0, "module_qualifier", None), (2, 1, 0, "atom", "m"), (3, 1, 1, "atom", "f"), (4, None, 0, "fun_sig", None), (5, 4, 0, "arglist", None), (6, 5, 0, "call", None), (7, 6, 0, "atom", "integer"), (8, 6, 1, "arglist", None),
    (9, 5, 1, "tuple", None), (10, 9, 0, "atom", "ok"), (11, 9, 1, "list", None), (12, 11, 0, "call", None), (13, 12, 0, "atom", "atom"), (14, 12, 1, "arglist", None), (15, 4, 1, "vardef", None), (16, 15, 0, "variable", "X"), (17, 15, 1, "paren", None),
    (18, 17, 0, "union", None), (19, 18, 0, "atom", "true"), (20, 18, 1, "joker", None), (21, None, 0, "atom", "g"), (22, None, 0, "fun_sig", None), (23, 22, 0, "arglist", None), (24, 22, 1, "call", None), (25, 24, 0, "atom", "any"), (26, 24, 1, "arglist", None),
]
query("t02_specs", "SELECT * FROM (VALUES ('m', 'f', 2, 'f/2 :: (integer(), {ok, [atom()]}) -> true | any()', NULL), ('n', 'g', 0, 'g/0 :: () -> any()', NULL), ('n', 'f', 2, 'f/2 :: (integer(), {ok, [atom()]}) -> true | any()', 'the specification names module m')) v(module, name, arity, signature, warning)")(
    lambda s: typing.specs(s.spark.createDataFrame([(1, "m", 1, 4), (2, "n", 21, 22), (3, "n", 1, 4)], "form_id long, module string, head_id long, sig_id long"), s.spark.createDataFrame(SPEC_NODES, "id long, parent_id long, ord int, type string, tag string"))
)
