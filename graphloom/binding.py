"""The operators bound to star-schema tables: regions are blocks, nations modules, suppliers (or customers) functions,
orders clauses, their lines expressions, and suppliers of consecutive lines of an order call each other."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.metrics import Code, Metrics
from graphloom.plans.catalog import Catalog
from graphloom.sources.shared import keep

CALLS = (
    "SELECT DISTINCT a.l_suppkey AS caller, b.l_suppkey AS callee FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 "
    "WHERE a.l_quantity >= {q} AND b.l_quantity >= {q} AND a.l_suppkey <> b.l_suppkey"
)
#: Expressions of orders: line numbers from 4 on lie inside the one three before, if the order has it.
EXPR = (
    "SELECT l_orderkey * 10 + l_linenumber AS expr_id, l_orderkey AS o, l_linenumber AS n, CASE min(l_returnflag) WHEN 'R' THEN 'case_expr' WHEN 'A' THEN 'if_expr' ELSE 'application' END AS kind, "
    "CAST(min(l_quantity) AS INT) % 3 + 1 AS branches FROM lineitem GROUP BY l_orderkey, l_linenumber"
)


class Star:
    """The tables in a folder and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._read: dict[str, DataFrame] = {}

    def t(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._read[name]

    def calls(self, q: int) -> DataFrame:
        """Suppliers of consecutive lines of an order, both of a quantity of at least ``q``: 0 takes all lines; 45 and 48 thin the
        graph to a few edges a vertex, so that closures and simple paths can be had in SQL too."""
        line = self.t("lineitem").where(F.col("l_quantity") >= q).select("l_orderkey", "l_linenumber", "l_suppkey")
        a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_suppkey").alias("caller"))
        return a.join(line.withColumnRenamed("l_suppkey", "callee"), ["l_orderkey", "l_linenumber"]).where("caller <> callee").select("caller", "callee").distinct()

    def edges(self, q: int) -> DataFrame:
        return self.calls(q).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))

    def applications(self, q: int) -> DataFrame:
        """All pairs of consecutive lines, equal suppliers and repeats included."""
        line = self.t("lineitem").where(F.col("l_quantity") >= q).select("l_orderkey", "l_linenumber", "l_suppkey")
        a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_suppkey").alias("caller"))
        return a.join(line.withColumnRenamed("l_suppkey", "callee"), ["l_orderkey", "l_linenumber"]).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("expr_id"), "caller", "callee")

    def modules(self) -> DataFrame:
        return self.t("nation").join(self.t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("mod_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("file_id"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"))

    def suppliers(self) -> DataFrame:
        return self.t("supplier").select(F.col("s_suppkey").alias("fun_id"), F.col("s_nationkey").alias("mod_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 4).cast("int").alias("arity"), (F.col("s_acctbal") > 0).alias("exported"))

    def call_metrics(self, q: int) -> Metrics:
        return Metrics(Code(self.modules(), self.suppliers(), self.calls(q), application=self.applications(q)))

    def tree_metrics(self, kinds: dict[str, str] | None = None) -> Metrics:
        """Customers as functions, orders as clauses, lines as expressions; ``kinds`` renames kinds of expressions.  A returned
        line applies its own function, one that was accepted the function of the neighbouring customer."""
        e = self.t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), (F.min("l_quantity").cast("int") % 3 + 1).alias("branches"))
        e = e.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("expr_id"), "l_orderkey", F.col("l_linenumber").alias("ord"), F.expr("CASE f WHEN 'R' THEN 'case_expr' WHEN 'A' THEN 'if_expr' ELSE 'application' END").alias("kind"), "branches")
        above = e.select(F.col("expr_id").alias("parent_id"), "l_orderkey", (F.col("ord") + 3).alias("ord"))
        e = keep(e.join(above, ["l_orderkey", "ord"], "left"), "expressions")  # read several times below
        expr = e.select("expr_id", "parent_id", F.when(F.col("parent_id").isNull(), F.col("l_orderkey")).alias("clause_id"), "ord", "kind", F.lit("expr").alias("role"), F.lit(None).cast("string").alias("value"))
        own = self.t("orders").select(F.col("o_orderkey").alias("clause_id"), F.col("o_custkey").alias("owner_id"), F.lit("function").alias("owner_kind"), F.col("o_orderkey").alias("ord"), F.lit("plain").alias("kind"))
        sub = e.where("kind <> 'application'").select("expr_id", "kind", F.explode(F.sequence(F.lit(1), "branches")).alias("k"))
        sub = sub.select((F.lit(10**12) + F.col("expr_id") * 10 + F.col("k")).alias("clause_id"), F.col("expr_id").alias("owner_id"), F.lit("expr").alias("owner_kind"), F.col("k").cast("long").alias("ord"), F.when((F.col("kind") == "case_expr") & (F.col("k") == 1), "head").otherwise("plain").alias("kind"))
        func = self.t("customer").select(F.col("c_custkey").alias("fun_id"), F.col("c_nationkey").alias("mod_id"), F.col("c_name").alias("name"), F.lit(0).alias("arity"), F.lit(True).alias("exported"))
        beside = F.when(F.col("caller") % 2 == 1, F.col("caller") + 1).otherwise(F.col("caller") - 1)
        apps = e.where("kind <> 'application'").join(self.t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("caller")), "l_orderkey")
        apps = apps.select("expr_id", "caller", F.when(F.col("kind") == "case_expr", F.col("caller")).otherwise(beside).alias("callee"))
        for kind, name in (kinds or {}).items():
            expr = expr.withColumn("kind", F.when(F.col("kind") == kind, name).otherwise(F.col("kind")))
        return Metrics(Code(self.modules(), func, apps.select("caller", "callee").distinct(), expr=expr, clause=own.unionByName(sub), application=apps))

    def text_metrics(self) -> Metrics:
        """Documents as files, modules and functions at once."""
        d = self.t("documents").select(F.col("doc_id").alias("id"), "text", "source")
        file = d.select(F.col("id").alias("file_id"), F.concat(F.lit("/"), "source", F.lit("/"), F.col("id").cast("string")).alias("path"), "text")
        form = d.select(F.col("id").alias("form_id"), F.col("id").alias("file_id"), F.lit(0).alias("ord"), F.lit("func").alias("type"), "text", F.col("id").alias("fun_id"))
        module = d.select(F.col("id").alias("mod_id"), F.col("id").cast("string").alias("name"), F.col("id").alias("file_id"))
        func = d.select(F.col("id").alias("fun_id"), F.col("id").alias("mod_id"), F.lit("f").alias("name"), F.lit(0).alias("arity"), F.lit(True).alias("exported"))
        return Metrics(Code(module, func, self.spark.createDataFrame([], "caller long, callee long"), file=file, form=form))

    def part_metrics(self) -> Metrics:
        """Nations with the parts that their suppliers ship: macros, records, includes, imports."""
        owner = self.t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("file_id"))
        sold = self.t("lineitem").where("l_quantity >= 40").join(owner, "l_suppkey").join(self.t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size"), "l_partkey")
        macro = sold.select("file_id", F.col("p_brand").alias("name")).distinct()
        record = sold.select("file_id", F.col("p_type").alias("name")).distinct()
        include = sold.select("file_id", (F.col("p_size") % 25).alias("inc_file_id")).distinct()
        form = sold.select("file_id", F.lit("import").alias("type"), F.col("p_size").cast("string").alias("text"))
        return Metrics(Code(self.modules(), self.suppliers(), self.calls(45), macro=macro, record=record, include=include, form=form))

    def catalog(self) -> Catalog:
        c = Catalog()
        nation = self.t("nation").withColumn("name", F.col("n_name"))
        c.entity("region", self.t("region"), "r_regionkey", "regions", name="r_name", key="r_regionkey")
        c.entity("nation", nation, "n_nationkey", "nations", name="n_name", key="n_nationkey")
        s = c.entity("supplier", self.t("supplier"), "s_suppkey", "suppliers", name="s_name", acctbal="s_acctbal", key="s_suppkey", nationkey="s_nationkey")
        c.entity("customer", self.t("customer"), "c_custkey", "customers", name="c_name", acctbal="c_acctbal", segment="c_mktsegment", key="c_custkey", nationkey="c_nationkey")
        c.entity("order", self.t("orders"), "o_orderkey", "orders", price="o_totalprice", status="o_orderstatus", priority="o_orderpriority", key="o_orderkey")
        c.selector("region", "nations", "nation", self.t("nation"), "n_regionkey", "n_nationkey")
        c.selector("nation", "region", "region", self.t("nation"), "n_nationkey", "n_regionkey")
        c.selector("nation", "suppliers", "supplier", self.t("supplier"), "s_nationkey", "s_suppkey")
        c.selector("nation", "customers", "customer", self.t("customer"), "c_nationkey", "c_custkey")
        c.selector("supplier", ("nation", "module"), "nation", self.t("supplier"), "s_suppkey", "s_nationkey")
        c.selector("customer", "nation", "nation", self.t("customer"), "c_custkey", "c_nationkey")
        c.selector("customer", "orders", "order", self.t("orders"), "o_custkey", "o_orderkey")
        c.selector("order", "customer", "customer", self.t("orders"), "o_orderkey", "o_custkey")
        for q in (45, 48):
            c.selector("supplier", (f"calls{q}",), "supplier", partial(self.calls, q), "caller", "callee")
            c.selector("supplier", (f"called{q}",), "supplier", partial(self.calls, q), "callee", "caller")
        c.selector("supplier", "refs", "supplier", partial(self.calls, 45), "callee", "caller")
        c.start("@fun", "supplier", self.t("supplier").where("s_suppkey = 3").select(F.col("s_suppkey").alias("node")))
        c.start("@def", "supplier", self.t("supplier").where("s_suppkey = 3").select(F.col("s_suppkey").alias("node")))
        s.metrics["calls_from"] = lambda: self.call_metrics(45).calls_from_function()
        c.entities["nation"].metrics["number_of_fun"] = lambda: self.call_metrics(45).number_of_fun()
        return c
