"""The metrics: ``(node, value)`` tables over a code graph.

:class:`Code` holds the tables; each may be any DataFrame with the columns named in FIXTURES.  A metric is a method; most
take the scope, ``module`` or ``function``.  Module metrics count zero for modules that have nothing to count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph
from graphloom.sources.shared import keep



@dataclass
class Code:
    module: DataFrame  # mod_id, name, file_id
    func: DataFrame  # fun_id, mod_id, name, arity, exported
    calls: DataFrame  # caller, callee: distinct pairs
    file: DataFrame | None = None  # file_id, path, text
    form: DataFrame | None = None  # form_id, file_id, ord, type, text, fun_id
    clause: DataFrame | None = None  # clause_id, owner_id, owner_kind, ord, kind
    expr: DataFrame | None = None  # expr_id, parent_id, clause_id, ord, kind, role, value
    application: DataFrame | None = None  # expr_id, caller, callee
    include: DataFrame | None = None  # file_id, inc_file_id
    macro: DataFrame | None = None  # macro_id, file_id, name
    record: DataFrame | None = None  # rec_id, file_id, name


class Metrics:
    def __init__(self, code: Code) -> None:
        self.code = code
        self._kept: dict[str, DataFrame] = {}

    # -- helpers -----------------------------------------------------------------------------------------------
    def nodes(self, scope: str) -> DataFrame:
        return self.code.module.select(F.col("mod_id").alias("node")) if scope == "module" else self.code.func.select(F.col("fun_id").alias("node"))

    def _per(self, scope: str, counted: DataFrame, value: Column | None = None) -> DataFrame:
        """One row for each node, 0 where ``counted (node)`` has none."""
        some = counted.groupBy("node").agg((F.count("*") if value is None else value).cast("long").alias("value"))
        return self.nodes(scope).join(some, "node", "left").select("node", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    def _lift(self, per_function: DataFrame, how: Callable[[str], Column]) -> DataFrame:
        """A module's value from those of its functions ``(node, value)``."""
        owned = self.code.func.where("mod_id IS NOT NULL").select("mod_id", F.col("fun_id").alias("node")).join(per_function, "node")
        return self._per("module", owned.select(F.col("mod_id").alias("node"), "value"), how("value"))

    def _texts(self, scope: str) -> DataFrame:
        """Files of modules, or the first defining form of functions."""
        if scope == "module":
            return self.code.module.select(F.col("mod_id").alias("node"), "file_id").join(self.code.file.select("file_id", "text"), "file_id").select("node", "text")
        forms = self.code.form.where("type = 'func'").groupBy(F.col("fun_id").alias("node")).agg(F.min_by("text", F.struct("ord", "form_id")).alias("text"))
        return forms

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = keep(make(), name)
        return self._kept[name]

    # -- text --------------------------------------------------------------------------------------------------
    def line_of_code(self, scope: str) -> DataFrame:
        return self._texts(scope).select("node", T.line_of_code(F.col("text")).alias("value"))

    def char_of_code(self, scope: str) -> DataFrame:
        return self._texts(scope).select("node", T.char_of_code(F.col("text"), scope).alias("value"))

    def max_length_of_line(self, scope: str) -> DataFrame:
        return self._texts(scope).select("node", T.max_length_of_line(F.col("text"), False).alias("value"))

    def average_length_of_line(self, scope: str) -> DataFrame:
        return self._texts(scope).select("node", T.average_length_of_line(F.col("text"), False).alias("value"))

    def no_space_after_comma(self, scope: str) -> DataFrame:
        return self._texts(scope).select("node", T.no_space_after_comma(F.col("text"), scope).alias("value"))

    # -- counts of modules -------------------------------------------------------------------------------------
    def number_of_fun(self, scope: str = "module") -> DataFrame:
        return self._per("module", self.code.func.select(F.col("mod_id").alias("node")))

    def _in_file(self, table: DataFrame) -> DataFrame:
        return self._per("module", self.code.module.select(F.col("mod_id").alias("node"), "file_id").join(table, "file_id"))

    def number_of_macros(self, scope: str = "module") -> DataFrame:
        return self._in_file(self.code.macro.select("file_id"))

    def number_of_records(self, scope: str = "module") -> DataFrame:
        return self._in_file(self.code.record.select("file_id"))

    def included_files(self, scope: str = "module") -> DataFrame:
        """Includes; a file's inclusion of itself is taken out once."""
        own = self.code.include.select("file_id", F.when(F.col("file_id") == F.col("inc_file_id"), 1).otherwise(0).alias("own"))
        met = self.code.module.select(F.col("mod_id").alias("node"), "file_id").join(own, "file_id")
        return self._per("module", met, F.count("*") - F.max("own"))

    def imported_modules(self, scope: str = "module") -> DataFrame:
        forms = self.code.form.where("type = 'import'").select("file_id", F.col("text").alias("imported"))
        met = self.code.module.select(F.col("mod_id").alias("node"), "file_id").join(forms, "file_id")
        return self._per("module", met, F.count_distinct("imported"))

    # -- calls -------------------------------------------------------------------------------------------------
    def _module_calls(self) -> DataFrame:
        """Distinct caller and callee with their modules."""
        f = self.code.func
        a, b = f.select(F.col("fun_id").alias("caller"), F.col("mod_id").alias("m1")), f.select(F.col("fun_id").alias("callee"), F.col("mod_id").alias("m2"))
        return self.code.calls.select("caller", "callee").join(a, "caller").join(b, "callee", "left")

    def function_calls_in(self, scope: str = "module") -> DataFrame:
        return self._per("module", self._module_calls().where("m1 <> m2").select(F.col("m2").alias("node")))

    def function_calls_out(self, scope: str = "module") -> DataFrame:
        return self._per("module", self._module_calls().where("m1 IS NOT NULL AND NOT (m1 <=> m2)").select(F.col("m1").alias("node")))

    def cohesion(self, scope: str = "module") -> DataFrame:
        return self._per("module", self._module_calls().where("m1 = m2").select(F.col("m1").alias("node")))

    def number_of_funpath(self, scope: str = "module") -> DataFrame:
        return self._sum([self.cohesion(), self.function_calls_in(), self.function_calls_out()])

    def _sum(self, tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out.groupBy("node").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))

    def calls_for_function(self, scope: str = "function") -> DataFrame:
        return self._per("function", self.code.application.select(F.col("callee").alias("node")))

    def calls_from_function(self, scope: str = "function") -> DataFrame:
        return self._per("function", self.code.calls.select(F.col("caller").alias("node")))

    def _function_depths(self) -> DataFrame:
        edges = self.code.calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
        return self._once("depths", lambda: graph.longest_paths(edges, self.nodes("function")).select("node", F.col("depth").cast("long").alias("value")))

    def max_depth_of_calling(self, scope: str) -> DataFrame:
        """The longest simple path of calls from a function; of a module's functions the longest."""
        return self._function_depths() if scope == "function" else self._lift(self._function_depths(), F.max)

    def min_depth_of_calling(self, scope: str = "module") -> DataFrame:
        """The smallest depth of a module's functions that isn't 0; 0 if all are."""
        return self._lift(self._function_depths().where("value > 0"), F.min)

    def branches_of_recursion(self, scope: str) -> DataFrame:
        own = self.code.application.where("caller = callee").select(F.col("caller").alias("node"))
        out = self._per("function", own)
        return out if scope == "function" else self._lift(out, F.sum)

    def is_tail_recursive(self, scope: str = "function") -> DataFrame:
        """1 if the very last top-level expression of the last clause alone is a call that leads back to the function, 0 if an
        earlier top-level expression is, -1 if none is."""
        edges = self.code.calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
        back = self._once("closure", lambda: graph.reach(edges)).select(F.col("src").alias("callee"), F.col("dst").alias("caller"))
        tops = self._top_expressions()
        last = tops.groupBy("fun_id").agg(F.max(F.struct("clause_ord", "ord", "expr_id")).alias("l"))
        apps = self.code.application.select("expr_id", "caller", "callee")
        looping = apps.where("caller = callee").unionByName(apps.join(back, ["callee", "caller"], "left_semi").select("expr_id", "caller", "callee")).select("expr_id").distinct()
        inside = self._within().join(looping, "expr_id").select(F.col("top").alias("expr_id")).distinct().withColumn("loops", F.lit(True))
        direct = looping.withColumn("direct", F.lit(True))
        per = tops.join(last, "fun_id").join(inside, "expr_id", "left").join(direct, "expr_id", "left")
        is_last = F.col("expr_id") == F.col("l.expr_id")
        early = F.max(F.when(F.col("loops") & ~is_last, 1).otherwise(0)) + F.max(F.when(F.col("loops") & is_last & F.col("direct").isNull(), 1).otherwise(0))
        at_end = F.max(F.when(F.col("direct") & is_last, 1).otherwise(0))
        got = per.groupBy(F.col("fun_id").alias("node")).agg(F.when(early > 0, 0).when(at_end > 0, 1).otherwise(-1).cast("long").alias("value"))
        return self.nodes("function").join(got, "node", "left").select("node", F.coalesce("value", F.lit(-1).cast("long")).alias("value"))

    # -- structure ---------------------------------------------------------------------------------------------
    def _function_clauses(self) -> DataFrame:
        return self.code.clause.where("owner_kind = 'function'").select("clause_id", F.col("owner_id").alias("fun_id"), F.col("ord").alias("clause_ord"))

    def _top_expressions(self) -> DataFrame:
        tops = self.code.expr.where("parent_id IS NULL AND role = 'expr'").select("expr_id", "clause_id", "ord", "kind")
        return tops.join(self._function_clauses(), "clause_id").select("expr_id", "fun_id", "clause_ord", "ord", "kind")

    def _parents(self) -> DataFrame:
        """``(src, dst)``: from an expression to those directly inside it, through its clauses too."""
        e, c = self.code.expr, self.code.clause.where("owner_kind = 'expr'").select("clause_id", F.col("owner_id").alias("src"))
        inner = e.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("expr_id").alias("dst"))
        return inner.union(e.where("parent_id IS NULL").join(c, "clause_id").select("src", F.col("expr_id").alias("dst")))

    def _within(self) -> DataFrame:
        """``(top, expr_id)``: all expressions at or below each top-level expression of a function."""

        def make() -> DataFrame:
            tops = self._top_expressions().select(F.col("expr_id").alias("top"))
            below = graph.roots(self._parents()).select(F.col("root").alias("top"), F.col("node").alias("expr_id"))
            return below.join(tops, "top", "left_semi").union(tops.select("top", F.col("top").alias("expr_id")))

        return self._once("within", make)

    def _inside(self) -> DataFrame:
        """``(fun_id, expr_id, kind)``: all expressions of a function."""
        tops = self._top_expressions().select(F.col("expr_id").alias("top"), "fun_id")
        return self._within().join(tops, "top").join(self.code.expr.select("expr_id", "kind"), "expr_id").select("fun_id", "expr_id", "kind").distinct()

    def number_of_funclauses(self, scope: str) -> DataFrame:
        out = self._per("function", self._function_clauses().select(F.col("fun_id").alias("node")))
        return out if scope == "function" else self._lift(out, F.sum)

    def _branches(self) -> DataFrame:
        return self.code.clause.where("owner_kind = 'expr'").groupBy(F.col("owner_id").alias("expr_id")).agg(F.count("*").alias("n"))

    def mccabe(self, scope: str) -> DataFrame:
        """(clauses - 1) + what every if and case adds + 1; a case has a head clause that isn't a branch."""
        extra = self._inside().where("kind IN ('if_expr', 'case_expr')").join(self._branches(), "expr_id").select(F.col("fun_id").alias("node"), (F.col("n") - F.when(F.col("kind") == "if_expr", 1).otherwise(2)).alias("value"))
        clauses = self.number_of_funclauses("function")
        out = clauses.unionByName(extra).groupBy("node").agg(F.sum("value").cast("long").alias("value"))
        return out if scope == "function" else self._lift(out, F.sum)

    def _nested(self, kind: str, scope: str) -> DataFrame:
        out = self._per("function", self._inside().where(F.col("kind") == kind).select(F.col("fun_id").alias("node")))
        return out if scope == "function" else self._lift(out, F.sum)

    def number_of_funexpr(self, scope: str) -> DataFrame:
        return self._nested("fun_expr", scope)

    def number_of_messpass(self, scope: str) -> DataFrame:
        return self._nested("send_expr", scope)

    def _deepest(self, kind: str, scope: str) -> DataFrame:
        """The most expressions of a kind on a way down from a function's top-level expressions."""
        edges = keep(self._parents(), "parents").select("src", "dst")
        kinds = self.code.expr.select(F.col("expr_id").alias("node"), (F.col("kind") == kind).cast("long").alias("one"))
        now = keep(self._top_expressions().select("fun_id", F.col("expr_id").alias("node")).join(kinds, "node").select("fun_id", "node", F.col("one").alias("depth")), "level")
        best = now.groupBy("fun_id").agg(F.max("depth").alias("depth"))
        while not now.isEmpty():
            now = keep(now.join(edges, F.col("node") == F.col("src")).select("fun_id", F.col("dst").alias("node"), "depth").join(kinds, "node").select("fun_id", "node", (F.col("depth") + F.col("one")).alias("depth")), "level")
            best = best.union(now.groupBy("fun_id").agg(F.max("depth").alias("depth")))
        out = self._per("function", best.select(F.col("fun_id").alias("node"), "depth"), F.max("depth"))
        return out if scope == "function" else self._lift(out, F.max)

    def max_application_depth(self, scope: str) -> DataFrame:
        return self._deepest("application", scope)

    def max_depth_of_cases(self, scope: str) -> DataFrame:
        return self._deepest("case_expr", scope)

    def fun_return_points(self, scope: str) -> DataFrame:
        """Last expressions of clauses; a case, try or if counts by the clauses that aren't its head instead."""
        last = self.code.expr.where("parent_id IS NULL AND role = 'expr'").groupBy("clause_id").agg(F.max_by(F.struct("expr_id", "kind"), F.struct("ord", "expr_id")).alias("e")).select("clause_id", "e.expr_id", "e.kind")
        last = keep(last, "last")
        inner = self.code.clause.where("owner_kind = 'expr' AND kind <> 'head'").select(F.col("owner_id").alias("expr_id"), "clause_id")
        now = keep(self._function_clauses().select("fun_id", "clause_id").join(last, "clause_id").select("fun_id", "expr_id", "kind"), "points")
        branching = F.col("kind").isin("case_expr", "try_expr", "if_expr")
        ends = now.where(~branching)
        while not (now := keep(now.where(branching).select("fun_id", "expr_id").join(inner, "expr_id").select("fun_id", "clause_id").join(last, "clause_id").select("fun_id", "expr_id", "kind"), "points")).isEmpty():
            ends = ends.union(now.where(~branching))
        out = self._per("function", ends.select(F.col("fun_id").alias("node")))
        return out if scope == "function" else self._lift(out, F.sum)

    # -- constants and sums ------------------------------------------------------------------------------------
    def otp_used(self, scope: str = "module") -> DataFrame:
        return self.nodes("module").select("node", F.lit(0).cast("long").alias("value"))

    def average_size(self, scope: str = "module") -> DataFrame:
        return self.nodes("module").select("node", F.lit(0).cast("long").alias("value"))

    def function_sum(self, scope: str = "function", mode: str = "compatible") -> DataFrame:
        """Compatible: the number of parts, 9.  Documented: the sum of the parts."""
        if mode == "compatible":
            return self.nodes("function").select("node", F.lit(len(FUNCTION_PARTS)).cast("long").alias("value"))
        return self._sum([getattr(self, m)("function") for m in FUNCTION_PARTS])

    def module_sum(self, scope: str = "module", parts: tuple[str, ...] | None = None) -> DataFrame:
        return self._sum([getattr(self, m)("module") for m in parts or MODULE_PARTS])

    def table(self) -> dict:
        """What the metric language takes: name to (scopes, function of the scope)."""
        return {name: (scopes, getattr(self, name.lower())) for name, scopes in SCOPES.items()}


# The metrics with the scopes they are for, in the order of the help list.
BOTH, MODULE, FUNCTION = ("module", "function"), ("module",), ("function",)
SCOPES = {
    "module_sum": MODULE, "line_of_code": BOTH, "char_of_code": BOTH, "number_of_fun": MODULE, "number_of_macros": MODULE, "number_of_records": MODULE, "included_files": MODULE, "imported_modules": MODULE,
    "number_of_funpath": MODULE, "function_calls_in": MODULE, "function_calls_out": MODULE, "cohesion": MODULE, "otp_used": MODULE, "function_sum": FUNCTION, "max_application_depth": BOTH, "max_depth_of_calling": BOTH,
    "min_depth_of_calling": MODULE, "max_depth_of_cases": BOTH, "number_of_funclauses": BOTH, "branches_of_recursion": BOTH, "mcCabe": BOTH, "calls_for_function": FUNCTION, "calls_from_function": FUNCTION, "number_of_funexpr": BOTH,
    "number_of_messpass": BOTH, "fun_return_points": BOTH, "average_size": MODULE, "max_length_of_line": BOTH, "average_length_of_line": BOTH, "no_space_after_comma": BOTH, "is_tail_recursive": FUNCTION,
}

# The parts of the two sums.
FUNCTION_PARTS = ("line_of_code", "char_of_code", "number_of_funclauses", "branches_of_recursion", "mccabe", "calls_for_function", "calls_from_function", "fun_return_points", "number_of_messpass")
MODULE_PARTS = (
    "line_of_code", "char_of_code", "number_of_fun", "number_of_macros", "number_of_records", "included_files", "imported_modules", "number_of_funpath",
    "function_calls_in", "function_calls_out", "cohesion", "otp_used", "max_application_depth", "max_depth_of_calling", "min_depth_of_calling", "max_depth_of_cases",
    "number_of_funclauses", "branches_of_recursion", "mccabe", "number_of_funexpr", "number_of_messpass", "average_size", "max_length_of_line", "average_length_of_line", "no_space_after_comma",
)
