"""Transformations of a code graph with a meaning for its tables: each returns new tables, and a snapshot of the
old ones is an undo.

``Tables`` maps a table's name to its DataFrame.  A rename or move that meets an existing name is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph

Tables = dict[str, DataFrame]


class Clash(ValueError):
    """The new name is taken."""


def _set(table: DataFrame, where: Column, **values: Column | str | int) -> DataFrame:
    for name, value in values.items():
        new = value if isinstance(value, Column) else F.lit(value)
        table = table.withColumn(name, F.when(where, new.cast(table.schema[name].dataType)).otherwise(F.col(name)))
    return table


def _free(table: DataFrame, where: Column, what: str) -> None:
    if not table.where(where).isEmpty():
        raise Clash(what)


def rename_fun(t: Tables, fun_id: int, name: str) -> Tables:
    f = t["func"]
    same = f.alias("a").join(f.where(F.col("fun_id") == fun_id).alias("b"), (F.col("a.mod_id") == F.col("b.mod_id")) & (F.col("a.arity") == F.col("b.arity"))).where((F.col("a.name") == name) & (F.col("a.fun_id") != fun_id))
    if not same.isEmpty():
        raise Clash(name)
    return t | {"func": _set(f, F.col("fun_id") == fun_id, name=name)}


def rename_mod(t: Tables, mod_id: int, name: str) -> Tables:
    _free(t["module"], (F.col("name") == name) & (F.col("mod_id") != mod_id), name)
    owner = t["module"].where(F.col("mod_id") == mod_id).select("file_id")
    files = t["file"].join(owner.withColumn("_own", F.lit(True)), "file_id", "left")
    path = F.when(F.col("_own"), F.regexp_replace("path", r"[^/.]+(\.[^/]*)?$", name + "$1")).otherwise(F.col("path"))
    return t | {"module": _set(t["module"], F.col("mod_id") == mod_id, name=name), "file": files.withColumn("path", path).drop("_own")}


def rename_header(t: Tables, file_id: int, path: str) -> Tables:
    _free(t["file"], (F.col("path") == path) & (F.col("file_id") != file_id), path)
    return t | {"file": _set(t["file"], F.col("file_id") == file_id, path=path)}


def _rename(table: str, key: str, scope: str):
    def go(t: Tables, node: int, name: str) -> Tables:
        if scope in t[table].columns:
            own = t[table].where(F.col(key) == node).select(scope)
            _free(t[table].join(own, scope, "left_semi"), (F.col("name") == name) & (F.col(key) != node), name)
        return t | {table: _set(t[table], F.col(key) == node, name=name)}

    return go


rename_mac, rename_rec, rename_var = _rename("macro", "macro_id", "file_id"), _rename("record", "rec_id", "file_id"), _rename("variable", "var_id", "clause_id")


def rename_recfield(t: Tables, rec_id: int, ord: int, name: str) -> Tables:  # noqa: A002
    _free(t["record_field"], (F.col("rec_id") == rec_id) & (F.col("name") == name) & (F.col("ord") != ord), name)
    return t | {"record_field": _set(t["record_field"], (F.col("rec_id") == rec_id) & (F.col("ord") == ord), name=name)}


def move_fun(t: Tables, functions: list[int], mod_id: int) -> Tables:
    moved = F.col("fun_id").isin(functions)
    both = t["func"].where(moved).select("name", "arity").intersect(t["func"].where((F.col("mod_id") == mod_id) & ~moved).select("name", "arity"))
    if not both.isEmpty():
        raise Clash(str(both.first()))
    return t | {"func": _set(t["func"], moved, mod_id=mod_id)}


def _move(table: str, key: str):
    def go(t: Tables, nodes: list[int], file_id: int) -> Tables:
        moved = F.col(key).isin(nodes)
        if "name" in t[table].columns:
            both = t[table].where(moved).select("name").intersect(t[table].where((F.col("file_id") == file_id) & ~moved).select("name"))
            if not both.isEmpty():
                raise Clash(str(both.first()))
        return t | {table: _set(t[table], moved, file_id=file_id)}

    return go


move_mac, move_rec = _move("macro", "macro_id"), _move("record", "rec_id")


def reorder_funpar(t: Tables, parents: list[int], order: list[int]) -> Tables:
    """The ``order[i]``-th child of each parent expression comes ``i``-th (from 1): arguments of definitions and calls alike."""
    place = F.element_at(F.create_map(*(F.lit(x) for i, o in enumerate(order, 1) for x in (o, i))), F.col("ord"))
    return t | {"expr": t["expr"].withColumn("ord", F.when(F.col("parent_id").isin(parents), F.coalesce(place, F.col("ord"))).otherwise(F.col("ord")).cast(t["expr"].schema["ord"].dataType))}


def tuple_funpar(t: Tables, fun_id: int, first: int, last: int, parents: list[int] | None = None) -> Tables:
    """Parameters ``first`` to ``last`` become one tuple: the arity falls, and below each of ``parents`` (the parameter lists
    of the function's clauses and of its calls) those children go into a new tuple expression in their place."""
    out = t | {"func": _set(t["func"], F.col("fun_id") == fun_id, arity=F.col("arity") - (last - first))}
    if not parents:
        return out
    e = t["expr"]
    top = e.agg(F.max("expr_id")).first()[0]
    new = e.sparkSession.createDataFrame([(p, top + i) for i, p in enumerate(sorted(parents), 1)], "parent_id long, _tuple long")
    inside, after = F.col("_tuple").isNotNull() & F.col("ord").between(first, last), F.col("_tuple").isNotNull() & (F.col("ord") > last)
    ord_type, id_type = e.schema["ord"].dataType, e.schema["expr_id"].dataType
    moved = e.join(F.broadcast(new), "parent_id", "left").withColumn("_parent", F.when(inside, F.col("_tuple").cast(id_type)).otherwise(F.col("parent_id")))
    place = F.when(inside, F.col("ord") - (first - 1)).when(after, F.col("ord") - (last - first)).otherwise(F.col("ord"))
    moved = moved.withColumn("ord", place.cast(ord_type)).withColumn("parent_id", F.col("_parent")).select(*e.columns)
    made = new.select(F.col("_tuple").cast(id_type).alias("expr_id"), F.col("parent_id").cast(id_type).alias("parent_id"), F.lit(first).cast(ord_type).alias("ord"), F.lit("tuple").alias("kind"))
    return out | {"expr": moved.unionByName(made, allowMissingColumns=True)}


def eliminate_import(t: Tables, form_id: int) -> Tables:
    """The import vanishes; the file's calls of what the imported module exports name the module instead.  ``form.text`` is
    the module's name; calls are rows of ``application`` whose expression's ``value`` has no module yet."""
    out = t | {"form": t["form"].where(F.col("form_id") != form_id)}
    if "application" not in t:
        return out
    gone = t["form"].where(F.col("form_id") == form_id).select("file_id", F.col("text").alias("_module"))
    m, f = t["module"], t["func"]
    here = m.join(gone, "file_id").select(F.col("mod_id").alias("_here"), "_module")
    there = m.join(gone.select("_module"), F.col("name") == F.col("_module")).select(F.col("mod_id").alias("_there"))
    a = f.select(F.col("fun_id").alias("caller"), F.col("mod_id").alias("_here"))
    b = f.where("exported").select(F.col("fun_id").alias("callee"), F.col("mod_id").alias("_there"))
    calls = t["application"].join(a, "caller").join(here, "_here").join(b, "callee").join(there, "_there").select("expr_id", "_module").distinct()
    e = t["expr"].join(calls, "expr_id", "left")
    named = F.when(F.col("_module").isNotNull() & ~F.contains("value", F.lit(":")), F.concat("_module", F.lit(":"), "value")).otherwise(F.col("value"))
    return out | {"expr": e.withColumn("value", named).select(*t["expr"].columns)}


def introduce_import(t: Tables, file_id: int, module: str) -> Tables:
    form = t["form"]
    top = form.agg(F.coalesce(F.max("form_id"), F.lit(0)).alias("top"), F.coalesce(F.max(F.when(F.col("file_id") == file_id, F.col("ord"))), F.lit(0)).alias("o"))
    row = top.select((F.col("top") + 1).alias("form_id"), F.lit(file_id).alias("file_id"), (F.col("o") + 1).alias("ord"), F.lit("import").alias("type"), F.lit(module).alias("text"))
    return t | {"form": form.unionByName(row, allowMissingColumns=True)}


def elim_var(t: Tables, var_id: int) -> Tables:
    """References of a variable take over the expression that is bound to it, with copies of all that is below it; the
    variable and its occurrences vanish.  Copies have new ids after the largest, in order of reference and expression."""
    e = t["expr"]
    uses = t["var_occurrence"].where(F.col("var_id") == var_id)
    bound = uses.where("kind = 'binding'").agg(F.min("expr_id")).first()[0]
    out = t | {"variable": t["variable"].where(F.col("var_id") != var_id), "var_occurrence": t["var_occurrence"].where(F.col("var_id") != var_id)}
    if bound is None:
        return out
    refs = uses.where("kind = 'reference'").select(F.col("expr_id").alias("_ref")).distinct()
    own = e.where(F.col("expr_id") == bound).select(F.col("kind").alias("_k"), F.col("value").alias("_v"))
    is_ref = e.join(refs, e["expr_id"] == refs["_ref"], "left").join(F.broadcast(own), F.lit(True), "left")  # one row
    changed = is_ref.withColumn("kind", F.when(F.col("_ref").isNotNull(), F.coalesce("_k", "kind")).otherwise(F.col("kind"))).withColumn("value", F.when(F.col("_ref").isNotNull(), F.coalesce("_v", "value")).otherwise(F.col("value"))).select(*e.columns)
    if "parent_id" not in e.columns:
        return out | {"expr": changed}
    edges = e.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("expr_id").alias("dst"))
    one = e.sparkSession.createDataFrame([(bound, bound)], "origin long, node long")
    below = graph.closure(one, graph.step_over(edges)).select(F.col("node").alias("expr_id")).distinct()
    top = e.agg(F.max("expr_id")).first()[0]
    ids = refs.join(below, F.lit(True)).select("_ref", "expr_id", (F.lit(top) + F.row_number().over(Window.orderBy("_ref", "expr_id"))).alias("_new"))  # one variable's uses
    parent = ids.select("_ref", F.col("expr_id").alias("parent_id"), F.col("_new").alias("_parent"))
    copies = e.join(ids, "expr_id").join(parent, ["_ref", "parent_id"], "left").withColumn("parent_id", F.coalesce("_parent", "_ref")).withColumn("expr_id", F.col("_new")).select(*e.columns)
    return out | {"expr": changed.unionByName(copies)}


def inline_mac(t: Tables, macro_id: int) -> Tables:
    """Uses of a macro, expressions of kind ``macro`` with its name, become its ``text``; the macro vanishes.  Without a text it
    is refused if there are uses."""
    out = t | {"macro": t["macro"].where(F.col("macro_id") != macro_id)}
    if "expr" not in t:
        return out
    own = t["macro"].where(F.col("macro_id") == macro_id)
    named = (F.col("kind") == "macro") & (F.col("value") == F.col("_name"))
    if "text" not in own.columns:
        if not t["expr"].join(F.broadcast(own.select(F.col("name").alias("_name"))), named, "left_semi").isEmpty():
            raise Clash("the macro is used and its text isn't known")
        return out
    e = t["expr"].join(F.broadcast(own.select(F.col("name").alias("_name"), F.col("text").alias("_text"))), named, "left")  # one row
    e = e.withColumn("value", F.coalesce("_text", "value")).withColumn("kind", F.when(F.col("_name").isNotNull(), "inlined").otherwise(F.col("kind")))
    return out | {"expr": e.select(*t["expr"].columns)}


def rename(t: Tables, kind: str, node: int, name: str, ord: int | None = None) -> Tables:  # noqa: A002
    """Rename what stands at a position: the transformation for its class."""
    if kind == "field":
        return rename_recfield(t, node, ord, name)
    known = {"module": rename_mod, "header": rename_header, "func": rename_fun, "macro": rename_mac, "record": rename_rec, "variable": rename_var}
    if kind not in known:
        raise ValueError(f"nothing to rename in a {kind}")
    return known[kind](t, node, name)


def upgrade_calls(calls: DataFrame, table: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """``calls (module, name, ...)`` with outdated functions replaced by a lookup table."""
    rows = [(a, b, c, d) for (a, b), (c, d) in table.items()]
    known = calls.sparkSession.createDataFrame(rows, "module string, name string, _m string, _n string")
    return calls.join(F.broadcast(known), ["module", "name"], "left").withColumn("module", F.coalesce("_m", "module")).withColumn("name", F.coalesce("_n", "name")).drop("_m", "_n").select(*calls.columns)
