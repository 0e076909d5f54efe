"""Type signatures of functions, inferred from their clauses.

A type is ``(kind, value)``: the whole kind if the value is ``ANY``, else a literal, a tuple of element types (kind ``tuple``),
``(element, tail)`` (kind ``list``), the alternatives (kind ``union``), a name (kind ``variable``).  Functions come as JSON
trees: ``{"name", "arity", "clauses": [{"patterns": [expr], "guard": expr or null, "body": [expr]}]}`` with expressions
``{"kind", "value", "children", "clauses"}``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph

ANY = "any"
Type = tuple[str, object]
Env = dict[str, Type]


def whole(kind: str) -> Type:
    return kind, ANY


TOP, NONE = whole("any"), whole("none")


def union(*types: Type) -> Type:
    """The alternatives without repeats in a row; one alternative is itself, any absorbs all."""
    flat = [t for u in types for t in (u[1] if u[0] == "union" else (u,))]
    if TOP in flat:
        return TOP
    out = [t for i, t in enumerate(flat) if t != NONE and (not i or t != flat[i - 1])]
    return NONE if not out else out[0] if len(out) == 1 else ("union", tuple(out))


NUMBER, INT, FLOAT, LIST = union(whole("int"), whole("float")), whole("int"), whole("float"), whole("list")
BOOL = union(("atom", "true"), ("atom", "false"))

# Operand and result types of operators.
INFIX: dict[str, tuple[Type, Type, Type]] = {
    "+": (NUMBER, NUMBER, NUMBER), "-": (NUMBER, NUMBER, NUMBER), "*": (NUMBER, NUMBER, NUMBER), "/": (NUMBER, NUMBER, FLOAT),
    "div": (INT, INT, INT), "rem": (INT, INT, INT), "band": (INT, INT, INT), "bor": (INT, INT, INT), "bxor": (INT, INT, INT), "bsl": (INT, INT, INT), "bsr": (INT, INT, INT),
    "and": (TOP, TOP, BOOL), ",": (TOP, TOP, BOOL), ";": (TOP, TOP, BOOL), "or": (TOP, TOP, BOOL), "xor": (TOP, TOP, BOOL),
    "orelse": (BOOL, TOP, TOP), "andalso": (BOOL, TOP, TOP), "++": (LIST, LIST, LIST),
}
PREFIX: dict[str, tuple[Type, Type]] = {"+": (NUMBER, NUMBER), "-": (NUMBER, NUMBER), "bnot": (INT, INT), "not": (BOOL, BOOL)}
# What a type test in a guard says.
GUARDS: dict[str, Type] = {
    "is_integer": INT, "is_float": FLOAT, "is_number": NUMBER, "is_atom": whole("atom"), "is_boolean": BOOL, "is_list": LIST, "is_tuple": whole("tuple"),
    "is_binary": whole("binary"), "is_bitstring": whole("bitstring"), "is_pid": whole("pid"), "is_port": whole("port"), "is_reference": whole("reference"), "is_function": whole("funsig"), "is_record": whole("tuple"),
}


def meet(a: Type, b: Type, env: Env | None = None) -> Type:
    """What both types allow; ``NONE`` if nothing.  Variables are replaced by what is known of them and narrowed."""
    env = {} if env is None else env
    for x, y in ((a, b), (b, a)):
        if x[0] == "variable":
            got = meet(env.get(x[1], TOP), y, env)
            if got != NONE:
                env[x[1]] = got
            return got
    if a[0] == "any":
        return b
    if b[0] == "any":
        return a
    if a[0] == "union":
        return union(*(meet(x, b, env) for x in a[1]))
    if b[0] == "union":
        return union(*(meet(a, x, env) for x in b[1]))
    if a[0] != b[0]:
        return NONE
    if a[1] == ANY or b[1] == ANY:
        return b if a[1] == ANY else a
    if a[0] == "tuple":
        if len(a[1]) != len(b[1]):
            return NONE
        parts = tuple(meet(x, y, env) for x, y in zip(a[1], b[1], strict=True))
        return NONE if NONE in parts else ("tuple", parts)
    if a[0] == "list":
        parts = tuple(meet(x, y, env) for x, y in zip(a[1], b[1], strict=True))
        return NONE if NONE in parts else ("list", parts)
    return a if a[1] == b[1] else NONE


def settle(t: Type, env: Env) -> Type:
    """A type without variables."""
    if t[0] == "variable":
        return settle(env.get(t[1], TOP), {k: v for k, v in env.items() if k != t[1]})
    if t[0] in ("tuple", "list") and t[1] != ANY:
        return t[0], tuple(settle(x, env) for x in t[1])
    return union(*(settle(x, env) for x in t[1])) if t[0] == "union" else t


class Inference:
    """Signatures of the functions of one group, which may call each other; ``known`` are signatures from outside."""

    def __init__(self, functions: list[dict], known: dict[tuple[str, int], list] | None = None) -> None:
        self.functions = {(f["name"], f["arity"]): f for f in functions}
        self.found: dict[tuple[str, int], list] = dict(known or {})
        self.busy: set = set()

    def signatures(self, key: tuple[str, int]) -> list[tuple[tuple[Type, ...], Type]]:
        """``(arguments, result)`` for each clause; a function not in the group takes and gives anything, and so does
        one that is being inferred."""
        if key in self.found:
            return self.found[key]
        if key not in self.functions or key in self.busy:
            return [((TOP,) * key[1], TOP)]
        self.busy.add(key)
        out = []
        for clause in self.functions[key]["clauses"]:
            env: Env = {}
            args = [self.type(p, env) for p in clause["patterns"]]
            if clause.get("guard"):
                env = self.guarded(clause["guard"], env)
            result = TOP
            for e in clause["body"]:
                result = self.type(e, env)
            out.append((tuple(settle(a, env) for a in args), settle(result, env)))
        self.busy.discard(key)
        self.found[key] = out
        return out

    def guarded(self, g: dict, env: Env) -> Env:
        """What a guard that holds says of variables; alternatives are looked at apart and united."""
        if g["kind"] == "infix_expr" and g["value"] in (",", "and", "andalso"):
            for part in g["children"]:
                env = self.guarded(part, env)
            return env
        if g["kind"] == "infix_expr" and g["value"] in (";", "or", "orelse"):
            parts = [self.guarded(p, dict(env)) for p in g["children"]]
            return {k: union(*(p.get(k, TOP) for p in parts)) for k in {k for p in parts for k in p}}
        if g["kind"] == "application" and g["value"] in GUARDS and g["children"] and g["children"][0]["kind"] == "variable":
            name = g["children"][0]["value"]
            return env | {name: meet(env.get(name, TOP), GUARDS[g["value"]])}
        return env

    def type(self, e: dict, env: Env) -> Type:
        kind, value, kids = e["kind"], e.get("value"), e.get("children") or []
        if kind == "integer":
            return "int", int(value)
        if kind == "float":
            return "float", float(value)
        if kind in ("atom", "string"):
            return kind, value
        if kind == "variable":
            env.setdefault(value, TOP)
            return "variable", value
        if kind == "tuple":
            return "tuple", tuple(self.type(k, env) for k in kids)
        if kind == "cons":
            if not kids:
                return LIST
            return "list", (union(*(settle(self.type(k, env), env) for k in kids[:1])), self.type(kids[1], env) if len(kids) > 1 else LIST)
        if kind == "parenthesis":
            return self.type(kids[0], env)
        if kind == "match_expr":
            left, right = self.type(kids[0], env), self.type(kids[1], env)
            meet(left, right, env)
            return right
        if kind == "infix_expr":
            a, b, out = INFIX.get(value, (TOP, TOP, TOP))
            meet(self.type(kids[0], env), a, env)
            meet(self.type(kids[1], env), b, env)
            return out
        if kind == "prefix_expr":
            a, out = PREFIX.get(value, (TOP, TOP))
            meet(self.type(kids[0], env), a, env)
            return out
        if kind == "application":
            args = [settle(self.type(k, env), env) for k in kids]
            fits = [r for a, r in self.signatures((value, len(kids))) if all(meet(x, y) != NONE for x, y in zip(a, args, strict=True))]
            return union(*fits) if fits else NONE
        if kind in ("case_expr", "if_expr"):
            out = []
            for clause in e.get("clauses", []):
                inner = dict(env)
                for k in clause.get("patterns", []):
                    t = self.type(k, inner)
                    if kind == "case_expr" and kids:
                        meet(t, settle(self.type(kids[0], inner), inner), inner)
                inner = self.guarded(clause["guard"], inner) if clause.get("guard") else inner
                result = TOP
                for b in clause["body"]:
                    result = self.type(b, inner)
                out.append(settle(result, inner))
            return union(*out) if out else TOP
        return TOP


def show(t: Type) -> str:
    kind, value = t
    if kind == "union":
        return " | ".join(map(show, value))
    if kind == "tuple" and value != ANY:
        return "{" + ", ".join(map(show, value)) + "}"
    if kind == "list" and value != ANY:
        return f"[{show(value[0])}]" if value else "[]"
    if isinstance(value, tuple):
        return f"{kind}({', '.join(map(show, value))})"
    return f"{kind}()" if value == ANY else f'"{value}"' if kind == "string" else str(value)


def pretty(name: str, arity: int, signatures: list) -> str:
    """``name/arity :: (arguments) -> result``, clauses apart by semicolons."""
    return f"{name}/{arity} :: " + "; ".join(f"({', '.join(map(show, a))}) -> {show(r)}" for a, r in signatures)


def infer(functions: DataFrame) -> DataFrame:
    """``(module, name, arity, signature)`` of ``functions (module, name, arity, tree)``; a module's functions are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = Inference([json.loads(t) for t in pdf.tree])
        return pd.DataFrame([(r.module, r.name_, r.arity, pretty(r.name_, r.arity, group.signatures((r.name_, r.arity)))) for r in pdf.rename(columns={"name": "name_"}).itertuples()], columns=["module", "name", "arity", "signature"])

    return functions.select("module", "name", "arity", "tree").groupBy("module").applyInPandas(run, "module string, name string, arity int, signature string")


def written(node, below: dict, rows: dict) -> Type:
    """The type that a written type expression stands for: ``rows`` has ``(type, tag)`` of each node, ``below`` its children."""
    kind, tag = rows[node]
    parts = below.get(node, [])
    if kind == "call":  # a type's name and the list of its arguments
        arguments = below.get(parts[1], []) if len(parts) > 1 else []
        return (rows[parts[0]][1], tuple(written(x, below, rows) for x in arguments) if arguments else ANY)
    if kind == "atom":
        return "atom", tag
    if kind in ("tuple", "list", "union"):
        return kind, tuple(written(x, below, rows) for x in parts)
    if kind in ("vardef", "paren"):  # a named type is its type, one in brackets is itself
        return written(parts[-1], below, rows)
    return TOP if kind == "joker" else whole("not_implemented_yet")


def specs(forms: DataFrame, typexp: DataFrame) -> DataFrame:
    """``(module, name, arity, signature, warning)`` of written specifications.

    ``forms (form_id, module, head_id, sig_id)`` name the type expressions of a specification's function (an atom, or a
    module and a name) and of its signature (an argument list and a result); ``typexp (id, parent_id, ord, type, tag)`` has
    them all.  A head that names another module is kept with a warning.  Each specification is put together apart.
    """
    tops = forms.select("form_id", "module", "head_id", "sig_id", F.explode(F.array("head_id", "sig_id")).alias("root"))
    under = graph.roots(typexp.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst")))
    nodes = under.select("root", F.col("node").alias("id")).union(tops.select("root", F.col("root").alias("id")))
    rows = nodes.join(tops, "root").join(typexp.select("id", "parent_id", "ord", "type", "tag"), "id")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        known = {r.id: (r.type, r.tag) for r in pdf.itertuples()}
        below: dict = {}
        for r in pdf.sort_values(["ord", "id"]).itertuples():
            if pd.notna(r.parent_id):
                below.setdefault(int(r.parent_id), []).append(r.id)
        module, head, sig = pdf.module.iloc[0], int(pdf.head_id.iloc[0]), int(pdf.sig_id.iloc[0])
        stated, name = (known[x][1] for x in below[head]) if known[head][0] == "module_qualifier" else (None, known[head][1])
        arguments, result = below[sig]
        types = tuple(written(x, below, known) for x in below.get(arguments, []))
        warning = f"the specification names module {stated}" if stated not in (None, module) else None
        return pd.DataFrame([(module, name, len(types), pretty(name, len(types), [(types, written(result, below, known))]), warning)], columns=["module", "name", "arity", "signature", "warning"])

    return rows.groupBy("form_id").applyInPandas(build, "module string, name string, arity int, signature string, warning string")


def operator_table() -> Iterator[tuple[str, str, str, str, str]]:
    """``(form, operator, left, right, result)`` of all known operators."""
    for op, (a, b, r) in INFIX.items():
        yield "infix", op, show(a), show(b), show(r)
    for op, (a, r) in PREFIX.items():
        yield "prefix", op, "", show(a), show(r)
