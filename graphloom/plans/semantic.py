"""The semantic query language.

    query      = [start] sequence          start = name [filter]
    sequence   = { "." step } [":" statistic]
    step       = name [filter] | "{" sequence "}" n [filter] | "(" sequence ")" (n | "+") [filter]
    filter     = "[" or "]", with or < and < comparison < not; operands: "." sequence, name "in" "." sequence, literals

A sequence maps a set of entities to a set of entities; a property, and a statistic over it, can only end one.  Names
are resolved against the catalogue by the class reached so far: a property first, else a selector; in filters a bare
name is a property of the current class, else a literal.

Filters are evaluated for all nodes at once: a sub-query carries its node of origin along, and ends in a semi join or in
one aggregate for each origin.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import aggregations
from graphloom.operators import graph
from graphloom.plans.catalog import Catalog


class QueryError(ValueError):
    """A query that can't be read or doesn't fit the catalogue; ``code`` says which."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


# Fixed values of the language: its words, symbols and statistics.
WORDS = {"and": "and", "andalso": "and", "or": "or", "orelse": "or", "not": "not", "in": "in", "like": "like"}
COMPARATORS = ("=:=", "=/=", "==", "/=", ">=", "=<", "<", ">", "=")
SYMBOLS = "[].+{}():?"
TOKEN = re.compile(r"""(?P<space>[ \t]+)|(?P<int>[0-9]+)|(?P<name>[a-z@][A-Za-z0-9_@]*)|'(?P<quoted>[^']*)'|"(?P<string>[^"]*)"|(?P<op>=:=|=/=|==|/=|>=|=<|<|>|=)|(?P<sep>[,;])|(?P<sym>[\[\].+{}():?])""")


def lex(text: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError("scanner", f"{text[at]!r} at {at}")
        at = m.end()
        kind, value = m.lastgroup, m.group(m.lastgroup)
        if kind == "int":
            out.append(("int", int(value)))
        elif kind in ("name", "quoted"):
            out.append((WORDS[value], value) if value in WORDS else ("name", value))
        elif kind == "string":
            out.append(("string", value))
        elif kind == "op":
            out.append(("op", "==" if value == "=" else value))
        elif kind == "sep":
            out.append(("and" if value == "," else "or", value))
        elif kind == "sym":
            out.append((value, value))
    return out


@dataclass(frozen=True)
class Step:
    name: str
    filter: object = None


@dataclass(frozen=True)
class Repeat:
    """``{...}n`` (exactly n times), ``(...)n`` (1 to n times) or ``(...)+`` (``times`` is None)."""

    closure: bool
    body: Sequence
    times: int | None
    filter: object = None


@dataclass(frozen=True)
class Sequence:
    steps: tuple
    statistic: str | None = None


@dataclass(frozen=True)
class Query:
    start: Step | None
    sequence: Sequence


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class In:
    name: str
    sequence: Sequence


@dataclass(frozen=True)
class Literal:
    kind: str
    value: object


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = lex(text), 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else "end"

    def take(self, kind: str) -> object:
        if self.peek() != kind:
            raise QueryError("parser", f"{kind} is expected, there is {self.peek()}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def query(self) -> Query:
        start = None
        if self.peek() == "name":
            start = Step(self.take("name"), self.bracket())
            sequence = self.sequence() if self.peek() == "." else Sequence(())
        else:
            sequence = self.sequence()
        self.take("end") if self.peek() != "end" else None
        return Query(start, sequence)

    def sequence(self, dot: bool = True) -> Sequence:
        steps = []
        if dot:
            self.take(".")
        steps.append(self.step())
        while self.peek() == ".":
            self.take(".")
            steps.append(self.step())
        statistic = None
        if self.peek() == ":":
            self.take(":")
            statistic = self.take("name")
        return Sequence(tuple(steps), statistic)

    def step(self) -> object:
        if self.peek() == "name":
            return Step(self.take("name"), self.bracket())
        if self.peek() == "{":
            self.take("{")
            body = self.sequence(dot=False)
            self.take("}")
            return Repeat(False, body, self.take("int"), self.bracket())
        self.take("(")
        body = self.sequence(dot=False)
        self.take(")")
        if self.peek() == "+":
            self.take("+")
            return Repeat(True, body, None, self.bracket())
        return Repeat(True, body, self.take("int"), self.bracket())

    def bracket(self) -> object:
        if self.peek() != "[":
            return None
        self.take("[")
        out = self.either()
        self.take("]")
        return out

    def either(self) -> object:
        left = self.both()
        if self.peek() == "or":
            self.at += 1
            return Binary("or", left, self.either())
        return left

    def both(self) -> object:
        left = self.comparison()
        if self.peek() == "and":
            self.at += 1
            return Binary("and", left, self.both())
        return left

    def comparison(self) -> object:
        left = self.negation()
        if self.peek() in ("op", "like"):
            op = self.take(self.peek())
            return Binary(op, left, self.negation())
        return left

    def negation(self) -> object:
        if self.peek() == "not":
            self.at += 1
            return Not(self.negation())
        return self.operand()

    def operand(self) -> object:
        if self.peek() == "(":
            self.take("(")
            out = self.either()
            self.take(")")
            return out
        if self.peek() == ".":
            return self.sequence()
        if self.peek() == "name":
            name = self.take("name")
            if self.peek() == "in":
                self.take("in")
                return In(name, self.sequence())
            return Literal("name", name)
        if self.peek() in ("int", "string"):
            kind = self.peek()
            return Literal(kind, self.take(kind))
        raise QueryError("parser", f"an operand is expected, there is {self.peek()}")


def parse(text: str) -> Query:
    return Parser(text).query()


def unparse(node: object) -> str:
    """The text of a tree; parsing it gives the tree again."""
    if node is None:
        return ""
    square = lambda f: f"[{unparse_operand(f)}]" if f is not None else ""
    match node:
        case Query():
            head = unparse(node.start)
            return head + ("." + unparse(node.sequence) if node.sequence.steps else "")
        case Sequence():
            return ".".join(map(unparse, node.steps)) + (f":{node.statistic}" if node.statistic else "")
        case Step():
            return node.name + square(node.filter)
        case Repeat():
            a, b = "()" if node.closure else "{}"
            return a + unparse(node.body) + b + ("+" if node.times is None else str(node.times)) + square(node.filter)
        case Binary():
            part = lambda x: f"({unparse_operand(x)})" if isinstance(x, Binary) else unparse_operand(x)
            return f"{part(node.left)} {node.op} {part(node.right)}"
        case Not():
            return f"not {unparse_operand(node.of) if not isinstance(node.of, Binary) else f'({unparse(node.of)})'}"
        case In():
            return f"{node.name} in .{unparse(node.sequence)}"
        case Literal():
            return f'"{node.value}"' if node.kind == "string" else str(node.value)
    raise TypeError(type(node))


def unparse_operand(node: object) -> str:
    return f".{unparse(node)}" if isinstance(node, Sequence) else unparse(node)


#: How values of unlike kinds compare: numbers before names before strings.
RANK = {"number": 0, "name": 1, "string": 2}


@dataclass
class Found:
    """A class reached, its ``(origin, node)`` rows, and the values if a property ended the sequence."""

    entity: str
    rows: DataFrame
    property: str | None = None


class Compiler:
    def __init__(self, catalog: Catalog, like: str = "regex") -> None:
        self.catalog, self.like = catalog, like

    def run(self, query: Query | str, context: tuple[str, DataFrame] | None = None, mode: str = "compatible") -> DataFrame:
        """The result of a query.  Entities: ``(node)``, a set.  A property: ``(node, value)``.  A statistic: its
        aggregation's shape.  A query without a start needs ``context``, an entity's name and ``(node)``."""
        query = parse(query) if isinstance(query, str) else query
        if query.start is not None:
            if query.start.name not in self.catalog.starts:
                raise QueryError("unknown", f"no initial selection {query.start.name}")
            entity, nodes = self.catalog.starts[query.start.name]
            nodes = nodes()
        elif context is not None:
            entity, nodes = context
        else:
            raise QueryError("context", "a relative query needs a context")
        rows = nodes.select(F.col("node").alias("origin"), "node").distinct()
        found = Found(entity, rows)
        if query.start is not None:
            found = self.filtered(found, query.start.filter)
        found = self.sequence(found, query.sequence.steps)
        if query.sequence.statistic:
            return aggregations.avg(self.listed(found), mode) if query.sequence.statistic == "avg" else self.statistic(query.sequence.statistic, found)
        nodes = found.rows.select("node").distinct()
        if found.property is None:
            return nodes
        return nodes.join(self.catalog.entities[found.entity].values(found.property), "node")

    def listed(self, found: Found) -> DataFrame:
        if found.property is None:
            raise QueryError("statistic", "a statistic needs a property")
        values = self.catalog.entities[found.entity].values(found.property)
        rows = found.rows.select("node").distinct().join(values, "node")
        return rows.select(F.col("node").alias("ord"), F.col("node").cast("string").alias("name"), "value", F.lit(True).alias("found"))

    def statistic(self, name: str, found: Found) -> DataFrame:
        if name not in aggregations.NAMES:
            raise QueryError("statistic", f"unknown statistic {name}")
        return aggregations.apply(name, self.listed(found))

    def sequence(self, found: Found, steps: tuple) -> Found:
        for step in steps:
            if found.property is not None:
                raise QueryError("type", f"nothing follows the property {found.property}")
            found = self.repeat(found, step) if isinstance(step, Repeat) else self.step(found, step)
        return found

    def step(self, found: Found, step: Step) -> Found:
        entity = self.catalog.entities[found.entity]
        if entity.has(step.name):
            if step.filter is not None:
                raise QueryError("type", f"the property {step.name} takes no filter")
            return Found(found.entity, found.rows, step.name)
        if (found.entity, step.name) not in self.catalog.selectors:
            raise QueryError("unknown", f"{found.entity} has neither a property nor a selector {step.name}")
        target, pairs = self.catalog.selectors[found.entity, step.name]
        moved = graph.step_over(pairs())(found.rows).distinct()
        return self.filtered(Found(target, moved), step.filter)

    def repeat(self, found: Found, step: Repeat) -> Found:
        if step.body.statistic:
            raise QueryError("type", "a statistic can't be repeated")

        def once(rows: DataFrame) -> DataFrame:
            after = self.sequence(Found(found.entity, rows), step.body.steps)
            if after.property is not None or after.entity != found.entity:
                raise QueryError("type", "what repeats must end in the class that it starts from")
            return after.rows

        if not step.closure:
            rows = graph.iterate(found.rows, once, step.times)
        elif step.times == 0:
            rows = found.rows.where("false")
        else:
            rows = graph.closure(found.rows, once, step.times)
        return self.filtered(Found(found.entity, rows), step.filter)

    def filtered(self, found: Found, condition: object) -> Found:
        if condition is None:
            return found
        nodes = found.rows.select("node").distinct()
        table, column = self.condition(found.entity, nodes, condition)
        right = table.where(F.coalesce(column, F.lit(False))).select("node")
        return Found(found.entity, found.rows.join(right, "node", "left_semi").select("origin", "node"))

    # A condition adds columns to the table of nodes and gives a Column over them.
    def condition(self, entity: str, table: DataFrame, node: object) -> tuple[DataFrame, Column]:
        match node:
            case Binary(op, left, right) if op in ("and", "or"):
                table, a = self.condition(entity, table, left)
                table, b = self.condition(entity, table, right)
                a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
                return table, a & b if op == "and" else a | b
            case Not(of):
                table, a = self.condition(entity, table, of)
                return table, ~F.coalesce(a, F.lit(False))
            case Binary(op, left, right):
                table, a, kind_a = self.value(entity, table, left)
                table, b, kind_b = self.value(entity, table, right)
                return table, self.compare(op, a, kind_a, b, kind_b)
            case In(name, sequence):
                inner = self.relative(entity, table, sequence)
                if inner.property is None:
                    raise QueryError("type", "in needs a property on its right")
                values = self.catalog.entities[inner.entity].values(inner.property)
                right = inner.rows.join(values, "node").select(F.col("origin").alias("node"), F.col("value").cast("string").alias("value"))
                own = table.join(self.property(entity, name), "node").select("node", F.col("value").cast("string").alias("value"))
                return self.flag(table, own.join(right, ["node", "value"], "left_semi").select("node"))
            case Sequence():
                inner = self.relative(entity, table, node)
                if node.statistic:
                    raise QueryError("type", "a statistic is no condition by itself")
                return self.flag(table, inner.rows.select(F.col("origin").alias("node")))
            case Literal("name", name):
                if name in ("true", "false") and not self.catalog.entities[entity].has(name):
                    return table, F.lit(name == "true")
                table, column, _ = self.value(entity, table, node)
                return table, column.cast("boolean")
        raise QueryError("type", f"{unparse_operand(node)} is no condition")

    def fresh(self, table: DataFrame) -> str:
        return f"_c{len(table.columns)}"

    def flag(self, table: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Column]:
        name = self.fresh(table)
        return table.join(nodes.distinct().withColumn(name, F.lit(True)), "node", "left"), F.coalesce(F.col(name), F.lit(False))

    def property(self, entity: str, name: str) -> DataFrame:
        if not self.catalog.entities[entity].has(name):
            raise QueryError("unknown", f"{entity} has no property {name}")
        return self.catalog.entities[entity].values(name)

    def relative(self, entity: str, table: DataFrame, sequence: Sequence) -> Found:
        rows = table.select(F.col("node").alias("origin"), "node")
        return self.sequence(Found(entity, rows), sequence.steps)

    def kind_of(self, df: DataFrame) -> str:
        return "number" if df.schema["value"].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") else "name"

    def value(self, entity: str, table: DataFrame, node: object) -> tuple[DataFrame, Column, str]:
        match node:
            case Literal("int", v):
                return table, F.lit(v), "number"
            case Literal("string", v):
                return table, F.lit(v), "string"
            case Literal("name", name):
                if not self.catalog.entities[entity].has(name):
                    return table, F.lit(name), "name"
                values = self.property(entity, name)
                column = self.fresh(table)
                return table.join(values.withColumnRenamed("value", column), "node", "left"), F.col(column), self.kind_of(values)
            case Sequence():
                inner = self.relative(entity, table, node)
                if inner.property is None:
                    raise QueryError("type", "entities can't be compared")
                values = self.catalog.entities[inner.entity].values(inner.property)
                met = inner.rows.join(values, "node")
                per = {"sum": F.coalesce(F.sum("value"), F.lit(0)), "max": F.max("value"), "min": F.min("value"), "avg": F.try_divide(F.sum("value"), F.count_if(F.col("value") != 0)), None: F.max("value")}
                if node.statistic not in per:
                    raise QueryError("type", f"{node.statistic} gives no single value")
                column = self.fresh(table)
                one = met.groupBy(F.col("origin").alias("node")).agg(per[node.statistic].alias(column))
                out = table.join(one, "node", "left")
                return out, F.coalesce(F.col(column), F.lit(0)) if node.statistic == "sum" else F.col(column), self.kind_of(values)
            case Binary() | Not() | In():
                table, column = self.condition(entity, table, node)
                return table, F.when(column, "true").otherwise("false"), "name"
        raise QueryError("type", f"{node} has no value")

    def compare(self, op: str, a: Column, kind_a: str, b: Column, kind_b: str) -> Column:
        if op == "like":
            return self.alike(a.cast("string"), b.cast("string"))
        texts = ("name", "string")
        if kind_a in texts and kind_b in texts:
            a, b, kind_b = a.cast("string"), b.cast("string"), kind_a
        if kind_a != kind_b:
            below = F.lit(RANK[kind_a] < RANK[kind_b])
            fixed = {"==": F.lit(False), "=:=": F.lit(False), "/=": F.lit(True), "=/=": F.lit(True), "<": below, "=<": below, ">": ~below, ">=": ~below}
            return F.when(a.isNotNull() & b.isNotNull(), fixed[op])
        return {"==": a == b, "=:=": a == b, "/=": a != b, "=/=": a != b, "<": a < b, "=<": a <= b, ">": a > b, ">=": a >= b}[op]

    def alike(self, a: Column, b: Column) -> Column:
        if self.like == "regex":
            return F.rlike(a, b)
        if self.like == "substring":
            return F.contains(a, b)
        if self.like == "distance":
            return F.levenshtein(a, b) <= 2
        raise QueryError("like", f"unknown kind {self.like}")
