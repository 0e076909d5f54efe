"""The metric query language: ``show METRIC for module ('a','b') [aggregation]``, ``show METRIC for function ({'m','f',1})``, ``show
metrics``, ``show filters``.  ``save`` and ``compare`` are read and refused."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import aggregations

TOKEN = re.compile(r"(?P<skip>[\x00-\x20]+|%[^\n]*)|(?P<int>[0-9]+)|'(?P<name>[a-z][A-Za-z0-9_]*)'|(?P<word>[a-z][A-Za-z0-9_]*)|(?P<sym>[(){},])")


class MetricError(ValueError):
    """``code``: scanner, parser, bad_command, bad_filter, unknown_metric, wrong_type or missing."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Show:
    metric: str
    scope: str
    names: tuple  # of names, or of (module, function, arity)
    aggregation: str = "tolist"


@dataclass(frozen=True)
class Help:
    what: str


def lex(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise MetricError("scanner", f"{text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup != "skip":
            value = m.group(m.lastgroup)
            out.append((m.lastgroup if m.lastgroup != "sym" else value, int(value) if m.lastgroup == "int" else value))
    return out


def parse(text: str) -> Show | Help:
    tokens = [*lex(text), ("end", "")]
    at = 0

    def take(kind: str, value: str | None = None) -> object:
        nonlocal at
        if tokens[at][0] != kind or value is not None and tokens[at][1] != value:
            raise MetricError("parser", f"{value or kind} is expected, there is {tokens[at][1] or 'the end'}")
        at += 1
        return tokens[at - 1][1]

    def ident(scope: str) -> object:
        if scope == "module":
            return take("name")
        take("{")
        mod = take("name")
        take(",")
        fun = take("name")
        take(",")
        arity = take("int")
        take("}")
        return mod, fun, arity

    def listing(scope: str) -> tuple:
        take("(")
        out = [ident(scope)]
        while tokens[at][0] == ",":
            take(",")
            out.append(ident(scope))
        take(")")
        return tuple(out)

    command = take("word")
    if command == "show" and tokens[at][1] in ("metrics", "filters") and tokens[at + 1][0] == "end":
        return Help(tokens[at][1])
    if command == "show":
        metric = take("word")
        take("word", "for")
        scope = take("word")
        if scope not in ("module", "function"):
            raise MetricError("parser", f"module or function is expected, there is {scope}")
        names = listing(scope)
        aggregation = "tolist" if tokens[at][0] == "end" else take("word")
        take("end")
        return Show(metric, scope, names, aggregation)
    if command == "compare":
        listing(take("word"))
        take("end")
        raise MetricError("bad_command", "compare isn't implemented")
    if command == "save":
        take("name")
        take("word", "for")
        take("word")
        if tokens[at][0] == "(":
            listing("module")
        raise MetricError("bad_command", "save isn't implemented")
    raise MetricError("parser", f"unknown command {command}")


class Evaluator:
    """Runs commands over metric tables: ``metrics[name]`` is ``(scopes, function of the scope giving (node, value))``; ``modules (node,
    name)`` and ``functions (node, module, name, arity)`` find what is named."""

    def __init__(self, spark: SparkSession, modules: DataFrame, functions: DataFrame, metrics: dict, hidden: tuple[str, ...] = ("module_sum",)) -> None:
        self.spark, self.modules, self.functions, self.metrics, self.hidden = spark, modules, functions, metrics, hidden

    def run(self, command: str | Show | Help) -> DataFrame:
        command = parse(command) if isinstance(command, str) else command
        if isinstance(command, Help):
            names = [m for m in self.metrics if m not in self.hidden] if command.what == "metrics" else list(aggregations.NAMES)
            return self.spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, name string")
        if command.metric not in self.metrics:
            raise MetricError("unknown_metric", command.metric)
        if command.aggregation not in aggregations.NAMES:
            raise MetricError("bad_filter", command.aggregation)
        scopes, table = self.metrics[command.metric]
        if command.scope not in scopes:
            raise MetricError("wrong_type", f"{command.metric} isn't for a {command.scope}")
        return aggregations.apply(command.aggregation, self.rows(command, table(command.scope)))

    def rows(self, command: Show, values: DataFrame) -> DataFrame:
        """``(ord, name, value, found)``: listed names in order, repeats kept; a missing node has no value."""
        if command.scope == "module":
            asked = self.spark.createDataFrame([(i, n) for i, n in enumerate(command.names)], "ord int, name string")
            found = F.broadcast(asked).join(self.modules.select("node", F.col("name").alias("_n")), F.col("name") == F.col("_n"), "left")
        else:
            asked = self.spark.createDataFrame([(i, m, f, a, f"{m}:{f}/{a}") for i, (m, f, a) in enumerate(command.names)], "ord int, _m string, _f string, _a int, name string")
            mods = self.modules.select(F.col("name").alias("_module"))
            known = asked.join(mods, F.col("_m") == F.col("_module"), "left_anti").limit(1).collect()
            if known:
                raise MetricError("missing", f"no module {known[0]['_m']}")
            f = self.functions
            found = F.broadcast(asked).join(f.select("node", "module", F.col("name").alias("_n"), "arity"), (F.col("_m") == F.col("module")) & (F.col("_f") == F.col("_n")) & (F.col("_a") == F.col("arity")), "left")
        rows = found.select("ord", "name", "node").join(values.select("node", "value"), "node", "left")
        return rows.select("ord", "name", "value", F.col("node").isNotNull().alias("found"))

    def render(self, command: str) -> DataFrame:
        """The result as lines of text."""
        show = parse(command)
        out = self.run(show)
        if isinstance(show, Help):
            return out.select(F.col("name").alias("line"))
        if show.aggregation == "tolist":
            return out.select("ord", F.when(F.col("found"), F.format_string(f"{show.metric} of the '%s' is %s", "name", F.col("value").cast("string"))).otherwise(F.format_string("'%s' is not found", "name")).alias("line"))
        if show.aggregation == "fmaxname":
            return out.select(F.format_string("fmaxname is (%s with %s)", "name", F.col("value").cast("string")).alias("line"))
        if show.aggregation == "maxlist":
            one = F.format_string("(%s %s)", "name", F.col("value").cast("string"))
            return out.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"]), ", ").alias("line"))
        return out.select(F.format_string(f"{show.aggregation} is %s", F.col("value").cast("string")).alias("line"))
