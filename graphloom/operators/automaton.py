"""State machines: extraction from code, and from event logs.

Returned values come as ``returns (fun, tag, state_kind, state, callee)``: the first element of a returned tuple, what
kind of expression its state is, its name, or the function whose returns count instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.sources.shared import keep


def start_states(functions: DataFrame) -> DataFrame:
    """``init/1`` and exported functions but ``start_link``."""
    return functions.where("(name = 'init' AND arity = 1) OR (exported AND name <> 'start_link')").select("fun_id", "name").distinct()


def classify(returns: DataFrame) -> DataFrame:
    """``(fun, outcome, state)``: ``next`` with a state, ``stop``, ``follow`` a callee, or ``ignore``.

    Tuples tagged ok or next_state have their state second, reply third; stop ends.
    """
    outcome = F.when(F.col("tag").isin("ok", "next_state", "reply"), "next").when(F.col("tag") == "stop", "stop").when(F.col("callee").isNotNull(), "follow").otherwise("ignore")
    state = F.when(F.col("tag") == "reply", F.col("third")).when(F.col("tag").isin("ok", "next_state"), F.col("second"))
    return returns.select("fun", outcome.alias("outcome"), F.when(outcome == "next", state).alias("state"), F.when(outcome == "follow", F.col("callee")).alias("callee"))


def resolve(states: DataFrame, flow: DataFrame, atoms: DataFrame) -> DataFrame:
    """``(expr, state)``: atoms name themselves, variables stand for the atoms that flow into them, others for nothing.
    ``states (expr, kind, value)``, ``flow (src, dst)``, ``atoms (expr, value)``."""
    named = states.where("kind = 'atom'").select("expr", F.col("value").alias("state"))
    variables = states.where("kind = 'variable'").select(F.col("expr").alias("origin"), F.col("expr").alias("node"))
    back = graph.closure(variables, graph.step_over(graph.backward(flow)))
    found = back.join(atoms.select(F.col("expr").alias("node"), F.col("value").alias("state")), "node").select(F.col("origin").alias("expr"), "state")
    return named.union(found).distinct()


def state_function(states: DataFrame, functions: DataFrame) -> DataFrame:
    """``(state, fun_id)``: the function of a state's name with two arguments, else with three."""
    f = functions.where("arity IN (2, 3)").groupBy("name").agg(F.min_by("fun_id", F.struct("arity", "fun_id")).alias("fun_id"))
    return states.select("state").distinct().join(f, F.col("state") == F.col("name"), "left").select("state", "fun_id")


def explore(starts: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States that ``starts (state)`` reach and the transitions among them; ``moves (src, dst)``."""
    rows = starts.select(F.lit(0).alias("origin"), F.col("state").alias("node"))
    found = keep(graph.closure(rows, graph.step_over(moves)).select("node").union(starts.select("state")).distinct(), "states")
    return found, graph.induced(moves, found)


def event_transitions(events: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """``(src, dst, n)``: the moves between the states of consecutive events of one key."""
    after = F.lead(state).over(Window.partitionBy(by).orderBy(*order))
    moves = events.select(F.col(state).alias("src"), after.alias("dst")).where("dst IS NOT NULL")
    return moves.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def event_ends(events: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """``(key, first, last)`` states of each key."""
    place = F.struct(*order)
    return events.groupBy(by).agg(F.min_by(state, place).alias("first"), F.max_by(state, place).alias("last"))
