"""Reachability, paths, cycles, components and contraction over edges ``(src, dst)``.

Loops keep a frontier apart from what has been visited, write both to shared storage each round, and stop when
nothing is new.  Nothing is collected but counts, except where a docstring bounds it.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import longest
from graphloom.sources.shared import drop, keep

Step = Callable[[DataFrame], DataFrame]
LAZY_STEPS = 4
#: A graph of so many edges (16 MB) is sent to all tasks; larger ones are joined.
HELD_EDGES = 1_000_000
FLUSH = 500_000
#: A strong component whose longest paths take more steps of a search is solved by linear programs, in so many tasks.
SEARCH_STEPS = 2_000_000
PIECES = 64


def step_over(edges: DataFrame) -> Step:
    """A step along ``edges``: ``(origin, node)`` to ``(origin, node)``."""
    hops = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(hops, F.col("node") == F.col("_from")).select("origin", F.col("_to").alias("node"))

    step.edges = edges
    return step


def backward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def iterate(starts: DataFrame, step: Step, n: int) -> DataFrame:
    """``(origin, node)`` after exactly ``n`` steps, as a set: one lazy plan of ``n`` joins."""
    now = starts.select("origin", "node").distinct()
    for _ in range(n):
        now = step(now).distinct()
    return now


def closure(starts: DataFrame, step: Step, most: int | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``(origin, node)`` reachable in one step or more, in at most ``most`` steps if given.  The origin itself is a result
    only if it is reached again.  A few steps are one lazy plan, whose rounds share their exchanges; only more are written.
    Without a bound, a graph of at most ``HELD_EDGES`` edges is walked from each origin inside the tasks, in one pass."""
    if most is not None and most <= LAZY_STEPS:
        now = starts.select("origin", "node").distinct()
        found = None
        for _ in range(most):
            now = step(now).distinct()
            found = now if found is None else found.union(now)
        return now if found is None else found.distinct()
    if most is None and hasattr(step, "edges"):
        edges = keep(step.edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
        kinds = {edges.schema["src"].dataType, edges.schema["dst"].dataType, starts.schema["node"].dataType}
        if len(kinds) == 1 and kinds.pop().simpleString() in ("int", "bigint", "string") and edges.count() <= HELD_EDGES:
            return _walked(starts, edges)
        step = step_over(edges)
    frontier = keep(step(starts.select("origin", "node").distinct()).distinct(), "frontier")
    seen = frontier
    for n in range(2, (most or max_rounds) + 1):
        fresh = step(frontier).distinct().join(seen, ["origin", "node"], "left_anti")
        frontier = keep(fresh, "frontier")
        if frontier.isEmpty():
            return seen
        seen = keep(seen.union(frontier), "seen") if n % 4 == 0 else seen.union(frontier)
    if most is None:
        raise RuntimeError(f"the closure did not end in {max_rounds} rounds")
    return seen


def _walk(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    values, first, ends = held.value
    of = {v: i for i, v in enumerate(values.to_pylist())}
    first, ends = first.tolist(), ends.tolist()
    ahead = [ends[a:b] for a, b in zip(first, first[1:], strict=False)]
    for batch in batches:
        rows, codes = [], []
        for row, nodes in enumerate(batch.column(1).to_pylist()):
            seen: set = set()
            now = {of[n] for n in nodes if n in of}
            while now:
                now = set().union(*[ahead[n] for n in now]) - seen
                seen |= now
            rows += [row] * len(seen)
            codes += seen
            if len(codes) >= FLUSH:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), values.take(pa.array(codes, pa.int64()))], names=["origin", "node"])
                rows, codes = [], []
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), values.take(pa.array(codes, pa.int64()))], names=["origin", "node"])


def _walked(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """The closure over kept, distinct ``edges`` that every task can hold."""
    spark = edges.sparkSession
    table = edges.toArrow()  # at most HELD_EDGES rows
    coded = pa.concat_arrays([c for name in ("src", "dst") for c in table.column(name).chunks] or [pa.array([], table.schema.field("src").type)]).dictionary_encode()
    code, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), table.num_rows
    src, dst = code[:n], code[n:]
    first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(coded.dictionary)))])
    held = spark.sparkContext.broadcast((coded.dictionary, first, dst[np.argsort(src, kind="stable")]))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = starts.select("origin", "node").repartition(tasks, "origin").groupBy("origin").agg(F.collect_set("node").alias("nodes"))
    types = {c: starts.schema[c].dataType.simpleString() for c in ("origin", "node")}
    out = keep(rows.mapInArrow(partial(_walk, held=held), ", ".join(f"{c} {t}" for c, t in types.items())), "closure")
    drop(edges)
    return out


def reach(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``(src, dst)``: all pairs with a path of one edge or more."""
    starts = edges.select(F.col("src").alias("origin"), F.col("src").alias("node")).distinct()
    return closure(starts, step_over(edges), most).select(F.col("origin").alias("src"), F.col("node").alias("dst"))


def _parts(ahead: dict) -> Iterator[list]:
    """Strong components of the graph of all vertices' successors, those ahead first."""
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    for start in ahead:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        todo = [(start, iter(ahead[start]))]
        while todo:
            node, rest = todo[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    on.add(to)
                    todo.append((to, iter(ahead[to])))
                    break
                if to in on:
                    low[node] = min(low[node], index[to])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    yield part


class TooManyStepsError(RuntimeError):
    pass


def _inside(ahead: list[int], beyond: list[int], max_steps: int) -> list[int]:
    """The longest simple path from each vertex of a strong component: ``ahead`` has the successors inside as bits, ``beyond``
    the longest way from a vertex that leaves at once.

    What can follow depends on the vertex and on what it still reaches, so paths that leave the same behind are looked at once.
    """
    known: dict = {}
    steps = 0

    def below(v: int, left: int) -> int:
        nonlocal steps
        found = now = 1 << v
        while now:
            then = 0
            while now:
                bit = now & -now
                then |= ahead[bit.bit_length() - 1]
                now ^= bit
                steps += 1
            now = then & left & ~found
            found |= now
        if steps > max_steps:
            raise TooManyStepsError(f"longest simple paths of a component of {len(ahead)} vertices took over {max_steps} steps")
        return found

    def deep(v: int, left: int) -> int:
        best, n = beyond[v], 0
        while True:
            left &= ~(1 << v)
            then = ahead[v] & left
            if not then:
                return best
            if then & (then - 1):
                break
            v, n = then.bit_length() - 1, n + 1
            best = max(best, n + beyond[v])
        if (v, left) not in known:
            most = 0
            while then:
                w = (then & -then).bit_length() - 1
                then &= then - 1
                most = max(most, 1 + deep(w, below(w, left)))
            known[v, left] = most
        return max(best, n + known[v, left])

    return [deep(v, (1 << len(ahead)) - 1) for v in range(len(ahead))]


def _depths(ahead: dict, max_steps: int, known: dict) -> tuple[dict, list[tuple[list, list[list[int]], list[int]]]]:
    """The longest simple path from each vertex of ``ahead``, which has all their successors.  A path that leaves a strong
    component can't return, so components are solved in order.  Those that a search doesn't solve are listed, as vertices,
    their successors inside and the longest ways that leave at once; what is before them waits until they are ``known``."""
    best: dict = {}
    hard = []
    for part in _parts(ahead):
        if part[0] in known:
            best |= {v: known[v] for v in part}
            continue
        at = {v: i for i, v in enumerate(part)}
        if any(w not in best and w not in at for v in part for w in ahead[v]):
            continue
        beyond = [max([0, *(1 + best[w] for w in ahead[v] if w in best)]) for v in part]
        inside = [sorted({at[w] for w in ahead[v] if w in at and w != v}) for v in part]
        try:
            best |= zip(part, _inside([sum(1 << w for w in ws) for ws in inside], beyond, min(max_steps, SEARCH_STEPS)), strict=True)
        except TooManyStepsError:
            if max_steps <= SEARCH_STEPS:
                raise
            hard.append((part, inside, beyond))
    return best, hard


def longest_paths(edges: DataFrame, starts: DataFrame | None = None, max_steps: int = 100_000_000) -> DataFrame:
    """``(node, depth)``: the length of the longest simple path from each start (column ``node``; all sources by default).

    Each weakly connected part is solved in a task.  Time grows with its edges outside strong components.  One that takes more
    than ``SEARCH_STEPS`` vertices looked at is solved by linear programs in ``PIECES`` tasks, and the part is looked at again.
    In the worst case either is exponential: more than ``max_steps`` vertices looked at, a thousandth as many programs for a
    start, or programs too large raise an error and never cut the result short.
    """
    hops = keep(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    if starts is None:
        starts = hops.select(F.col("src").alias("node"))
    kind = hops.schema["src"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(pdf) + 1000))
        ahead: dict = {}
        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
            ahead.setdefault(b, [])
            if a != b:
                ahead.setdefault(a, []).append(b)
        solved = pdf[pdf["known"].notna()]
        best, hard = _depths(ahead, max_steps, dict(zip(solved["src"].tolist(), solved["known"].astype(int).tolist(), strict=True)))
        rows = [(v, depth, None) for v, depth in best.items()]
        for names, inside, beyond in hard:
            chains = longest.Chains(inside, beyond)
            for i in range(min(PIECES, len(chains.nodes))):
                rows.append((names[0], -1, pickle.dumps((names, chains, range(i, len(chains.nodes), PIECES)))))
        return pd.DataFrame(rows, columns=["node", "depth", "problem"])

    def solve(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for names, chains, targets in map(pickle.loads, pdf["problem"]):
                found = longest.depths(chains, list(targets), max_steps // 1000)
                yield pd.DataFrame({"node": [names[v] for v in found], "known": list(found.values())})

    parted = hops.join(components(hops).select(F.col("node").alias("src"), "component"), "src")
    known = hops.sparkSession.createDataFrame([], f"node {kind}, known int")
    while True:
        rows = parted.join(known.withColumnRenamed("node", "src"), "src", "left")
        found = keep(rows.groupBy("component").applyInPandas(one, f"node {kind}, depth int, problem binary"), "depths")
        problems = found.where("problem IS NOT NULL").select("problem")
        n = problems.count()
        if not n:
            break
        known = known.union(keep(problems.repartition(min(n, 10_000)).mapInPandas(solve, f"node {kind}, known int"), "known"))
        drop(found)
    return starts.select("node").distinct().join(found.select("node", "depth"), "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """``(node, component)`` of the undirected graph; the smallest node names its component.  ``nodes (node)`` adds isolated
    ones.  Labels spread along edges and then jump to their label's label, so long chains take few rounds."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct()
    both = keep(both, "edges")
    every = both.select(F.col("src").alias("node"))
    if nodes is not None:
        every = every.union(nodes.select("node"))
    labels = keep(every.distinct().select("node", F.col("node").alias("component")), "labels")
    for _ in range(max_rounds):
        none = F.lit(None).cast(labels.schema["node"].dataType)
        told = both.join(labels.select(F.col("node").alias("src"), "component"), "src").select(F.col("dst").alias("node"), "component", none.alias("was"))
        # One row a node, used twice below: the two uses share the exchange, and a round is written once.
        least = labels.select("node", "component", F.col("component").alias("was")).union(told).groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        jump = least.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        labels = keep(least.join(jump, "component").select("node", F.col("_next").alias("component"), "was"), "labels")
        if labels.where("component <> was").isEmpty():
            return labels.select("node", "component")
    raise RuntimeError("components did not settle")


def roots(parents: DataFrame) -> DataFrame:
    """``(node, root)`` of every child in a forest ``parents (src, dst)``, from a node to those below it.  Each round doubles
    how far a node looks up, so rounds grow with the logarithm of the depth, and there is one row for each node."""
    now = keep(parents.select(F.col("dst").alias("node"), F.col("src").alias("root")), "roots")
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        now = keep(now.select("node", "root").join(above, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("node", "root")


def cyclic_part(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges without those at vertices that lie on no way between cycles: vertices without an edge in or out are taken
    away, and again what that leaves without, in some rounds.  Cycles stay as they are."""
    edges = whole = keep(edges.select("src", "dst").distinct(), "edges")
    for _ in range(rounds):
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")
    out = keep(edges, "cyclic")
    drop(whole)
    return out


def _spread(edges: DataFrame, labels: DataFrame, max_rounds: int) -> DataFrame:
    """``(node, f, b)``: the least label of a vertex and all that reach it, and of it and all that it reaches;
    ``labels (node, f, b)`` has both to begin with."""
    none = F.lit(None).cast("long")
    for _ in range(max_rounds):
        ahead = edges.join(labels.select(F.col("node").alias("src"), "f"), "src").select(F.col("dst").alias("node"), "f", none.alias("b"), none.alias("wf"), none.alias("wb"))
        behind = edges.join(labels.select(F.col("node").alias("dst"), "b"), "dst").select(F.col("src").alias("node"), none.alias("f"), "b", none.alias("wf"), none.alias("wb"))
        told = labels.select("node", "f", "b", F.col("f").alias("wf"), F.col("b").alias("wb")).union(ahead).union(behind)
        after = keep(told.groupBy("node").agg(F.min("f").alias("f"), F.min("b").alias("b"), F.max("wf").alias("wf"), F.max("wb").alias("wb")), "labels")
        drop(labels)
        labels = after
        if labels.where("f <> wf OR b <> wb").isEmpty():
            return labels
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def strong_components(edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """``(node, component)`` of vertices on cycles, self loops included: those that reach each other are one component, named
    by its smallest member.

    No pairs of vertices are made.  Vertices get labels in an order shuffled anew each round, and the least label spreads along
    the edges and against them.  Members of a component end with the same two labels, so edges between others lie on no cycle
    and go; where both labels are equal, the vertex that had it is reached and reaches back, and the component is settled.  At
    least one is for each connected part that is left.
    """
    left, found = cyclic_part(edges), None
    for n in range(max_rounds):
        if left.isEmpty():
            return left.select(F.col("src").alias("node"), F.col("src").alias("component")) if found is None else found
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        order = nodes.orderBy(F.xxhash64("node", F.lit(n)), "node").withColumn("f", F.monotonically_increasing_id())
        labels = _spread(left, keep(order.withColumn("b", F.col("f")), "labels"), max_rounds)
        ends = (labels.select(F.col("node").alias(c), F.col("f").alias(f"{c}_f"), F.col("b").alias(f"{c}_b")) for c in ("src", "dst"))
        inside = keep(left.join(next(ends), "src").join(next(ends), "dst").where("src_f = dst_f AND src_b = dst_b").select("src", "dst", F.col("src_f").alias("f"), F.col("src_b").alias("b")), "inside")
        drop(left, labels)
        members = inside.where("f = b").select(F.col("src").alias("node"), "f").distinct()
        names = members.groupBy("f").agg(F.min("node").alias("component"))
        settled = keep(members.join(names, "f").select("node", "component"), "components")
        found = settled if found is None else found.union(settled)
        left = cyclic_part(inside.where("f <> b"))
        drop(inside)
    raise RuntimeError(f"strong components did not settle in {max_rounds} rounds")


def on_cycles(edges: DataFrame) -> DataFrame:
    """``(node)`` that reach themselves."""
    return strong_components(edges).select("node")


def within(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``(src, dst, component)`` of the distinct edges with both ends in one of ``components (node, component)``."""
    src, dst = (components.select(F.col("node").alias(c), F.col("component").alias(n)) for c, n in (("src", "component"), ("dst", "_other")))
    return edges.select("src", "dst").distinct().join(src, "src").join(dst, "dst").where("component = _other").select("src", "dst", "component")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes (node)``."""
    inside = nodes.select("node").distinct()
    return edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def _shortest(start, ahead: dict, behind: dict) -> list:
    """The shortest cycle through a vertex on cycles, the first in order among equals, without the start at its end: levels
    from the start and levels back to it meet halfway."""
    forth, back = [{start}, set(ahead[start])], [{start}, set(behind[start])]
    gone, come = {start, *ahead[start]}, {start, *behind[start]}
    while not (met := forth[-1] & back[-1]):
        if len(forth[-1]) <= len(back[-1]):
            level = set().union(*[ahead[v] for v in forth[-1]]) - gone
            gone |= level
            forth.append(level)
        else:
            level = set().union(*[behind[v] for v in back[-1]]) - come
            come |= level
            back.append(level)
    ways = [met]  # of the levels from the start what leads to a meeting
    for level in forth[-2:0:-1]:
        ways.append(level & set().union(*[behind[v] for v in ways[-1]]))
    found = [start]
    for level in ways[::-1] + back[-2:0:-1]:
        found.append(next(v for v in ahead[found[-1]] if v in level))
    return found


def _listed(ahead: dict) -> list[list]:
    """The cycles of one strong component as :func:`greedy_cycles` lists them; ``ahead`` has each vertex's successors in order."""
    behind: dict = {v: [] for v in ahead}
    for v, to in ahead.items():
        for w in to:
            behind[w].append(v)
    out: list[list] = []
    done: set = set()
    for start in sorted(ahead):
        if start not in done:
            found = [start] if start in ahead[start] else [*_shortest(start, ahead, behind), start]
            out.append(found)
            done.update(found)
    return out


def greedy_cycles(edges: DataFrame, max_nodes: int = 100_000) -> list[list]:
    """Cycles as the dependency report lists them: starts ascending; the shortest cycle through each start that is on
    no earlier listed cycle, the first in order among equals; the start is repeated at the end, a self loop is a
    single node.

    A cycle lies in one strong component, so each component is listed by a task of its own, of at most ``max_nodes`` vertices;
    only the listed cycles come to the driver.
    """
    found = strong_components(edges)
    if found.isEmpty():
        return []
    size = found.groupBy("component").count().agg(F.max("count")).first()[0]
    if size > max_nodes:
        raise RuntimeError(f"over {max_nodes} vertices are on cycles through each other")
    kind = found.schema["node"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ahead: dict = {}
        for a, b in sorted(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True)):
            ahead.setdefault(a, []).append(b)
        return pd.DataFrame({"cycle": _listed(ahead)})

    rows = keep(within(edges, found).groupBy("component").applyInPandas(one, f"cycle array<{kind}>"), "cycles")
    return [list(r["cycle"]) for r in rows.orderBy(F.col("cycle")[0]).toLocalIterator()]


def contract(nodes: DataFrame, edges: DataFrame, flow: str = "flow", fixed: tuple[str, ...] = ("fpar", "fret"), back: str = "cons_back", max_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Contract chains to a fixed point: ``nodes (node, kind)``, ``edges (src, tag, dst)``.

    A node that isn't of a fixed kind merges into its predecessor if its only incoming edge is a ``flow`` edge, else
    into its successor if its only outgoing edge is one and it has incoming edges.  Edges tagged ``back`` count in the
    reverse direction.  In a round only merges whose targets do not merge themselves are made, so all are independent.
    Self loops of ``flow`` vanish.
    """
    for _ in range(max_rounds):
        directed = edges.select(F.when(F.col("tag") == back, F.col("dst")).otherwise(F.col("src")).alias("src"), "tag", F.when(F.col("tag") == back, F.col("src")).otherwise(F.col("dst")).alias("dst"))
        into = directed.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.max(F.struct("tag", "src")).alias("i"))
        out = directed.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.max(F.struct("tag", "dst")).alias("o"))
        free = nodes.where(~F.col("kind").isin(*fixed)).select("node").join(into, "node", "left").join(out, "node", "left")
        aim = F.when((F.col("n_in") == 1) & (F.col("i.tag") == flow), F.col("i.src")).when((F.col("n_out") == 1) & (F.col("o.tag") == flow) & F.col("n_in").isNotNull(), F.col("o.dst"))
        wish = keep(free.select("node", aim.alias("to")).where("`to` IS NOT NULL AND `to` <> node"), "wishes")
        settled = wish.join(wish.select(F.col("node").alias("to")), "to", "left_anti")
        pairs = wish.join(wish.select(F.col("node").alias("to"), F.col("to").alias("_then")), "to").where("node < `to`").select("node", "to")
        # If every target merges too (a ring), the smallest node of each pair goes first.
        merge = settled.select("node", "to")
        if merge.isEmpty():
            merge = pairs.join(pairs.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to")
            if merge.isEmpty():
                return nodes, edges
        merge = keep(merge, "merges")
        src, dst = (merge.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in ("src", "dst"))
        moved = edges.join(src, "src", "left").join(dst, "dst", "left").select(F.coalesce("_src", "src").alias("src"), "tag", F.coalesce("_dst", "dst").alias("dst"))
        edges = keep(moved.where(f"NOT (src = dst AND tag = '{flow}')").distinct(), "edges")
        nodes = keep(nodes.join(merge.select("node"), "node", "left_anti"), "nodes")
    raise RuntimeError("contraction did not settle")
