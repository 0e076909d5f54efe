"""The graph engine: languages, hand-checked fixtures, random graphs against brute force, queries against DuckDB."""

from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.functions import aggregations, text, typing
from graphloom.operators import cluster, dependencies, graph, longest, reduction, transform
from graphloom.operators.metrics import Code, Metrics
from graphloom.plans import metric_language, semantic

SF = "/root/testdata/sf0.001"
ACCEPT = ["mods", "mods[name == a]", "mods.funs", "mods.funs[arity > 1 and not exported].arity:sum", "mods.{funs.calls}2", "@fun.(calls)+", "@fun.(calls)3[name == f]", "mods[name in .funs.name]", "funs[.calls]", ".funs.name", 'funs[name like "h"]', "@def", "@fun.refs", "a[x = 1; y =< 2, 'and'.z]"][:-1]
REJECT = ["mods:sum", "mods.funs.arity:sum.x", "{mods}2", "mods.{funs}", "mods[a == b == c]", "mods?", "mods[x == -1]", "mods\n.funs", "mods['and']", ""]


# -- languages --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("query", ACCEPT)
def test_semantic_round_trip(query):
    tree = semantic.parse(query)
    assert semantic.parse(semantic.unparse(tree)) == tree


@pytest.mark.parametrize("query", REJECT)
def test_semantic_reject(query):
    with pytest.raises(semantic.QueryError):
        semantic.parse(query)


def test_semantic_precedence():
    f = semantic.parse("m[not a == b or c, d]").start.filter
    assert f.op == "or" and f.left == semantic.Binary("==", semantic.Not(semantic.Literal("name", "a")), semantic.Literal("name", "b")) and f.right.op == "and"
    assert semantic.lex("a = b")[1] == ("op", "==") and semantic.lex("andalso")[0][0] == "and"


names = st.sampled_from(["a", "b", "funs", "@x"])
operands = st.one_of(st.builds(semantic.Literal, st.just("name"), names), st.builds(semantic.Literal, st.just("int"), st.integers(0, 99)), st.builds(semantic.Literal, st.just("string"), st.sampled_from(["", "x y", "1"])))
conditions = st.recursive(
    operands,
    lambda inner: st.one_of(st.builds(semantic.Binary, st.sampled_from(["and", "or", "==", "<", "like"]), inner, inner), st.builds(semantic.Not, inner), st.builds(lambda s: semantic.Sequence((semantic.Step(s),)), names), st.builds(lambda n, s: semantic.In(n, semantic.Sequence((semantic.Step(s),))), names, names)),
    max_leaves=6,
)


@given(conditions)
@settings(max_examples=150, deadline=None)
def test_filter_round_trip(condition):
    tree = semantic.Query(semantic.Step("m", condition), semantic.Sequence(()))
    assert semantic.parse(semantic.unparse(tree)) == tree


def test_metric_language():
    assert metric_language.parse("show number_of_fun for module ('a','b') sum") == metric_language.Show("number_of_fun", "module", ("a", "b"), "sum")
    assert metric_language.parse("show mcCabe for function ({'a','f',1})").names == (("a", "f", 1),)
    assert metric_language.parse("show metrics % all of them").what == "metrics"
    for command, code in {"compare module ('a')": "bad_command", "show mcCabe for module ()": "parser", "show ?": "scanner", "hide x": "parser", "save 'f' for module ('a')": "bad_command"}.items():
        with pytest.raises(metric_language.MetricError) as e:
            metric_language.parse(command)
        assert e.value.code == code


# -- fixtures checked by hand -----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def micro(spark):
    functions = [(1, 1, "f", 1), (2, 1, "g", 0), (3, 2, "h", 2), (4, 3, "k", 0), (5, 4, "u", 1), (6, 4, "v", 0), (7, 5, "map", 2)]
    module = spark.createDataFrame([(i, n, i) for i, n in enumerate("a b c d lists".split(), 1)], "mod_id long, name string, file_id long")
    func = spark.createDataFrame([(*f, True) for f in functions], "fun_id long, mod_id long, name string, arity int, exported boolean")
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (1, 5), (3, 3), (5, 7)], "caller long, callee long")
    return Metrics(Code(module, func, calls))


def values(df):
    return {r["node"]: r["value"] for r in df.collect()}


def test_micro_metrics(micro):
    assert values(micro.function_calls_in()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
    assert values(micro.function_calls_out()) == {1: 2, 2: 1, 3: 1, 4: 1, 5: 0}
    assert values(micro.cohesion()) == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert values(micro.number_of_funpath()) == {1: 4, 2: 3, 3: 2, 4: 2, 5: 1}
    assert values(micro.max_depth_of_calling("function")) == {1: 3, 2: 5, 3: 4, 4: 3, 5: 1, 6: 0, 7: 0}
    assert values(micro.max_depth_of_calling("module")) == {1: 5, 2: 4, 3: 3, 4: 1, 5: 0}
    assert values(micro.min_depth_of_calling()) == {1: 3, 2: 4, 3: 3, 4: 1, 5: 0}


def test_micro_dependencies(spark, micro):
    edges = micro.code.calls.selectExpr("caller AS src", "callee AS dst")
    closed = {(r["src"], r["dst"]) for r in graph.reach(edges).collect()}
    assert closed == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4, 5, 7)} | {(5, 7)}
    owner = micro.code.func.selectExpr("fun_id AS member", "mod_id AS owner")
    mods = dependencies.lifted(micro.code.calls, owner, None)
    assert {tuple(r) for r in mods.collect()} == {(1, 2), (1, 4), (2, 3), (3, 1), (4, 5)}
    assert dependencies.check_cycle(mods) == [[1, 2, 3, 1]]
    assert dependencies.check_module(mods, 1) and not dependencies.check_module(mods, 4)
    block = spark.createDataFrame([(1, "/app/core"), (2, "/app/core"), (3, "/app/net"), (4, "/app/util"), (5, "Other")], "mod_id long, block string")
    some = dependencies.block_edges(micro.code.calls, micro.code.func.select("fun_id", "mod_id"), block, ["/app/core", "/app/net"])
    assert [r["members"] for r in dependencies.relations(some).collect()] == [["/app/core", "/app/net", "/app/util"]]
    assert not dependencies.is_relation(some, ("/app/core", "/app/net"))
    assert graph.greedy_cycles(spark.createDataFrame([(3, 3), (1, 3)], "src long, dst long")) == [[3]]


def test_aggregations(spark):
    rows = spark.createDataFrame([(0, "x", 3, True), (1, "y", 0, True), (2, "z", 0, True), (3, "p", 4, True), (4, "q", 4, True), (5, "w", None, False)], "ord int, name string, value long, found boolean")
    one = lambda name, **k: aggregations.apply(name, rows).first()["value"]
    assert (one("max"), one("min"), one("sum"), one("avg")) == (4, 0, 11, 2.75)
    assert aggregations.avg(rows, "documented").first()["value"] == 11 / 5
    assert tuple(aggregations.fmaxname(rows).first()) == ("p", 4)
    assert [r["name"] for r in aggregations.maxlist(rows).collect()] == ["p", "q"] and aggregations.tolist(rows).count() == 6
    none = rows.where("false")
    assert aggregations.sum_(none).first()["value"] == 0
    for name in ("max", "min", "avg"):
        with pytest.raises(Exception, match="of nothing"):
            aggregations.apply(name, none).collect()


def test_text(spark):
    df = spark.createDataFrame([("a(X, Y) ->\n\n  b(X,Y),\n   \n  c.\n",)], "t string")
    t = df["t"]
    got = df.select(text.line_of_code(t), text.char_of_code(t, "module"), text.char_of_code(t, "function"), text.max_length_of_line(t), text.average_length_of_line(t), text.no_space_after_comma(t, "module"), text.no_space_after_comma(t, "function")).first()
    assert tuple(got) == (4, 31, 26, 10, 6, 2, 1)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="no line"):
        df.select(text.max_length_of_line(F.concat(F.lit("\n"), F.substring(t, 1, 0)))).collect()


def test_structure(spark):
    func = spark.createDataFrame([(1, 1, "f", 1, True), (2, 1, "g", 0, True)], "fun_id long, mod_id long, name string, arity int, exported boolean")
    module = spark.createDataFrame([(1, "m", 1)], "mod_id long, name string, file_id long")
    clause = spark.createDataFrame([(1, 1, "function", 1, "plain"), (2, 1, "function", 2, "plain"), (3, 2, "function", 1, "plain"), (10, 100, "expr", 0, "head"), (11, 100, "expr", 1, "plain"), (12, 100, "expr", 2, "plain"), (20, 200, "expr", 1, "plain"), (21, 200, "expr", 2, "plain")], "clause_id long, owner_id long, owner_kind string, ord long, kind string")
    kinds = "expr_id long, parent_id long, clause_id long, ord int, kind string, role string, value string"
    expr = spark.createDataFrame([(100, None, 1, 1, "case_expr", "expr", None), (101, None, 2, 1, "atom", "expr", None), (110, None, 11, 1, "atom", "expr", None), (120, None, 12, 1, "application", "expr", None), (200, None, 3, 1, "if_expr", "expr", None), (210, None, 20, 1, "case_expr", "expr", None), (220, None, 21, 1, "atom", "expr", None)], kinds)
    calls = spark.createDataFrame([], "caller long, callee long")
    apps = spark.createDataFrame([(120, 1, 1)], "expr_id long, caller long, callee long")
    m = Metrics(Code(module, func, calls, clause=clause, expr=expr, application=apps))
    # f: (2 - 1) + (3 - 2) + 1; g: 0 + (2 - 1) + 1, and a case without clauses of its own adds nothing
    assert values(m.mccabe("function")) == {1: 3, 2: 2}
    assert values(m.fun_return_points("function"))[1] == 3
    assert values(m.max_depth_of_cases("function")) == {1: 1, 2: 1} and values(m.max_application_depth("module")) == {1: 1}
    assert values(m.number_of_funclauses("module")) == {1: 3} and values(m.branches_of_recursion("function")) == {1: 1, 2: 0}
    assert values(m.function_sum()) == {1: 9, 2: 9}


# -- random graphs ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(18)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    ahead = {v: {b for a, b in pairs if a == v} for v in range(14)}

    def below(v, most=99):
        seen, now = set(), {v}
        for _ in range(most):
            now = {b for a in now for b in ahead[a]} - seen
            if not now:
                break
            seen |= now
        return seen

    assert {tuple(r) for r in graph.reach(edges).collect()} == {(v, b) for v in range(14) for b in below(v)}
    assert {tuple(r) for r in graph.reach(edges, 2).collect()} == {(v, b) for v in range(14) for b in below(v, 2)}
    label = {v: v for p in pairs for v in p if p[0] != p[1]}
    for _ in range(14):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r["node"]: r["component"] for r in graph.components(edges).collect()} == label
    for cycle in graph.greedy_cycles(edges):
        assert all((a, b) in pairs for a, b in zip(cycle, cycle[1:], strict=False)) and (len(cycle) == 1 or cycle[0] == cycle[-1])


def test_contraction(spark):
    nodes = spark.createDataFrame([(1, "expr", "fpar"), (2, "expr", "x"), (3, "expr", "x"), (4, "expr", "fret"), (5, "expr", "x"), (6, "expr", "x")], "node long, class string, kind string")
    edges = spark.createDataFrame([(1, "flow", 2), (2, "flow", 3), (3, "flow", 4), (5, "flow", 5), (6, "flow", 5)], "src long, tag string, dst long")
    left, links = reduction.reduce(nodes, edges)
    assert {r["node"] for r in left.collect()} == {1, 4} and {tuple(r) for r in links.select("src", "dst").collect()} == {(1, 4)}
    again, same = graph.contract(left, links)
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in links.collect()} and again.count() == 2


# -- types, transformations -------------------------------------------------------------------------------------
def test_types():
    assert typing.meet(typing.TOP, typing.INT) == typing.INT and typing.meet(typing.INT, typing.FLOAT) == typing.NONE
    assert typing.meet(typing.NUMBER, ("int", 3)) == ("int", 3) and typing.union(typing.INT, typing.INT) == typing.INT
    loop = {"name": "l", "arity": 1, "clauses": [{"patterns": [{"kind": "variable", "value": "X"}], "body": [{"kind": "application", "value": "l", "children": [{"kind": "variable", "value": "X"}]}]}]}
    assert typing.pretty("l", 1, typing.Inference([loop]).signatures(("l", 1))) == "l/1 :: (any()) -> any()"
    assert len(typing.INFIX) == 19 and len(typing.PREFIX) == 4 and len(typing.GUARDS) == 14


def test_clash(spark):
    func = spark.createDataFrame([(1, 1, "f", 1), (2, 1, "g", 1), (3, 2, "f", 1)], "fun_id long, mod_id long, name string, arity int")
    with pytest.raises(transform.Clash):
        transform.rename_fun({"func": func}, 1, "g")
    with pytest.raises(transform.Clash):
        transform.move_fun({"func": func}, [1], 2)
    assert transform.rename_fun({"func": func}, 1, "h")["func"].where("name = 'h'").count() == 1


def test_clash_in_files(spark):
    macro = spark.createDataFrame([(1, 1, "A", "x"), (2, 1, "B", "y"), (3, 2, "A", "z")], "macro_id long, file_id long, name string, text string")
    for go in (lambda: transform.rename_mac({"macro": macro}, 1, "B"), lambda: transform.move_mac({"macro": macro}, [1], 2), lambda: transform.rename({"macro": macro}, "macro", 1, "B")):
        with pytest.raises(transform.Clash):
            go()
    assert transform.rename({"macro": macro}, "macro", 3, "B")["macro"].where("file_id = 2").first()["name"] == "B"
    with pytest.raises(ValueError):
        transform.rename({"macro": macro}, "clause", 1, "x")
    expr = spark.createDataFrame([(1, "macro", "A"), (2, "atom", "A")], "expr_id long, kind string, value string")
    with pytest.raises(transform.Clash):
        transform.inline_mac({"macro": macro.drop("text"), "expr": expr}, 1)
    assert [tuple(r) for r in transform.inline_mac({"macro": macro, "expr": expr}, 1)["expr"].orderBy("expr_id").collect()] == [(1, "inlined", "x"), (2, "atom", "A")]


def test_roots(spark):
    parents = {n: n // 2 for n in range(2, 40)} | {100 + n: 99 + n for n in range(1, 20)}
    found = {r["node"]: r["root"] for r in graph.roots(spark.createDataFrame([(p, n) for n, p in parents.items()], "src long, dst long")).collect()}
    assert found == {n: 1 if n < 100 else 100 for n in parents}
    assert graph.roots(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_cyclic_part(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (0, 1), (7, 7), (8, 7)], "src long, dst long")
    assert {tuple(r) for r in graph.cyclic_part(edges).collect()} == {(1, 2), (2, 3), (3, 1), (7, 7)}


@pytest.mark.parametrize("seed", range(2))
def test_cycles_without_pairs(spark, monkeypatch, seed):
    """Cycles are found without the closure, against brute force."""
    rng = random.Random(seed)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(42)} | {(100 + i, 100 + (i + 1) % 9) for i in range(9)} | {(200 + i, 201 + i) for i in range(12)}
    below = {v: set() for p in pairs for v in p}
    for _ in below:
        for a, b in pairs:
            below[a] |= {b} | below[b]
    names = {v: min(w for w in below[v] if v in below[w]) for v in below if v in below[v]}

    def none(*_, **__):
        raise AssertionError("pairs of vertices are made")

    monkeypatch.setattr(graph, "reach", none)
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    assert {r["node"]: r["component"] for r in graph.strong_components(edges).collect()} == names
    assert {(r["src"], r["dst"]): r["cyclic"] for r in dependencies.cycle_edges(edges).collect()} == {(a, b): a in below[b] for a, b in pairs}
    assert dependencies.check_module(edges, 100) and not dependencies.check_module(edges, 200)
    assert graph.on_cycles(edges.where("src >= 200")).isEmpty()
    cycles = graph.greedy_cycles(edges, max_nodes=max(9, *(list(names.values()).count(n) for n in names.values())))
    assert [*range(100, 109), 100] in cycles and [c[0] for c in cycles] == sorted(c[0] for c in cycles)
    assert {v for c in cycles for v in c} == set(names)


def test_closure_in_tasks(spark, monkeypatch):
    """The walk in the tasks and the rounds of joins give the same, for long chains and for names too."""
    pairs = [(i, i + 1) for i in range(70)] + [(70, 60), (90, 91), (91, 90), (95, 95)]
    edges = spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in pairs], "src string, dst string")
    starts = spark.createDataFrame([(1, "v0"), (1, "v90"), (2, "v65"), (3, "v95"), (4, "v99"), (5, None)], "origin int, node string")
    below = {1: {*range(1, 71), 90, 91}, 2: set(range(60, 71)), 3: {95}}
    want = {(o, f"v{n}") for o, some in below.items() for n in some}
    monkeypatch.setattr(graph, "HELD_EDGES", 0)
    few = edges.where("src > 'v6'")
    joined = sorted(map(tuple, graph.closure(starts, graph.step_over(few)).collect()))
    monkeypatch.undo()
    assert sorted(map(tuple, graph.closure(starts, graph.step_over(few)).collect())) == joined
    step = graph.step_over(edges)
    rounds = []

    def counted(frontier):
        rounds.append(frontier)
        return step(frontier)

    counted.edges = step.edges
    got = graph.closure(starts, counted).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and not rounds
    assert graph.closure(starts, graph.step_over(edges.where("false"))).count() == 0


def test_listed_cycles_look_at_little():
    """The shortest cycles of a large component, first in order, without looking at most of it for each."""

    class Counted(dict):
        looked = 0

        def __getitem__(self, key):
            Counted.looked += 1
            return super().__getitem__(key)

    rng = random.Random(8)
    for n in (3, 12, 3000):
        ahead = {v: sorted({(v + 1) % n, *(rng.randrange(n) for _ in range(3 * (n > 3)))} - {v}) for v in range(n)}
        Counted.looked = 0
        cycles = graph._listed(Counted(ahead))
        assert Counted.looked < 150 * n
        assert {v for c in cycles for v in c} == set(ahead) and all(b in ahead[a] for c in cycles for a, b in zip(c, c[1:], strict=False))
        if n < 100:
            seen: set = set()
            for c in cycles:
                assert c[0] == min(set(ahead) - seen)
                paths = [[c[0]]]
                while not (closed := [[*p, c[0]] for p in paths if c[0] in ahead[p[-1]]]):
                    paths = [[*p, w] for p in paths for w in ahead[p[-1]] if w not in p]
                assert c == min(closed)
                seen |= set(c)


def test_longest_paths(spark):
    """Paths of over 64 edges, and loops with side ways, against a plain search."""
    rng = random.Random(5)
    pairs = {(i, i + 1) for i in range(100)} | {(100, 99), (7, 7)} | {(200 + rng.randrange(8), 200 + rng.randrange(8)) for _ in range(16)}
    ahead = {v: {b for a, b in pairs if a == v} for p in pairs for v in p}

    def deep(v, seen):
        return max([0, *(1 + deep(w, seen | {w}) for w in ahead[v] if w not in seen)])

    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    starts = spark.createDataFrame([(v,) for v in [*ahead, 500]], "node long")
    assert {r["node"]: r["depth"] for r in graph.longest_paths(edges, starts).collect()} == {v: deep(v, {v}) for v in ahead} | {500: 0}
    with pytest.raises(Exception, match="took over 3 steps"):
        graph.longest_paths(spark.createDataFrame([(a, b) for a in range(5) for b in range(5)], "src long, dst long"), max_steps=3).collect()


def test_longest_paths_programs(spark):
    """A component too large for a search, with a ring through all of its vertices, and one before and one behind it."""
    rng = random.Random(4)
    pairs = {(i, (i + 1) % 60) for i in range(60)} | {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    edges = spark.createDataFrame(sorted(pairs | {(100, 7), (60, 61), (9, 60)}), "src long, dst long")
    got = {r["node"]: r["depth"] for r in graph.longest_paths(edges, max_steps=3_000_000).collect()}
    assert got[100] == 1 + got[7] and got[60] == 1 and got[10] == 61 and min(got[v] for v in range(60)) >= 59 and max(got.values()) <= 62


def test_longest_programs_as_searched():
    """Linear programs against the search, on components with chains and ways out."""
    for seed in range(60):
        rng = random.Random(seed)
        ahead: dict = {v: [] for v in range(rng.randrange(2, 16))}
        for v in list(ahead):
            for _ in range(rng.randrange(1, 4)):
                at, between = v, rng.choice([0, 0, 1, 3])
                for _ in range(between):
                    ahead[at].append(len(ahead))
                    at = len(ahead)
                    ahead[at] = []
                ahead[at].append(rng.choice([w for w in list(ahead) if w != at]))
        for part in graph._parts(ahead):
            if len(part) > 1:
                of = {v: i for i, v in enumerate(part)}
                inside = [sorted({of[w] for w in ahead[v] if w in of}) for v in part]
                beyond = [rng.choice([0, 0, 0, 1, 4]) for _ in part]
                chains = longest.Chains(inside, beyond)
                want = graph._inside([sum(1 << w for w in ws) for ws in inside], beyond, 10**8)
                assert longest.depths(chains, list(range(len(chains.nodes)))) == dict(enumerate(want))


@pytest.mark.parametrize("linkage", ["average", "single", "complete"])
def test_agglomerate(spark, linkage):
    """Against a plain search of all pairs, and on 3,000 items."""
    rng = random.Random(3)
    for _ in range(40):
        n, clusters = rng.randrange(2, 14), rng.randrange(1, 4)
        far = {(a, b): rng.choice([0.0, 0.25, 0.5, 1 / 3, 0.9, 1.0]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4}
        groups = {i: [i] for i in range(n)}
        while len(groups) > clusters:

            def apart(x, y):
                d = [far.get((min(p, q), max(p, q)), 1.0) for p in groups[x] for q in groups[y]]
                return {"single": min, "complete": max}.get(linkage, lambda v: sum(v) / len(v))(d)

            _, x, y = min((apart(p, q), p, q) for p in groups for q in groups if p < q)
            groups[x] += groups.pop(y)
        got = cluster._merged(list(range(n)), [(a, b, d) for (a, b), d in far.items()], clusters, linkage)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in groups.items()}
    many = cluster._merged(list(range(3000)), [(i, i + 1, 0.5) for i in range(0, 3000, 2)], 1500, linkage)
    assert sorted(map(tuple, many.values())) == [(i, i + 1) for i in range(0, 3000, 2)]
    items = spark.range(5).selectExpr("id AS item")
    found = cluster.agglomerate(spark.createDataFrame([(3, 4, 0.25)], "a long, b long, distance double"), items, 4, linkage)
    assert {r["item"]: r["cluster"] for r in found.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}


def test_versions(spark, tmp_path):
    from graphloom.sources import dump

    v = dump.Versions(spark, str(tmp_path / "v"))
    v.commit(t=spark.range(3))
    v.commit(t=spark.range(5))
    assert v.table("t").count() == 5 and v.undo() == 1 and v.table("t").count() == 3
    v.reset()
    with pytest.raises(ValueError):
        v.table("t")
    v.commit(t=spark.range(2))
    assert v.table("t").count() == 2
    with pytest.raises(ValueError):
        v.undo()


# -- queries against DuckDB -------------------------------------------------------------------------------------
SOME = ["r05_eliminate_import", "r13_tuple_arguments", "t02_specs", "m30_is_tail_recursive", "d10_components_all", "m08_number_of_funpath_all", "q03_chain", "q05_iteration_2", "q08_stat_avg", "q12_like", "q15_in_subquery", "q16_aggregate_subquery", "n08_edge_nth", "m06_included_files", "m08_number_of_funpath", "m14_max_application_depth", "m20_mccabe", "m25_fun_return_points", "d09_block_edges", "g03_keep_nodes", "s02_transitions", "b04_find_node", "io02_load", "io08_add_file", "io09_add_dir", "io14_undo", "a05_avg", "mq07_render", "t01_infer", "r23_rename_mod_file", "e03_throttled", "e04_stream_upsert"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, name):
    import duckdb

    from graphloom.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    result = con.execute(ORACLE_SQL[name])
    cols = sorted(c[0] for c in result.description)
    order = [[c[0] for c in result.description].index(c) for c in cols]
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == want
