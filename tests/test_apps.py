"""Apps that share ids and names stay apart; closures against plain search; rules of reduction and merge."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import names
from loomgraph.operators import closure, graph, link, reduce, resources, statements

EDGES = "app_id string, src long, dst long, type int"
NODES = "app_id string, node_id long, name string, is_self boolean, is_widget boolean, uid long, xml string, package string"
UHG = "app_id string, uid long, eid long, src long, dst long, type int"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def app(name, calls):
    """Nodes and edges of an app: widget 1 of uid 7, methods from 2 on, 8 and 9 of a library; the event leads to 2."""
    nodes = [(name, 1, "w", False, True, 7, "main", "-")]
    nodes += [(name, k, f"<a.B: void m{k}()>", True, False, None, None, "-") for k in range(2, 8)]
    nodes += [(name, k, f"<lib.C: void m{k}()>", False, False, None, None, "lib") for k in (8, 9)]
    return nodes, [(name, 1, 2, 4), *((name, a, b, 0) for a, b in calls)]


@pytest.fixture
def two(spark):
    n1, e1 = app("A", [(2, 3), (3, 2), (3, 8), (8, 9)])
    n2, e2 = app("B", [(2, 4), (4, 9), (9, 8)])
    return spark.createDataFrame(n1 + n2, NODES), spark.createDataFrame(e1 + e2, EDGES)


def test_handler_graphs_of_two_apps(spark, two):
    n, e = two
    want = {0: {("A", 1, 2), ("A", 2, 3), ("A", 3, 2), ("A", 3, 8), ("B", 1, 2), ("B", 2, 4), ("B", 4, 9)}}
    want[1] = want[0] | {("A", 8, 9), ("B", 9, 8)}
    for hop in (0, 1):
        assert set(rows(graph.handler_edges(e, n, hop), "app_id", "src", "dst")) == want[hop]
    assert rows(graph.reached_by_app(e, n)) == [("A", k) for k in (2, 3, 8, 9)] + [("B", k) for k in (2, 4, 8, 9)]
    assert rows(graph.circles(e, n)) == [("A", 2, 2, 2), ("A", 3, 2, 2)]


def test_links_stay_in_their_app(spark, two):
    n, _ = two
    other = n.withColumn("node_id", F.when(F.col("app_id") == "B", F.col("node_id") + 100).otherwise(F.col("node_id")))
    pairs = spark.createDataFrame([("A", 7, "<a.B: void m3()>"), ("B", 7, "<a.B: void m4()>"), ("B", 7, "<none>")], "app_id string, uid long, method string")
    assert rows(link.link(pairs, other.where("is_widget"), other.where("NOT is_widget"), 3)) == [("A", 1, 3, 3), ("B", 101, 104, 3)]


def test_reduction_of_two_apps(spark, two):
    n, e = two
    g = graph.handler_edges(e, n)
    handlers = spark.createDataFrame([(a, 1, 2, 7, "main", "<a.B: void m2()>") for a in "AB"], "app_id string, uid long, eid long, wid long, xml string, event string")
    kind = "app_id string, key string, ord long, caller string, callee string"
    switches = spark.createDataFrame([("A", "7$main", 0, "<a.B: void m3()>", "x <a.B: void m2()>()")], kind)
    threads = spark.createDataFrame([("B", "7$main", 0, "<gone.G: void g()>", "&lt;x.Y: void run()&gt;")], kind)
    entries = reduce.case_entries(handlers, switches, threads)
    assert rows(entries) == [("A", 1, 2, "<a.B: void m3()>", "x <a.B: void m2()>()"), ("B", 1, 2, "<gone.G: void g()>", "<x.Y: void run()>")]
    cases, lost = reduce.resolve_cases(entries, n, g)
    assert rows(cases) == [("A", 1, 2, 3, 2)] and rows(lost) == [("B", 1, 2, "<x.Y: void run()>")]
    less = reduce.reduce_graphs(g, n, handlers, switches, threads)
    assert rows(less, "app_id", "src", "dst") == [("A", 1, 2), ("A", 2, 3), ("A", 3, 2), ("B", 1, 2), ("B", 2, 4), ("B", 4, 9)]
    stored = {r.app_id: (r.size.edge, r.old.edge, r.edges, r.inherit_methods) for r in reduce.reduced_rows(g, less, lost).collect()}
    assert stored == {"A": (3, 4, ["1 2 4", "2 3 0", "3 2 0"], []), "B": (3, 3, ["1 2 4", "2 4 0", "4 9 0"], ["<x.Y: void run()>"])}


def test_child_widgets(spark):
    n, e = app("A", [(2, 3)])
    n += [("A", 20, "c", False, True, 8, "x", "-"), ("A", 21, "d", False, True, 9, "x", "-"), ("B", 20, "c", False, True, 8, "x", "-")]
    e += [("A", 20, 3, 3), ("A", 21, 3, 3), ("A", 21, 7, 3), ("B", 20, 9, 3)]
    n, e = spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES)
    assert rows(graph.child_widgets(graph.handler_edges(e, n), e, n)) == [("A", 1, 2, 20)]


def test_case_pair_of_an_absent_callee(spark):
    g = spark.createDataFrame([("A", 9, 4, 9, 4, 4), ("A", 9, 4, 4, 3, 0), ("A", 9, 4, 4, 5, 0), ("A", 9, 4, 5, 6, 0)], UHG)
    cases = spark.createDataFrame([("A", 9, 4, 4, 8)], "app_id string, uid long, eid long, src long, dst long")
    assert rows(graph.prune_cases(g, cases), "src", "dst") == [(9, 4)]
    assert rows(graph.prune_cases(g, cases.withColumn("app_id", F.lit("B"))), "src", "dst") == rows(g, "src", "dst")


def test_leaves(spark):
    n, _ = app("A", [])
    calls = [(2, 3), (3, 4), (4, 5), (2, 6), (6, 7), (7, 6), (2, 8), (8, 5)]
    g = spark.createDataFrame([("A", 1, 2, 1, 2, 4), *(("A", 1, 2, a, b, 0) for a, b in calls)], UHG)
    assert rows(graph.prune_leaves(g, spark.createDataFrame(n, NODES)), "src", "dst") == [(1, 2), (2, 6), (2, 8), (6, 7), (7, 6), (8, 5)]
    lone = spark.createDataFrame([("A", 1, 2, 2, 3, 0), ("A", 1, 2, 3, 3, 0)], UHG)
    assert rows(graph.prune_leaves(lone, spark.createDataFrame(n, NODES)), "src", "dst") == [(2, 3), (3, 3)]


def test_words_keep_by_text_and_library_methods(spark):
    n, _ = app("A", [])
    n = spark.createDataFrame(n, NODES)
    g = spark.createDataFrame([("A", 1, 2, 2, 8, 0), ("A", 5, 6, 6, 7, 0)], UHG)
    texts = spark.createDataFrame([("A", 1, resources.MISSING), ("A", 5, "Log in"), ("B", 1, "Log in")], "app_id string, uid long, text string")
    keep = lambda ui, api: rows(reduce.keep_behaviours(g, texts, n, ui, api), "uid")
    assert keep(["FOUND"], ["nothing"]) == [] and keep(["log"], ["nothing"]) == [] and keep(["Log"], ["nothing"]) == [(5,)]
    assert keep(["nothing"], ["M7"]) == [] and keep(["nothing"], ["LIB.c"]) == [(1,)]


def test_packages_of_a_merged_app(spark):
    named = {1: "<android.support.v4.media.X: void a()>", 2: "<java.util.L: void b()>", 3: "<com.android.internal.T: void c()>", 4: "<com.foobar.A: void d()>", 5: "<own.A: void e()>"}
    n = [(a, k, x, False, False, None, None, "-") for a in "AB" for k, x in named.items()] + [("A", 6, "w", False, True, 7, "main", None)]
    prefixes = spark.createDataFrame([("com.foo", 0, None), ("com.foobar", 5, "B"), ("java", 0, None)], "prefix string, ord int, app_id string")
    pairs = spark.createDataFrame([("A", 7, named[5])], "app_id string, uid long, method string")
    edges = spark.createDataFrame([("A", 6, 4, 3), ("B", 4, 5, 0)], EDGES)
    merged, linked, counts = reduce.merge_app(spark.createDataFrame(n, NODES), edges, prefixes, pairs, pairs.limit(0))
    want = {1: "android.media", 2: "java.util", 3: "android.internal", 4: "com.foo", 5: "-", 6: "-"}
    assert {(r.app_id, r.node_id): r.package for r in merged.collect()} == {("A", k): p for k, p in want.items()} | {("B", k): p for k, p in want.items() if k < 6} | {("B", 4): "com.foobar"}
    assert rows(linked) == [("A", 6, 5, 3), ("B", 4, 5, 0)] and rows(counts) == [("A", 1, -2), ("B", -2, -2)]
    for most in (10, 0):
        listed = link.package_of(spark.createDataFrame(n, NODES).where("node_id = 4").select("app_id", "name"), prefixes, most)
        assert rows(listed, "app_id", "package") == [("A", "com.foo"), ("B", "com.foobar")]


def test_signatures(spark):
    texts = ["virtualinvoke r0.<a.C: void <init>(int)>(r1)", "<a.C: void <init>()>", "<a.C: void run()>", "no signature", "x <a.B: void <clinit>()>(<b>)"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(names.signature_in(F.col("t"))).collect()
    assert [r[0] for r in got] == ["<a.C: void <init>(int)>", "<a.C: void <init>()>", "<a.C: void run()>", None, "<a.B: void <clinit>()>"]


def plain(edges, seeds):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    out = set()
    for s in seeds:
        seen, todo = {s}, [s]
        while todo:
            for x in to.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out |= {(s, x) for x in seen}
    return out


@pytest.mark.parametrize(("n", "m", "seed"), [(40, 60, 2), (60, 75, 4)])
def test_closure_and_components(spark, n, m, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(n), pick.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(100, 112)] + [(112, 106)]
    df = spark.createDataFrame(edges, "src long, dst long")
    seeds = [*range(0, n, 3), 100, 777]
    assert set(rows(closure.closure(df, spark.createDataFrame([(x,) for x in seeds], "seed long")))) == plain(edges, seeds)
    led = plain(edges, {x for e in edges for x in e})
    twins = {}
    for a, b in led:
        if a != b and (b, a) in led:
            twins.setdefault(a, {a}).add(b)
    got = {}
    for node, part in rows(closure.components(df)):
        got.setdefault(part, set()).add(node)
    assert {x: g for g in got.values() for x in g} == twins
    starts = spark.createDataFrame([(0,), (100,), (5000,)], "node long")
    assert {x for (x,) in rows(closure.reached(df, starts))} == {b for _, b in plain(edges, [0, 100, 5000])}


def test_deep_hierarchies(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(400, 401), (401, 402), (402, 400), (500, 500)], "class long, parent long")
    got = set(rows(statements.superclasses(chain)))
    assert got == {(a, b) for a in range(300) for b in range(a + 1, 301)} | {(a, b) for a in (400, 401, 402) for b in (400, 401, 402)} | {(500, 500)}
    many = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 4), (6, 6)], "layout long, sub long")
    assert set(rows(resources.include_closure(many))) == {(1, 2), (1, 3), (1, 4), (1, 5), (2, 4), (2, 5), (3, 4), (3, 5), (4, 4), (4, 5), (5, 4), (5, 5), (6, 6)}
