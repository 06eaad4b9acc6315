"""Hand-made graphs with known handler graphs, and scalar functions with known results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import names
from loomgraph.operators import access, closure, evaluate, graph, link, statements, within
from loomgraph.sources import readers, writers
from loomgraph.streaming import increment

CASES = "app_id string, uid long, eid long, src long, dst long"
IDS = {"w": 0, "w2": 1, "c": 2, "m1": 3, "m2": 4, "m3": 5, "m4": 6, "a1": 7, "a2": 8, "a3": 9}


def _tables(spark, text):
    rows = [(IDS[a], IDS[b], int(t)) for a, b, t in (e.split() for e in text.split(","))]
    nodes = [(i, n if n[0] in "wc" else f"<x.C: void {n}()>", n[0] == "m", n[0] == "w") for n, i in IDS.items()]
    app = F.lit("a").alias("app_id")
    return spark.createDataFrame(rows, "src long, dst long, type int").select(app, "*"), spark.createDataFrame(nodes, "node_id long, name string, is_self boolean, is_widget boolean").select(app, "*")


def _edges(df):
    back = {v: k for k, v in IDS.items()}
    return {(back[r.src], back[r.dst], r.type) for r in df.collect()}


def _set(text):
    return {(a, b, int(t)) for a, b, t in (e.split() for e in text.split(","))}


@pytest.mark.parametrize(
    ("given", "wanted", "hop"),
    [
        ("w m1 4,m1 m2 0,m2 a1 0", "w m1 4,m1 m2 0,m2 a1 0", 0),
        ("w m1 4,m1 m2 0,m2 m1 0", "w m1 4,m1 m2 0,m2 m1 0", 0),
        ("w m1 4,m1 m1 0", "w m1 4,m1 m1 0", 0),
        ("w m1 4,m1 a1 0,a1 a2 0", "w m1 4,m1 a1 0", 0),
        ("w m1 4,m1 a1 0,a1 a2 0", "w m1 4,m1 a1 0,a1 a2 0", -1),
        ("w m1 4,m1 a1 0,a1 m3 0", "w m1 4,m1 a1 0,a1 m3 0", 0),
        ("w m1 4,m1 a1 0,a1 a2 0,a2 a3 0", "w m1 4,m1 a1 0,a1 a2 0", 1),
        ("w m1 4,m1 a1 0,a1 a2 0,a2 a3 0", "w m1 4,m1 a1 0,a1 a2 0,a2 a3 0", 2),
        ("w m1 4,m1 a1 0,a1 a2 0,a2 m3 0,m3 m4 0", "w m1 4,m1 a1 0,a1 a2 0,a2 m3 0,m3 m4 0", 1),
        ("w m1 4,m1 a1 0,a1 a2 0,a2 m3 0,m3 a3 0,a3 a1 0", "w m1 4,m1 a1 0,a1 a2 0,a2 m3 0,m3 a3 0,a3 a1 0", 1),
        ("w m1 4,m1 a1 0,m1 a2 0,a1 a2 0,a2 a3 0", "w m1 4,m1 a1 0,m1 a2 0,a1 a2 0,a2 a3 0", 1),
        ("w m1 4,m1 m2 0,w2 m2 3", "w m1 4,m1 m2 0,w2 m2 3", 0),
        ("c w 2,w m1 4,m1 m2 0", "w m1 4,m1 m2 0", 0),
    ],
)
def test_handler_graph(spark, given, wanted, hop):
    assert _edges(graph.handler_edges(*_tables(spark, given), hop).where("uid = 0")) == _set(wanted)


def test_mundane_words_and_find_edges(spark):
    tables = _tables(spark, "w m1 4,m1 m2 0,m2 a1 0,m1 m3 0,m1 m4 1")
    assert _edges(graph.handler_edges(*tables, calls=["m2"]).where("uid = 0")) == _set("w m1 4,m1 m3 0")
    assert _edges(graph.handler_edges(*tables, find_edge=True).where("uid = 0")) == _set("w m1 4,m1 m2 0,m2 a1 0,m1 m3 0,m1 m4 1")


def test_single_edge_is_no_graph(spark):
    assert graph.handler_edges(*_tables(spark, "w m1 4")).count() == 0


def test_foreign_event_is_pruned(spark):
    g = graph.handler_edges(*_tables(spark, "w m1 4,m1 m2 0,w2 m2 4,m2 a1 0")).where("uid = 0")
    assert ("w2", "m2", 4) in _edges(g)
    assert ("w2", "m2", 4) not in _edges(graph.prune_events(g))


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("w m1 4,m1 m2 0,m1 m3 0,m3 a1 0", "w m1 4,m1 m2 0"),
        ("w m1 4,m1 m2 0,m1 m3 0,m3 a1 0,m2 m4 0,m3 m4 0,m4 a2 0", "w m1 4,m1 m2 0,m2 m4 0"),
    ],
)
def test_switch_noise(spark, given, wanted):
    g = graph.handler_edges(*_tables(spark, given))
    cases = spark.createDataFrame([("a", 0, 3, 3, 4)], CASES)
    assert _edges(graph.prune_cases(g, cases)) == _set(wanted)
    unknown = spark.createDataFrame([("a", 0, 3, 99, 98)], CASES)
    assert _edges(graph.prune_cases(g, unknown)) == _set(given)


def test_leaves_go_until_none_is_left(spark):
    e, n = _tables(spark, "w m1 4,m1 m2 0,m2 m3 0,m1 m4 0,m4 a1 0")
    assert _edges(graph.prune_leaves(graph.handler_edges(e, n), n)) == _set("w m1 4,m1 m4 0,m4 a1 0")


def test_two_events(spark):
    s = {(r.uid, r.eid): (r.n_nodes, r.n_edges) for r in graph.sizes(graph.handler_edges(*_tables(spark, "w m1 4,w m2 4,m1 a1 0,m2 a2 0"))).collect()}
    assert s == {(0, 3): (3, 2), (0, 4): (3, 2)}


def test_names(spark):
    row = lambda c: spark.range(1).select(c).first()[0]
    assert row(names.native_package(F.lit("android.support.design.X"))) == "android.design"
    assert row(names.native_package(F.lit("android.support.v4.media.X"))) == "android.media"
    assert row(names.native_package(F.lit("java.util.List"))) == "java.util"
    assert row(names.smali_type(F.lit("int[][]"))) == "[[I"
    assert row(names.smali_method(F.lit("void onClick(android.view.View,int)"))) == "onClick(Landroid/view/View;I)V"
    assert row(names.to_hex(F.lit(2131034590))) == "7f0501de"
    assert row(names.node_kind(F.lit("<javax.a.B: void c()>"))) == "JAVA"


def test_prefix_paths_agree(spark):
    n = spark.createDataFrame([("<com.foobar.A: void m()>",), ("<x.Y: int z()>",)], "name string")
    p = spark.createDataFrame([("com.foo", 0), ("com.foobar", 1)], "prefix string, ord int")
    for most in (10, 0):
        assert {r.name: r.package for r in link.package_of(n, p, most).collect()} == {"<com.foobar.A: void m()>": "com.foo", "<x.Y: int z()>": "-"}


def test_laplacian_of_known_graphs(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (2, 0, 1)], "g int, src long, dst long")
    got = {r.g: r.eigen_mean for r in evaluate.laplacian(e, ["g"]).collect()}
    assert got[1] == pytest.approx(0.75) and got[2] == pytest.approx(1.0)


def test_laplacian_of_large_graphs(spark):
    rng = np.random.RandomState(3)
    rows = [(g, int(a), int(b)) for g in range(3) for a, b in rng.randint(0, 120, (400 - 90 * g, 2))] + [(3, a, a + 1) for a in range(60)] + [(4, 1, 2), (4, 3, 4)]
    edges = spark.createDataFrame(rows, "g int, src long, dst long")
    dense, sparse = (dict(map(tuple, evaluate.laplacian(edges, ["g"], n).collect())) for n in (2000, 1))
    assert {g: round(x, 7) for g, x in dense.items()} == pytest.approx({g: round(x, 7) for g, x in sparse.items()}, abs=1e-6)


def test_layouts_and_texts_of_widgets(spark):
    widgets = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "class string, pos int")
    inflated = spark.createDataFrame([("A", 2, 70)], "class string, pos int, layout long")
    contents = spark.createDataFrame([("A", 60)], "class string, layout long")
    assert sorted(map(tuple, statements.widget_layouts(widgets, inflated, contents, ["class"]).collect())) == [("A", 1, 60), ("A", 2, 70), ("B", 3, None)]
    texts = spark.createDataFrame([("A", 1, "hi"), ("A", 2, "99"), ("A", 3, None)], "class string, pos int, value string")
    ids = spark.createDataFrame([("A", 1, "5"), ("A", 2, "6"), ("A", 3, "6")], "class string, pos int, value string")
    setters = spark.createDataFrame([("A", 1, "setText"), ("A", 2, "setHint"), ("A", 3, "setText"), ("A", 4, "run")], "class string, pos int, callee string")
    strings = spark.createDataFrame([(99, "named")], "id long, value string")
    assert sorted(map(tuple, statements.code_texts(texts, ids, setters, strings, ["class"]).collect())) == [("A", 1, "5", "text", "hi"), ("A", 2, "6", "hint", "named")]


@pytest.mark.parametrize("block", [512, 7])
def test_ward(spark, block):
    """Against merging the cheapest pair of clusters again and again."""
    rng = np.random.RandomState(5)
    points = {i: rng.rand(3) + 2 * (i % 3) for i in range(40)}
    groups = [[i] for i in points]
    while len(groups) > 4:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((np.mean([points[i] for i in a], 0) - np.mean([points[i] for i in b], 0)) ** 2).sum()
        x, y = min(((a, b) for a in groups for b in groups if a[0] < b[0]), key=lambda p: cost(*p))
        groups = sorted([g for g in groups if g not in (x, y)] + [sorted(x + y)])
    v = spark.createDataFrame([(i, p.tolist()) for i, p in points.items()], "id long, v array<double>")
    got = {r.id: r.cluster for r in evaluate.ward(v, "id", "v", 4, block).collect()}
    assert got == {i: k for k, g in enumerate(groups) for i in g}


def test_statements(spark):
    s = spark.createDataFrame([("m", 0, "def", "a"), ("m", 1, "use", None), ("m", 2, "store", "f"), ("m", 3, "use", None)], "method string, pos int, kind string, v string")
    assert [r.defined for r in statements.latest_definition(s, ["method"], "pos", "kind = 'def'", "v").orderBy("pos").collect()] == [None, "a", "a", "a"]
    assert [r.stored for r in statements.forward_store(s, ["method"], "pos", "kind = 'store'", "v").orderBy("pos").collect()] == ["f", "f", None, None]


def test_readers(spark, tmp_path):
    app = tmp_path / "app1" / "encoding"
    app.mkdir(parents=True)
    (app / "node.csv").write_text(",Name,Hash,Java,Android,UI,Class,XML,UId,Package\n0,<a.B: void c()>,5,0,0,0,a.B,-1,-1,-\n")
    (app / "edge.csv").write_text(",From,To,Type\n0,1,2,4\n")
    (app / "info.json").write_text(json.dumps({"useEdges": {"7": ["<a.B: void c()>", "<a.B: void d()>"]}}))
    (app / "event.xml").write_text('<GUIHierarchy><Activity name="main"><View id="7"><EventAndHandler handler="h1"/><EventAndHandler handler="h2"/></View></Activity></GUIHierarchy>')
    (app / "public.xml").write_text('<resources><public type="layout" name="main" id="0x7f0501de"/></resources>')
    assert readers.nodes(spark, f"{app}/node.csv").select("app_id", "class", "xml").collect()[0] == ("app1", "a.B", None)
    assert readers.edges(spark, f"{app}/edge.csv").collect()[0] == ("app1", 1, 2, 4)
    assert readers.json_map(spark, f"{app}/info.json", "useEdges").count() == 2
    assert {tuple(r) for r in readers.events(spark, f"{app}/event.xml").collect()} == {("app1", "main", "7", "h1"), ("app1", "main", "7", "h2")}
    assert readers.public_ids(spark, f"{app}/public.xml").first().id == 0x7F0501DE


def test_done_work_is_skipped(spark):
    w, log = spark.createDataFrame([(1,), (2,), (3,)], "app long"), spark.createDataFrame([(1, "ok"), (2, "failed")], "app long, status string")
    assert {r.app for r in increment.not_done(w, log, "app").collect()} == {2, 3}


STMTS = "class string, pos int, lhs string, rhs string, rhs_kind string, callee string, receiver string, args array<string>"


def test_string_behind(spark):
    rows = [
        ("A", 1, "a", "hello", "string", None, None, None),
        ("A", 2, "b", "a", "local", None, None, None),
        ("A", 3, "c", None, "invoke", "valueOf", None, ["b"]),
        ("A", 4, "c", None, "invoke", "count", None, ["7"]),  # neither text nor variable: passed over
        ("A", 5, None, None, None, "setText", "v", ["c"]),
        ("A", 6, "a", "a", "local", None, None, None),
        ("A", 7, None, None, None, "setText", "v", ["a"]),
        ("A", 8, "p", None, "invoke", "getString", None, ['"k"', '"d"']),
        ("A", 9, None, None, None, "setHint", "v", ["p"]),
        ("A", 10, None, None, None, "setHint", "v", ['"own"']),
        ("A", 11, None, None, None, "setHint", "v", ["never"]),
        ("B", 12, None, None, None, "setHint", "v", ["a"]),
        ("A", 13, "a", None, "other", None, None, None),
        ("A", 14, None, None, None, "setText", "v", ["a"]),
        ("A", 15, None, None, None, "run", "v", None),
    ]
    got = {r.pos: (r.value, r.origin) for r in statements.string_behind(spark.createDataFrame(rows, STMTS), ["class"]).collect()}
    assert got[5] == ("hello", 1) and got[7] == ("hello", 1) and 4 not in got
    assert got[9] == ('[p] "k" "d"', 8) and got[10] == ("own", 10)
    assert got[11] == got[12][:1] + (11,) == (None, 11) and got[14] == (None, 13) and got[15] == (None, 15)
    assert statements.string_behind(spark.createDataFrame([], STMTS), ["class"]).count() == 0


def test_widget_behind(spark):
    rows = [
        ("A", 1, "i", "77", "int", None, None, None),
        ("A", 2, "v", None, "invoke", "findViewById", None, ["i"]),
        ("A", 3, "b", "v", "cast", None, None, None),
        ("A", 4, None, None, None, "setOnClickListener", "b", ["this"]),
        ("A", 5, "b", "known", "field", None, None, None),
        ("A", 6, "b", "unknown", "field", None, None, None),
        ("A", 7, None, None, None, "setOnClickListener", "b", ["this"]),
        ("A", 8, "b", None, "invoke", "create", None, []),
        ("A", 9, None, None, None, "setOnClickListener", "b", ["this"]),
        ("B", 10, "b", None, "invoke", "findViewById", None, ["5"]),
        ("B", 11, None, None, None, "setOnClickListener", "b", ["this"]),
    ]
    fields = spark.createDataFrame([("A", "known", 9), ("B", "unknown", 8)], "class string, field string, id int")
    got = {r.pos: (r.value, r.origin, r.site) for r in statements.widget_behind(spark.createDataFrame(rows, STMTS), ["class"], fields).collect()}
    assert (got[4], got[7], got[9], got[11]) == (("77", 1, 2), ("9", 5, None), (None, 8, None), ("5", 10, 10))


def test_resource_writers(spark, tmp_path):
    res = spark.createDataFrame([("x", "bool", "dark", 1, "true"), ("x", "integer", "n", 2, "3"), ("y", "drawable", "d<1>", 0x7F010203, None)], "app_id string, type string, name string, id int, value string")
    readers.write_public(res, f"{tmp_path}/values")
    back = spark.read.format("xml").option("rowTag", "public").schema("_type STRING, _name STRING, _id STRING, app_id STRING").load(f"{tmp_path}/values/public")
    assert {tuple(r) for r in back.collect()} == {("bool", "dark", "0x00000001", "x"), ("integer", "n", "0x00000002", "x"), ("drawable", "d<1>", "0x7f010203", "y")}
    readers.write_values(res, f"{tmp_path}/values")
    rows = spark.read.format("xml").option("rowTag", "item").schema("_type STRING, _name STRING, _VALUE STRING, app_id STRING").load(f"{tmp_path}/values/drawables")
    assert [tuple(r) for r in rows.collect()] == [("drawable", "d<1>", str(0x7F010203), "y")]
    readers.write_manifest(spark.createDataFrame([("x", 30, None)], "app_id string, target int, least int"), f"{tmp_path}/manifest")
    assert spark.read.format("xml").option("rowTag", "uses-sdk").schema("_targetSdkVersion STRING").load(f"{tmp_path}/manifest").first()[0] == "30"
    readers.write_sub_layouts(spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "a")], "app_id string, layout string"), f"{tmp_path}/sub")
    assert json.loads(spark.read.text(f"{tmp_path}/sub").first()[0]) == ["a", "b"]


def test_word2vec_mean(spark):
    called = spark.createDataFrame([("a", i, f"n{i}") for i in range(5)] + [("b", 0, "other")], "app_id string, node_id long, name string")
    sets = {1: [(0, 1)], 2: [(1, 2)], 3: [(0, 2)], 4: [(0, 1), (1, 2)]}
    rows = [("a", u, 1, a, b, 0) for u, pairs in sets.items() for a, b in pairs] + [("a", 4, 1, 3, 4, 4), ("a", 5, 1, 3, 4, 4)]
    got = {r.uid: r for r in evaluate.word2vec_mean(spark.createDataFrame(rows, "app_id string, uid long, eid long, src long, dst long, type int"), called, names.KEYS).collect()}
    assert {u: r.n_words for u, r in got.items()} == {1: 2, 2: 2, 3: 2, 4: 3}
    assert all(len(r.vec) == 64 and any(r.vec) for r in got.values())
    for k in range(64):
        assert 3 * got[4].vec[k] == pytest.approx(got[1].vec[k] + got[2].vec[k] + got[3].vec[k], abs=1e-6)


def _write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_more_readers(spark, tmp_path):
    a, b = tmp_path / "A", tmp_path / "B"
    _write(a, "add_info.json", json.dumps({"switchEdges": {"5$7": [{"_1": "<x>", "_2": "<y>"}, {"_1": "<z>", "_2": "<y>"}]}}))
    assert [tuple(r) for r in readers.pair_map(spark, f"{tmp_path}/*/add_info.json", "switchEdges").orderBy("ord").collect()] == [("A", "5$7", 0, "<x>", "<y>"), ("A", "5$7", 1, "<z>", "<y>")]
    _write(a, "arsc_string.json", json.dumps([{"resourceID": 3, "resourceName": "n", "value": "v"}]))
    assert [tuple(r) for r in readers.strings(spark, f"{tmp_path}/*/arsc_string.json").collect()] == [("A", 3, "n", "v")]
    _write(a, "tpl.json", json.dumps([{"Package": "Lcom/x/y"}, {"Package": "Lcom/x/y"}]))
    _write(b, "tpl.json", "{}")
    assert [tuple(r) for r in readers.libraries(spark, f"{tmp_path}/*/tpl.json").collect()] == [("A", "com.x.y")]
    _write(a, "uhg.json", json.dumps([{"time": 0.5}, {"uid": 1, "eid": 2, "size": {"node": 2, "edge": 1}, "edges": ["1 2 4"], "cuid": []}]))
    (g,) = readers.handler_graphs(spark, f"{tmp_path}/*/uhg.json").collect()
    assert (g.app_id, g.uid, g.eid, tuple(g.size), g.edges, g.cuid) == ("A", 1, 2, (2, 1), ["1 2 4"], [])
    _write(a, "manifest.xml", '<manifest><uses-sdk targetSdkVersion="28" minSdkVersion="19"/></manifest>')
    _write(a, "code.log", "x API ver: 26 (a)\ny API ver: 27 (b)\n")
    logs, manifests = readers.logged_levels(spark, f"{tmp_path}/*/code.log"), readers.manifests(spark, f"{tmp_path}/*/manifest.xml")
    assert [tuple(r) for r in manifests.collect()] == [("A", "28", "19")]
    apps = spark.createDataFrame([("A",), ("B",)], "app_id string")
    assert dict(map(tuple, readers.api_levels(apps, logs, manifests).collect())) == {"A": "27", "B": "14"}
    assert dict(map(tuple, readers.api_levels(apps, logs.where("false"), manifests).collect())) == {"A": "28", "B": "14"}
    flow = '<R><Results><Result><Sink Statement="invoke &lt;a: void s(int)&gt;(x)"/><Sources><Source Statement="r = invoke &lt;b: int t()&gt;()"><TaintPath><PathElement Statement="invoke &lt;c: V findViewById(int)&gt;(255)"/><PathElement Statement="x = y"/><PathElement Statement="invoke &lt;d: void u()&gt;(q)"/></TaintPath></Source></Sources></Result></Results></R>'
    _write(a, "data_flow.xml", flow)
    flows = readers.data_flows(spark, f"{tmp_path}/*/data_flow.xml")
    assert [tuple(r) for r in flows.collect()] == [("A", "<a: void s(int)>==x", "<b: int t()>", ["<c: V findViewById(int)>==255", "<d: void u()>==q"])]
    assert [tuple(r) for r in readers.widget_flows(flows).collect()] == [("A", "FF", ["<d: void u()>==q"])]
    for n in "cab":
        _write(tmp_path / "apks", f"{n}.apk", "x")
    assert [r.app_id for r in readers.apps(spark, f"{tmp_path}/apks", 1, 3).collect()] == ["b", "c"]
    _write(tmp_path / "big", "event.xml", "x" * 100)
    assert [tuple(r) for r in readers.too_large(spark, f"{tmp_path}/big/event.xml", 50).collect()] == [("big", "events", "too large", "100")]


def test_writers_read_back(spark, tmp_path):
    raw = spark.createDataFrame([("A", "<x.C: void m()>", 9, 0, 0, 0, None, None, None, "-"), ("A", "w", -4, 0, 0, 1, "C", "l.xml", "5", None), ("A", "<y.D: void n()>", 30, 1, 0, 0, None, None, None, "y.D")], "app_id string, name string, hash int, java int, android int, ui int, class string, xml string, uid string, package string")
    nodes = writers.indexed(raw)
    writers.write_nodes(nodes, f"{tmp_path}/nodes")
    got = spark.read.csv(f"{tmp_path}/nodes", header=True).orderBy("_c0").collect()
    assert [(r._c0, r.Name, r.Class, r.UId) for r in got] == [("0", "w", "C", "5"), ("1", "<x.C: void m()>", "-1", "-1"), ("2", "<y.D: void n()>", "-1", "-1")]
    hashed = spark.createDataFrame([("A", 9, 30, 0), ("A", -4, 9, 4), ("A", 9, 77, 0)], "app_id string, src int, dst int, type int")
    edges = writers.indexed_edges(hashed, nodes)
    writers.write_edges(edges, f"{tmp_path}/edges")
    assert [(r.From, r.To, r.Type) for r in spark.read.csv(f"{tmp_path}/edges", header=True).orderBy("_c0").collect()] == [("0", "1", "4"), ("1", "2", "0")]
    packed = access.packed(edges.selectExpr("app_id", "0L AS uid", "1L AS eid", "CAST(src AS LONG) AS src", "CAST(dst AS LONG) AS dst", "type"))
    writers.write_handler_graphs(packed, f"{tmp_path}/uhg")
    (g,) = json.loads(spark.read.text(f"{tmp_path}/uhg").first().value)
    assert g == {"uid": 0, "eid": 1, "size": {"node": 3, "edge": 2}, "edges": ["0 1 4", "1 2 0"]}
    events = spark.createDataFrame([("A", "l", "5", "onClick"), ("A", "l", "5", "onTouch"), ("A", "l", "6", "onClick")], "app_id string, xml string, uid string, handler string")
    writers.write_events(events, f"{tmp_path}/events")
    back = readers.events(spark, f"{tmp_path}/events")
    assert sorted((r.xml, r.uid, r.handler) for r in back.collect()) == [("l", "5", "onClick"), ("l", "5", "onTouch"), ("l", "6", "onClick")]
    links = spark.createDataFrame([("A", "useEdges", "5", "<m>")], "app_id string, field string, key string, value string")
    pairs = spark.createDataFrame([("A", "switchEdges", "5$7", 0, "<x>", "<y>")], "app_id string, field string, key string, ord int, caller string, callee string")
    writers.write_additional(links, pairs, f"{tmp_path}/info")
    info = f"{tmp_path}/info/app_id=A"
    assert [(r.key, r.value) for r in readers.json_map(spark, info, "useEdges").collect()] == [("5", "<m>")]
    assert [(r.key, r.caller, r.callee) for r in readers.pair_map(spark, info, "switchEdges").collect()] == [("5$7", "<x>", "<y>")]
    views = spark.createDataFrame([("A", "l", "v1", "n", "a\tb", None, "s", None)], "app_id string, xml string, view_id string, name string, text string, hint string, src string, background string")
    writers.write_contexts(views, f"{tmp_path}/context")
    assert [(r.xml, r.view_id, r.name, r.text, r.hint, r.src) for r in readers.ui_context(spark, f"{tmp_path}/context/app_id=A").collect()] == [("l", "v1", "n", "a b", None, "s")]
    texts = spark.createDataFrame([("A", "l", 5, "C", "m", "text", "hello")], "app_id string, xml string, id int, class string, method string, type string, value string")
    writers.write_code_texts(texts, f"{tmp_path}/texts")
    assert json.loads(spark.read.text(f"{tmp_path}/texts").first().value) == {"l": ["5 C m text hello"]}
    writers.write_flows(spark.createDataFrame([("A", "s", "t", ["p"])], "app_id string, sink string, source string, path array<string>"), f"{tmp_path}/flows")
    assert json.loads(spark.read.text(f"{tmp_path}/flows").first().value) == [{"sink": "s", "source": "t", "path": ["p"]}]
    for _ in range(2):
        writers.log_run(spark.createDataFrame([("A", "merge", "ok", 3)], "app_id string, stage string, status string, detail int"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_529_components(spark):
    g, n = _tables(spark, "w m1 4,m1 m2 0,m2 a1 0")
    ops = spark.createDataFrame([("a", IDS["m1"], [3, 3]), ("b", IDS["m1"], [9]), ("a", IDS["m2"], [3, 263]), ("a", IDS["a1"], [0])], "app_id string, node_id long, ops array<int>")
    (row,) = evaluate.uhg_vectors(graph.handler_edges(g, n), ops, names.KEYS).collect()
    assert len(row.vec) == 529 and row.vec[1 + 3] == pytest.approx(2 / 3) and row.vec[1 + 263] == row.vec[1] == pytest.approx(1 / 3)
    assert row.vec[265 + 3] == pytest.approx((2 / 9) ** 0.5) and row.vec[0] == pytest.approx(0.5) and sum(x > 0 for x in row.vec) == 7


def test_comparison_of_encodings(spark):
    rows = [("a", 0, 0), ("a", 1, 1), ("b", 0, 1), ("b", 1, 1)]
    got = {r.encoding: (r.precision, r.recall) for r in evaluate.compare(spark.createDataFrame(rows, "encoding string, truth int, predicted int"), "encoding", "truth", "predicted").collect()}
    assert got == {"a": (1, 1), "b": (0.25, 0.5)}


def test_nearest_of_a_block():
    rng = np.random.default_rng(5)
    far = np.round(rng.normal(size=(700, 8)), 1) + 1e4
    c, ids = np.concatenate([far, np.repeat(far[:3], 60, axis=0)]), np.arange(880) * 3
    row, at, d = evaluate._close(far[:600], c, ids, 10)
    exact = np.round(np.sqrt(((c[None, :, :] - far[:600, None, :]) ** 2).sum(2)), 9)
    order = np.stack([np.lexsort((ids, x))[:10] for x in exact])
    assert (row == np.repeat(np.arange(600), 10)).all() and (at == order.ravel()).all() and (d == np.take_along_axis(exact, order, 1).ravel()).all()
    assert [len(x) for x in evaluate._close(far[:4], c[:3], ids[:3], 10)] == [12, 12, 12]


def test_votes_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(300, 4)), 1)
    rows = spark.createDataFrame([(i, [float(x) for x in v[i % 290]], int(i % 4)) for i in range(300)], "id long, v array<float>, label int")
    votes = lambda block: sorted(map(tuple, evaluate.knn(rows, "id", "v", "label", 7, block).collect()))
    assert len(votes(8192)) == 300 and votes(8192) == votes(100) == votes(37)


def test_starts_of_a_circle_share_what_they_lead_to(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("b", "x"), ("z", "a")], "src string, dst string")
    r = closure.condensed(edges, spark.createDataFrame([("a",), ("b",), ("q",)], "node string"))
    assert r.pairs.count() == 2 and [n for (n,) in r.leaves.select("node").collect()] == ["x"]
    assert sorted(r.of.groupBy("part").count().select("count").collect()) == [(1,), (3,)]


def test_cases_of_graphs_that_share_a_bin_and_of_larger_ones(spark, monkeypatch):
    g = spark.createDataFrame([(app, 0, e, a, b, 0) for app in "ab" for e in (3, 4) for a, b in [(1, 2), (1, 5), (2, 8), *((k, k + 1) for k in range(5, 25)), (25, 5)]], "app_id string, uid long, eid long, src long, dst long, type int")
    cases = spark.createDataFrame([("a", 0, 3, 1, 2), ("b", 0, 4, 1, 5)], CASES)
    want = {("a", 3, 1, 2), ("a", 3, 2, 8), *((app, e, a, b) for app, e in (("a", 4), ("b", 3)) for a, b in [(1, 2), (1, 5), (2, 8), *((k, k + 1) for k in range(5, 25)), (25, 5)]), *(("b", 4, a, b) for a, b in [(1, 5), (5, 6), (6, 7), (7, 8)])}
    rounds = []
    monkeypatch.setattr(within, "reached", lambda *a: rounds.append(1) or closure.reached(*a))
    for largest, n in ((100_000, 0), (10, 1)):
        monkeypatch.setattr(within, "LARGEST", largest)
        assert {(r.app_id, r.eid, r.src, r.dst) for r in graph.prune_cases(g, cases).collect()} == want
        assert len(rounds) == n


def test_laplacian_of_graphs_cut_by_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(g % 7, g, int(a), int(b)) for g in range(300) for a, b in rng.integers(0, 3 + g % 11, (1 + g % 40, 2))]
    table = spark.createDataFrame(rows, "app long, g long, src long, dst long")
    got = {(r.app, r.g): (r.n_nodes, r.eigen_mean) for r in evaluate.spectra(table, ["app", "g"], rows=64).collect()}
    for g in range(300):
        pairs = [(a, b) for _, h, a, b in rows if h == g]
        ids = sorted({x for p in pairs for x in p})
        a = np.zeros((len(ids), len(ids)))
        for x, y in pairs:
            a[ids.index(x), ids.index(y)] = a[ids.index(y), ids.index(x)] = 1
        d = 1 / np.sqrt(a.sum(1))
        want = np.linalg.eigvalsh(np.eye(len(ids)) - d[:, None] * a * d[None, :])[:2].mean()
        assert got[g % 7, g] == (len(ids), pytest.approx(want, abs=1e-12))
    assert len(got) == 300
    assert "FlatMapGroups" not in evaluate.laplacian(table, ["app", "g"])._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_graphs_are_filled_in_by_arrow(spark):
    rows = [("a", g, 1, 0, k, 0) for g in range(3) for k in range(1, 3 + g)]
    g = spark.createDataFrame(rows, "app_id string, uid long, eid long, src long, dst long, type int")
    ops = spark.createDataFrame([("a", 0, [5, 5, 300]), ("a", 1, [5, 2]), ("a", 1, [2]), ("a", 3, [-1])], "app_id string, node_id long, ops array<int>")
    found = evaluate.uhg_vectors(g, ops, names.KEYS)
    for r in found.collect():
        n, held = r.uid + 3, {i: x for i, x in enumerate(r.vec[1:]) if x}
        p = {5: 2 / n, 2: 1 / n}
        assert len(r.vec) == 529 and held == pytest.approx(p | {264 + o: (x * (1 - x)) ** 0.5 for o, x in p.items()})
    assert found.count() == 3 and "try_element_at" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("largest", [0, 12, 10_000])
def test_cases_of_whole_graphs_are_those_by_rounds(spark, monkeypatch, largest):
    rng = np.random.default_rng(9)
    rows = [("a", g % 5, 100 + g, int(a), int(b), int(t)) for g in range(60) for a, b, t in zip(rng.integers(0, 12, 5 + g % 15), rng.integers(0, 12, 5 + g % 15), rng.choice([0, 0, 0, 3, 4], 5 + g % 15), strict=True)]
    cases = [("a", g % 5, 100 + g, int(a), int(b)) for g in range(0, 60, 2) for a, b in rng.integers(0, 12, (2, 2))]
    table, cases = spark.createDataFrame(rows, "app_id string, uid long, eid long, src long, dst long, type int"), spark.createDataFrame(cases, CASES)
    wanted = sorted(map(tuple, graph._without_cases_by_rounds(table, cases.distinct()).collect()))
    monkeypatch.setattr(within, "LARGEST", largest)
    found = graph.prune_cases(table, cases)
    assert sorted(map(tuple, found.select(*table.columns).collect())) == wanted and 0 < len(wanted) < len(rows)
    if largest == 10_000:
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_callees_get_their_names_after_callers_are_met(spark):
    from loomgraph.operators import reduce

    nodes = spark.createDataFrame([("a", i, f"<x.C: void {n}()>") for i, n in enumerate(("m", "k", "l"))], "app_id string, node_id long, name string")
    g = spark.createDataFrame([("a", 9, 0, 0, 1, 0), ("a", 9, 0, 0, 2, 0), ("a", 9, 0, 1, 2, 0)], "app_id string, uid long, eid long, src long, dst long, type int")
    entries = spark.createDataFrame([("a", 9, 0, "<x.C: void m()>", "<y.D: void k()>")], "app_id string, uid long, eid long, caller string, callee string")
    cases = reduce.resolve_cases(entries, nodes, g)[0]
    assert [tuple(r) for r in cases.collect()] == [("a", 9, 0, 0, 1)]
    (line,) = (x for x in cases._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Contains(name" in x)
    assert "dst#" in line and "uid#" not in line


def test_cheapest_union_of_a_block(spark):
    rng = np.random.default_rng(8)
    c = np.concatenate([np.round(rng.normal(size=(300, 6)), 1) + 1e3, np.zeros((1, 6))])
    c[200:260] = c[:60]
    ids, size = rng.permutation(301), rng.integers(1, 9, 301).astype(float)
    best, height = evaluate._cheapest(c[:280], c, size[:280], size, ids[:280], ids)
    cost = np.stack([((c - x) ** 2).sum(1) for x in c[:280]]) * (size[:280, None] * size[None, :] / (size[:280, None] + size[None, :]))
    cost[np.arange(280), np.arange(280)] = np.inf
    want = np.array([np.lexsort((ids, x))[0] for x in cost])
    assert (best == want).all() and (height == cost[np.arange(280), want]).all()
    assert np.isinf(evaluate._cheapest(c[:1], c[:1], size[:1], size[:1], ids[:1], ids[:1])[1]).all()
    rows = spark.createDataFrame([(i, 1.0, [float(x) for x in v]) for i, v in enumerate(c)], "id long, size double, centre array<double>")
    found = evaluate._nearest(rows, 50)
    assert found.count() == 301 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
