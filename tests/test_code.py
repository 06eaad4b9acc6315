"""Hand-made code, markup and broken apps with known results."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import code, isolate, markup, statements

STMTS = "app_id string, class string, method string, pos long, kind string, lhs string, lhs_kind string, rhs string, rhs_kind string, callee string, receiver string, args array<string>, target long"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def program(spark, *lines, app="A", cls="Main", method="onCreate", start=0):
    """Lines: `v = new C`, `v = this`, `v = 5`, `v = w`, `v = (cast) w`, `v = .f`, `.f = v`, `v = r.call(args)`, `r.call(args)`, `if a b -> n`, `case n`."""
    out = []
    for pos, line in enumerate(lines, start):
        row = dict.fromkeys(("lhs", "lhs_kind", "rhs", "rhs_kind", "callee", "receiver", "target")) | {"kind": "other", "args": []}
        if line.startswith("if "):
            a, b, _, n = line[3:].split()
            row |= {"kind": "if", "args": [a, b], "target": int(n)}
        elif line.startswith("case "):
            row |= {"kind": "case", "args": [line[5:]]}
        else:
            left, right = line.split(" = ") if " = " in line else (None, line)
            if left:
                row |= {"lhs": left.lstrip("."), "lhs_kind": "field" if left[0] == "." else "local"}
            if right.endswith(")"):
                receiver, call = right.split(".", 1)
                name, args = call[:-1].split("(")
                row |= {"receiver": receiver, "callee": name, "args": [x for x in args.split(",") if x], "rhs_kind": "invoke" if left else None}
            elif right.startswith("new "):
                row |= {"rhs": right[4:], "rhs_kind": "new"}
            elif right.startswith("(cast) "):
                row |= {"rhs": right[7:], "rhs_kind": "cast"}
            elif right.startswith("."):
                row |= {"rhs": right[1:], "rhs_kind": "field"}
            else:
                row |= {"rhs": right, "rhs_kind": "this" if right == "this" else "int" if right.isdigit() else "local"}
        out.append((app, cls, method, pos, row["kind"], *(row[c] for c in ("lhs", "lhs_kind", "rhs", "rhs_kind", "callee", "receiver", "args", "target"))))
    return spark.createDataFrame(out, STMTS)


@pytest.fixture
def main(spark):
    return program(spark, "r.setContentView(700)", "a = this.findViewById(5)", "b = (cast) a", ".title = b", "i = r.inflate(800,null)", ".panel = i", "k = 9", "c = i.findViewById(k)", "l = new Touch", "b.setOnClickListener(l)", "c.setOnTouchListener(this)", "d = .title", "d.setOnKeyListener(null)", "e = .panel", "g = e.findViewById(6)", "m = l", "g.setOnClickListener(m)", "z.setOnClickListener(l)")


def test_fields_hold_what_they_were_given(spark, main):
    other = program(spark, "a = this.findViewById(1)", "a = this.toString()", ".title = a", app="B")
    assert rows(code.class_fields(main.unionByName(other))) == [("A", "Main", "panel", "l", "800", "onCreate", 5), ("A", "Main", "title", "w", "5", "onCreate", 3)]


def test_found_widgets(spark, main):
    assert rows(code.found_widgets(main)) == [("A", u, "Main", "onCreate") for u in "569"]


def test_events(spark, main):
    """Listeners made before, `this`, none; widgets found, held by fields; layouts inflated, held, shown, unknown; dialogs."""
    box = program(spark, "a = this.findViewById(5)", "a.setOnClickListener(this)", cls="Box")
    lone = program(spark, "a = this.findViewById(5)", "t = this", "a.setOnClickListener(t)", cls="Lone", app="B")
    stmts = main.unionByName(box).unionByName(lone)
    parents = spark.createDataFrame([("Box", "Base"), ("Base", code.DIALOGS[0]), ("Main", "android.app.Activity")], "class string, parent string")
    got = rows(code.events(stmts, code.class_fields(stmts), parents))
    assert got == [("A", "700", "5", "Touch", "onClick"), ("A", "800", "6", "Touch", "onClick"), ("A", "800", "9", "Main", "onTouch"), ("B", "NO_ID", "5", "Lone", "onClick")]


def test_blocks_and_tests(spark):
    s = program(spark, "v = 5", "if x 7 -> 4", "if x v -> 6", "r.a()", "r.b()", "r.c()", "r.d()", "case 8", "r.e()", "case 9", "r.f()")
    assert rows(code.branch_tests(s), "number", "kind", "block") == [("5", "if", 6), ("7", "if", 4), ("8", "case", 7), ("9", "case", 9)]
    got = rows(code.blocks(s), "kind", "block", "pos")
    assert [g for g in got if g[0] == "if"] == [("if", 4, 4), ("if", 4, 5)] + [("if", 6, k) for k in range(6, 11)]
    assert [g for g in got if g[0] == "case"] == [("case", 7, 7), ("case", 7, 8), ("case", 9, 9), ("case", 9, 10)]


def test_handlers(spark):
    """With branches for the widget only these count; without, all threads and named fields."""
    setup = program(spark, "a = this.findViewById(5)", ".five = a", "b = this.findViewById(6)", ".six = b", cls="Page")
    click = program(spark, "t = new Job", "if x 5 -> 4", "r.other()", "t.start()", "q = .six", "r.wanted()", "t.start()", "case 7", cls="Page", method="onClick", start=0)
    stmts = setup.withColumn("pos", F.col("pos") + 100).unionByName(click)
    events = spark.createDataFrame([("A", "lay", "5", "Page", "onClick"), ("A", "lay", "6", "Page", "onClick"), ("B", "lay", "5", "Page", "onClick")], "app_id string, xml string, uid string, listener string, handler string")
    switches, threads, uses = code.parse_handlers(stmts, events, code.class_fields(stmts))
    caller = "<Page: void onClick()>"
    assert rows(switches) == [("A", "5$lay", 5, caller, "wanted"), ("A", "5$lay", 6, caller, "start")]
    assert rows(threads) == [("A", "5$lay", 6, caller, "<Job: void run()>"), ("A", "6$lay", 3, caller, "<Job: void run()>"), ("A", "6$lay", 6, caller, "<Job: void run()>")]
    assert rows(uses) == [("A", "5", caller), ("A", "6", caller)]


XML = """<?xml version="1.0"?><!-- a <b> --><Root id="r">
<Row id='one'><Text text="a > b"/><Row><Text/></Row></Row>
<include layout="@layout/sub"/></Root>"""


def test_tree(spark):
    docs = spark.createDataFrame([("main", XML), ("sub", "<Sub><Leaf/></Sub>"), ("none", None), ("empty", ""), ("odd", "</x><a><br><b>t</b></a></a><c>")], "name string, text string")
    elements = markup.tree(docs, "name", "text")
    got = rows(elements, "name", "ordinal", "parent", "depth", "tag")
    assert [g[1:] for g in got if g[0] == "main"] == [(0, -1, 0, "Root"), (1, 0, 1, "Row"), (2, 1, 2, "Text"), (3, 1, 2, "Row"), (4, 3, 3, "Text"), (5, 0, 1, "include")]
    assert [g[1:] for g in got if g[0] == "odd"] == [(0, -1, 0, "a"), (1, 0, 1, "br"), (2, 0, 1, "b"), (3, -1, 0, "c")]
    named = rows(elements.where("name = 'main'").select("ordinal", markup.attribute("id").alias("id"), markup.attribute("text").alias("text")))
    assert named[:3] == [(0, "r", None), (1, "one", None), (2, None, "a > b")]
    holds = rows(markup.hold_edges(elements, "name"))
    assert [h for h in holds if h[0] == "main"] == [("main", 0, "main", 1), ("main", 0, "sub", 0), ("main", 1, "main", 2), ("main", 1, "main", 3), ("main", 3, "main", 4)]


def test_deep_markup(spark):
    deep = "<d>" * 2000 + "</d>" * 2000
    got = markup.tree(spark.createDataFrame([(1, deep)], "k long, t string"), "k", "t")
    assert got.where("parent = ordinal - 1 AND depth = ordinal").count() == 2000


def test_broken_apps_are_left_out(spark):
    nodes = spark.createDataFrame([("ok", 1, "a"), ("ok", 2, "b"), ("bad", 1, "a"), ("bad", 1, None), ("lost", 1, "a"), ("null", None, "x")], "app_id string, node_id long, name string")
    edges = spark.createDataFrame([("ok", 1, 2, 0), ("ok", -10, 1, 2), ("lost", 1, 7, 0), ("lost", 1, 1, 9), ("only", None, 1, 0)], "app_id string, src long, dst long, type int")
    seen = []

    def work(n, e):
        seen.extend(r.app_id for r in n.select("app_id").distinct().collect())
        return e.groupBy("app_id", "src").count()

    out, log = isolate.run(nodes, edges, "links", work)
    assert seen == ["ok"] and rows(out) == [("ok", -10, 1), ("ok", 1, 1)]
    assert rows(log) == [
        ("bad", "links", "failed", "node id given twice: 1, node without name: 1"),
        ("lost", "links", "failed", "edge to no node: 1, unknown edge type: 1"),
        ("null", "links", "failed", "node without id: 1"),
        ("ok", "links", "ok", "2"),
        ("only", "links", "failed", "edge to no node: 1, edge without end: 1"),
    ]


def test_texts_by_the_type_of_the_argument(spark):
    said = [(1, "99", "int"), (2, "98", "int"), (3, "99", "java.lang.String"), (4, "hi", "java.lang.CharSequence"), (5, "hi", "android.text.Spanned"), (6, "99", None), (7, "hi", None), (8, None, "java.lang.String")]
    made = lambda what, kind: spark.createDataFrame([("A", k, v) for k, v in what], f"class string, pos int, {kind} string")
    texts, ids = made([(k, v) for k, v, _ in said], "value"), made([(k, "7") for k in range(1, 8)], "value")
    setters = spark.createDataFrame([("A", k, "setTitle", t) for k, _, t in said] + [("A", 1, "setTag", "int")], "class string, pos int, callee string, arg_type string")
    strings = spark.createDataFrame([(99, "named"), (99, "other"), (None, "x")], "id long, value string")
    got = rows(statements.code_texts(texts, ids, setters, strings, ["class"]), "pos", "id", "type", "value")
    assert got == [(1, "7", "title", "named"), (3, "7", "title", "99"), (4, "7", "title", "hi"), (6, "7", "title", "named"), (7, "7", "title", "hi")]
    assert statements.code_texts(texts.limit(0), ids, setters, strings, ["class"]).count() == 0
