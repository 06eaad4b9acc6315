"""Queries over whole apps: links, reduction, resources and access to stored handler graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import access, evaluate, graph, isolate, link, reduce, resources, statements
from . import catalogue
from .catalogue import query
from .fixture import edges, library_class, nodes, own, sql, table
from ..operators.scratch import stored


@query(sql("SELECT DISTINCT w.app_id, w.node_id AS src, m.node_id AS dst, 3 AS type FROM own_ o JOIN nodes w ON w.app_id=o.app_id AND w.uid=o.o_custkey AND w.is_widget JOIN nodes m ON m.app_id=o.app_id AND m.name='<o.M: void m'||o.o_orderkey||'()>' WHERE o_orderpriority='2-HIGH'"))
def link_use_edges(s, d):
    n = stored(nodes(s, d))
    return link.link(_pairs(s, d, "2-HIGH"), n.where("is_widget"), n.where("NOT is_widget"), names.USE)


def _pairs(s, d, priority):
    return own(s, d).where(F.col("o_orderpriority") == priority).select("app_id", F.col("o_custkey").alias("uid"), F.concat(F.lit("<o.M: void m"), "o_orderkey", F.lit("()>")).alias("method"))


_PREFIXES = [("Brand1", 0, None), ("o.", 1, None), ("Brand", 2, "3"), ("o.M", 3, "5"), ("Brand", 9, "7")]


def _merged(s, d):
    """Apps merged with prefixes of which the last three are the own ones of apps 3, 5 and 7."""
    prefixes = s.createDataFrame(_PREFIXES, "prefix string, ord int, app_id string")
    return reduce.merge_app(stored(nodes(s, d)), edges(s, d), prefixes, _pairs(s, d, "2-HIGH"), _pairs(s, d, "1-URGENT"))


@query(sql("SELECT a.app_id, coalesce(u,-2) AS n_uses, coalesce(e,-2) AS n_events FROM (SELECT DISTINCT app_id FROM nodes) a LEFT JOIN (SELECT app_id, count(*) AS u FROM own_ WHERE o_orderpriority='2-HIGH' GROUP BY ALL) USING (app_id) LEFT JOIN (SELECT app_id, count(*) AS e FROM own_ WHERE o_orderpriority='1-URGENT' GROUP BY ALL) USING (app_id)"))
def merge_counts(s, d):
    return _merged(s, d)[2]


_NATIVE = """CASE WHEN is_widget THEN '-' WHEN name LIKE '<android.support.v%' THEN 'android.'||split_part(name,'.',4) WHEN name LIKE '<android.support.%' THEN 'android.'||split_part(name,'.',3) WHEN name LIKE '<com.android.%' THEN 'android.'||split_part(name,'.',3)
  WHEN name LIKE '<java.%' OR name LIKE '<android.%' THEN split_part(split_part(substr(name,2),':',1),'.',1)||'.'||split_part(split_part(substr(name,2),':',1),'.',2)
  WHEN app_id='5' AND name LIKE '<o.M%' THEN 'o.M' WHEN app_id IN ('3','7') AND name LIKE '<Brand%' THEN 'Brand' WHEN name LIKE '<Brand1%' THEN 'Brand1' WHEN name LIKE '<o.%' THEN 'o.' ELSE '-' END"""


@query(sql(f"SELECT app_id, node_id, {_NATIVE} AS package FROM nodes"))
def merge_nodes(s, d):
    return _merged(s, d)[0].select("app_id", "node_id", "package")


@query(sql("SELECT app_id, src, dst, type FROM edges WHERE type NOT IN (3,4) UNION ALL SELECT DISTINCT w.app_id, w.node_id, m.node_id, CASE o_orderpriority WHEN '2-HIGH' THEN 3 ELSE 4 END FROM own_ o JOIN nodes w ON w.app_id=o.app_id AND w.uid=o.o_custkey AND w.is_widget JOIN nodes m ON m.app_id=o.app_id AND m.name='<o.M: void m'||o.o_orderkey||'()>' WHERE o_orderpriority IN ('1-URGENT','2-HIGH')"))
def merge_edges(s, d):
    return _merged(s, d)[1]


_BASE = """base AS (SELECT app_id, o_custkey AS c, o_orderkey AS k, c_mktsegment AS seg, min(l_partkey) AS p, max(l_partkey) AS q FROM own_ JOIN customer ON c_custkey=o_custkey JOIN lineitem ON l_orderkey=o_orderkey WHERE o_orderpriority IN ('1-URGENT','3-MEDIUM') GROUP BY ALL),
switches AS (SELECT app_id, c||'$'||CASE WHEN c%2=0 THEN seg ELSE 'OTHER'||(k%2) END AS key, k AS ord, '<o.M: void m'||k||'()>' AS caller, 'invoke <'||CASE WHEN c%3=0 THEN 'X.Y' ELSE cls END||': void '||CASE WHEN c%7=0 THEN '<init>' ELSE 'a'||p END||'()>()' AS callee FROM base JOIN lib USING (p)),
threads AS (SELECT app_id, c||'$'||seg AS key, k AS ord, '<o.M: void m'||k||'()>' AS caller, '&lt;'||cls||': void a'||q||'()&gt;' AS callee FROM base JOIN lib ON lib.p=q WHERE c%5=0),
handlers AS (SELECT DISTINCT g.app_id, g.uid, g.eid, w.uid AS wid, w.xml, m.name AS event, w.uid||'$'||w.xml AS key FROM graph g JOIN nodes w ON w.app_id=g.app_id AND w.node_id=g.uid JOIN nodes m ON m.app_id=g.app_id AND m.node_id=g.eid),
entries AS (SELECT h.app_id, h.uid, h.eid, caller, callee FROM handlers h JOIN switches USING (app_id, key)
  UNION SELECT h.app_id, h.uid, h.eid, s.caller, s.callee FROM handlers h JOIN switches e ON e.app_id=h.app_id AND split_part(e.key,'$',1)=h.wid::VARCHAR AND e.caller=h.event JOIN switches s ON s.app_id=h.app_id AND s.key=e.key WHERE h.key NOT IN (SELECT key FROM switches)
  UNION SELECT h.app_id, h.uid, h.eid, caller, replace(replace(callee,'&lt;','<'),'&gt;','>') FROM handlers h JOIN threads USING (app_id, key))"""

_CASES = f"""{_BASE}, told AS (SELECT *, CASE WHEN callee LIKE 'invoke %' THEN substr(callee, 8, length(callee)-9) ELSE callee END AS sig FROM entries),
found AS (SELECT e.app_id, e.uid, e.eid, sig, a.node_id AS src, b.node_id AS dst FROM told e LEFT JOIN nodes a ON a.app_id=e.app_id AND a.name=e.caller LEFT JOIN nodes b ON b.app_id=e.app_id AND b.name=e.sig),
cases AS (SELECT app_id, uid, eid, src, dst FROM found WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT f.app_id, f.uid, f.eid, f.src, g.dst FROM found f JOIN graph g ON g.app_id=f.app_id AND g.uid=f.uid AND g.eid=f.eid AND g.src=f.src JOIN nodes n ON n.app_id=f.app_id AND n.node_id=g.dst WHERE f.dst IS NULL AND contains(n.name, substr(f.sig, strpos(f.sig,':'))))"""

_KEPT = "SELECT app_id, uid, eid FROM graph WHERE uid IN (SELECT c_custkey*3 FROM customer WHERE c_custkey%3>0 AND contains(c_name,'r#00000007')) UNION SELECT x.app_id, x.uid, x.eid FROM (SELECT app_id, uid, eid, src AS node FROM graph UNION ALL SELECT app_id, uid, eid, dst FROM graph) x JOIN nodes n ON n.app_id=x.app_id AND n.node_id=x.node WHERE n.package<>'-' AND (contains(lower(name),'brand1') OR contains(lower(name),'void m'))"

_REDUCED = f"""{_CASES}, chosen AS (SELECT * FROM graph WHERE (uid,eid) IN (SELECT (uid,eid) FROM ({_KEPT}))),
seeds AS (SELECT * FROM chosen WHERE type<>4 AND (uid,eid,src) IN (SELECT (uid,eid,src) FROM cases) AND NOT (type=0 AND (uid,eid,src,dst) IN (SELECT (uid,eid,src,dst) FROM cases))),
gone AS (SELECT DISTINCT uid, eid, dst AS node FROM seeds WHERE (uid,eid,dst) NOT IN (SELECT (uid,eid,dst) FROM cases) UNION SELECT n.uid, n.eid, g.dst FROM gone n JOIN chosen g ON g.uid=n.uid AND g.eid=n.eid AND g.src=n.node WHERE (g.uid,g.eid,g.dst) NOT IN (SELECT (uid,eid,dst) FROM cases)),
less AS (SELECT app_id, uid, eid, src, dst, type FROM chosen WHERE (type<>4 OR src=uid) AND (uid,eid,src) NOT IN (SELECT (uid,eid,node) FROM gone) AND (uid,eid,src,dst,type) NOT IN (SELECT (uid,eid,src,dst,type) FROM seeds))"""


def _records(s, d):
    """Switch and thread pairs made from orders and the parts in them."""
    o = own(s, d).where(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"))
    ends = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"), F.max("l_partkey").alias("q"))
    base = o.join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(ends, F.col("l_orderkey") == F.col("o_orderkey"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    part = table(s, d, "part")
    cls = lambda x: part.select(F.col("p_partkey").alias(x), library_class(part).alias("cls"))
    caller = F.concat(F.lit("<o.M: void m"), k, F.lit("()>")).alias("caller")
    call = lambda cls, method, a, b: F.concat(F.lit(a), cls, F.lit(": void "), method, F.lit("()"), F.lit(b)).alias("callee")
    key = F.concat(c, F.lit("$"), F.when(c % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("OTHER"), k % 2))).alias("key")
    named = F.when(c % 7 == 0, "<init>").otherwise(F.concat(F.lit("a"), "p"))
    switches = base.join(cls("p"), "p").select("app_id", key, k.alias("ord"), caller, call(F.when(c % 3 == 0, "X.Y").otherwise(F.col("cls")), named, "invoke <", ">()"))
    threads = base.where(c % 5 == 0).join(cls("q"), "q").select("app_id", F.concat(c, F.lit("$"), "c_mktsegment").alias("key"), k.alias("ord"), caller, call(F.col("cls"), F.concat(F.lit("a"), "q"), "&lt;", "&gt;"))
    return switches, threads


def _handlers(g, n):
    w = n.select("app_id", F.col("node_id").alias("uid"), F.col("uid").alias("wid"), "xml")
    return g.select(*names.KEYS).distinct().join(w, ["app_id", "uid"]).join(n.select("app_id", F.col("node_id").alias("eid"), F.col("name").alias("event")), ["app_id", "eid"])


def _app(s, d):
    n = stored(nodes(s, d))
    g = stored(catalogue.handler_graphs(s, d))
    return n, g, _handlers(g, n), *_records(s, d)


@query(sql(f", {_BASE} SELECT app_id, uid, eid, caller, callee FROM entries"))
def switch_lookup_fallback(s, d):
    return reduce.case_entries(*_app(s, d)[2:])


@query(sql(f", {_CASES} SELECT app_id, uid, eid, src, dst FROM cases"))
def case_resolution(s, d):
    n, g, *rest = _app(s, d)
    return reduce.resolve_cases(reduce.case_entries(*rest), n, g)[0]


def _keep(s, d, g, n):
    """Texts are customers' names, not found for one in three; of the words of the ui one fits as written only, one nothing."""
    c = table(s, d, "customer")
    contexts = c.select(F.col("c_nationkey").cast("string").alias("app_id"), (F.col("c_custkey") * 3).alias("uid"), F.when(F.col("c_custkey") % 3 == 0, resources.MISSING).otherwise(F.col("c_name")).alias("text"))
    return reduce.keep_behaviours(g, contexts, n, ["r#00000007", "FOUND"], ["Brand1", "void M"])


@query(sql(f", kept AS ({_KEPT}) SELECT app_id, uid, eid FROM kept"))
def keep_behaviour(s, d):
    n = stored(nodes(s, d))
    return _keep(s, d, stored(catalogue.handler_graphs(s, d)), n)


@query(sql(f", {_REDUCED} SELECT app_id, uid, eid, src, dst, type FROM less"))
def reduce_app(s, d):
    n, g, *rest = _app(s, d)
    return reduce.reduce_graphs(g, n, *rest, keep=_keep(s, d, g, n))


@query(sql(f", {_REDUCED}, ends AS (SELECT uid, eid, src AS node FROM less UNION SELECT uid, eid, dst FROM less), old_ends AS (SELECT uid, eid, src AS node FROM chosen UNION SELECT uid, eid, dst FROM chosen) SELECT o.app_id, o.uid, o.eid, coalesce(n_nodes,0) AS n_nodes, coalesce(n_edges,0) AS n_edges, old_nodes, old_edges FROM (SELECT app_id, uid, eid, count(*) AS old_edges FROM chosen GROUP BY ALL) o JOIN (SELECT uid, eid, count(*) AS old_nodes FROM old_ends GROUP BY ALL) USING (uid, eid) LEFT JOIN (SELECT uid, eid, count(*) AS n_edges FROM less GROUP BY ALL) USING (uid, eid) LEFT JOIN (SELECT uid, eid, count(*) AS n_nodes FROM ends GROUP BY ALL) USING (uid, eid)"))
def reduced_sizes(s, d):
    n, g, *rest = _app(s, d)
    keep = stored(_keep(s, d, g, n))
    return reduce.sizes_before_and_after(g.join(keep, names.KEYS, "left_semi"), stored(reduce.reduce_graphs(g, n, *rest, keep=keep)))


@query(sql(f", {_CASES.replace('LEFT JOIN nodes a ON', 'LEFT JOIN (SELECT * FROM nodes WHERE node_id%15<>1) a ON')}, lost AS (SELECT app_id, uid, eid, string_agg(DISTINCT sig, ' ' ORDER BY sig) AS inherit FROM found WHERE src IS NULL GROUP BY ALL) SELECT g.app_id, g.uid, g.eid, count(*) AS old_edges, coalesce(inherit,'') AS inherit_methods FROM graph g LEFT JOIN lost l ON l.app_id=g.app_id AND l.uid=g.uid AND l.eid=g.eid GROUP BY g.app_id, g.uid, g.eid, inherit"))
def inherited_methods(s, d):
    """Callees of recorded pairs whose caller no node has, in the stored form; one own method in five is taken out of the look-up."""
    n, g, *rest = _app(s, d)
    cases, lost = reduce.resolve_cases(reduce.case_entries(*rest), n.where("node_id % 15 <> 1"), g)
    rows = reduce.reduced_rows(g, graph.prune_cases(g, stored(cases)), lost)
    return rows.select(*names.KEYS, F.col("old.edge").alias("old_edges"), F.array_join("inherit_methods", " ").alias("inherit_methods"))


_FIRST = "SELECT app_id, uid, eid, src, dst, type FROM (SELECT *, row_number() OVER (PARTITION BY app_id, uid, eid ORDER BY src, dst, type) AS r FROM graph) WHERE r=1"


@query(sql(f"SELECT a.app_id, a.uid, a.eid, n_nodes, n_edges, f.src, f.dst, f.type FROM (SELECT uid, eid, any_value(app_id) AS app_id, count(DISTINCT node) AS n_nodes FROM (SELECT app_id, uid, eid, src AS node FROM graph UNION ALL SELECT app_id, uid, eid, dst FROM graph) GROUP BY uid, eid) a JOIN (SELECT uid, eid, count(*) AS n_edges FROM graph GROUP BY uid, eid) b USING (uid, eid) JOIN ({_FIRST}) f USING (uid, eid)"))
def uhg_access(s, d):
    rows = stored(access.packed(catalogue.handler_graphs(s, d)))
    first = access.edges_of(rows).where("place = 0").drop("place")
    return rows.select(*names.KEYS, F.col("size.node").alias("n_nodes"), F.col("size.edge").alias("n_edges")).join(first, names.KEYS)


@query(sql(f"SELECT u.app_id, b.category, b.name, u.uid, u.eid, w.uid AS wid, w.xml, m.name AS event, n_edges, f.src, f.dst, f.type FROM (SELECT DISTINCT c_mktsegment AS category, '20200101-'||c_nationkey||'-'||(c_custkey%9) AS name, c_nationkey::VARCHAR AS app, c_custkey%9 AS idx FROM customer) b JOIN (SELECT app_id, uid, eid, n_edges, row_number() OVER (PARTITION BY app_id ORDER BY uid, eid)-1 AS idx FROM (SELECT app_id, uid, eid, count(*) AS n_edges FROM graph GROUP BY ALL)) u ON u.app_id=b.app AND u.idx=b.idx JOIN nodes w ON w.app_id=u.app_id AND w.node_id=u.uid JOIN nodes m ON m.app_id=u.app_id AND m.node_id=u.eid JOIN ({_FIRST}) f ON f.uid=u.uid AND f.eid=u.eid"))
def access_chain(s, d):
    n = stored(nodes(s, d))
    rows = access.numbered(access.packed(catalogue.handler_graphs(s, d)))
    bench = table(s, d, "customer").select(F.col("c_mktsegment").alias("category"), F.concat(F.lit("20200101-"), "c_nationkey", F.lit("-"), F.col("c_custkey") % 9).alias("name")).distinct()
    return access.samples(bench, stored(rows), n)


@query("SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN coalesce(p_name,'NOT_FOUND') WHEN 1 THEN coalesce(p_name,'NOT_FOUND') WHEN 2 THEN 'NOT_FOUND' ELSE o_orderpriority END AS value FROM orders LEFT JOIN part ON p_partkey=o_custkey")
def resource_resolve(s, d):
    k = F.col("o_orderkey") % 4
    ref = F.when(k == 0, F.concat(F.lit("@"), names.to_hex(F.col("o_custkey")))).when(k == 1, F.concat(F.lit("@string/s"), "o_custkey")).when(k == 2, "@color/x").otherwise(F.col("o_orderpriority"))
    values = table(s, d, "part").select(F.lit("string").alias("type"), F.concat(F.lit("s"), "p_partkey").alias("name"), F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))
    return resources.resolve_references(table(s, d, "orders").select("o_orderkey", ref.alias("ref")), values).select("o_orderkey", "value")


@query("WITH said AS (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS pos FROM orders GROUP BY ALL), a AS (SELECT o_custkey, string_agg(v,'|' ORDER BY pos) AS s FROM said GROUP BY ALL) SELECT c_mktsegment AS xml, c_custkey AS uid, CASE WHEN c_custkey%3=0 THEN coalesce(s,'NOT_FOUND') ELSE c_name||coalesce('|'||s,'') END AS text FROM customer LEFT JOIN a ON o_custkey=c_custkey")
def context_merge(s, d):
    c = table(s, d, "customer").select(F.col("c_mktsegment").alias("xml"), F.col("c_custkey").alias("uid"), F.when(F.col("c_custkey") % 3 == 0, resources.MISSING).otherwise(F.col("c_name")).alias("text"))
    code = table(s, d, "orders").join(c, F.col("uid") == F.col("o_custkey")).select("xml", "uid", F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value"))
    return resources.merge_texts(c, code)


@query("WITH x AS (SELECT c_mktsegment AS xml, c_custkey AS uid, c_name AS text FROM customer WHERE c_custkey%2=0 UNION ALL SELECT 'ZZ', c_custkey, 'z'||c_custkey FROM customer WHERE c_custkey%3=0) SELECT w.xml, w.uid, coalesce((SELECT min(text) FROM x WHERE x.xml=w.xml AND x.uid=w.uid), (SELECT arg_min(text, xml) FROM x WHERE x.uid=w.uid)) AS text FROM (SELECT CASE WHEN c_custkey%4=0 THEN 'NONE' ELSE c_mktsegment END AS xml, c_custkey AS uid FROM customer) w")
def widget_context(s, d):
    c, k = table(s, d, "customer"), F.col("c_custkey")
    own = c.where(k % 2 == 0).select(F.col("c_mktsegment").alias("xml"), k.alias("uid"), F.col("c_name").alias("text"))
    other = c.where(k % 3 == 0).select(F.lit("ZZ").alias("xml"), k.alias("uid"), F.concat(F.lit("z"), k).alias("text"))
    return resources.widget_context(c.select(F.when(k % 4 == 0, "NONE").otherwise(F.col("c_mktsegment")).alias("xml"), k.alias("uid")), own.unionByName(other))


_FOLDERS = ["xxxhdpi", "xxhdpi", "xhdpi", "hdpi", "mdpi", "ldpi", "nodpi", "anydpi", "v24"]


@query("SELECT name, file FROM (SELECT lower(p_brand) AS name, file, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY rnk, file) AS r FROM (SELECT p_brand, p_size%9 AS rnk, 'res/drawable-'||['xxxhdpi','xxhdpi','xhdpi','hdpi','mdpi','ldpi','nodpi','anydpi','v24'][p_size%9+1]||'/'||p_partkey||'.png' AS file FROM part WHERE p_size%9>1)) WHERE r=1")
def drawable_pick(s, d):
    folder = F.get(F.array(*map(F.lit, _FOLDERS)), F.col("p_size") % 9)
    return resources.pick_drawable(table(s, d, "part").where("p_size % 9 > 1").select(F.col("p_brand").alias("name"), F.concat(F.lit("res/drawable-"), folder, F.lit("/"), "p_partkey", F.lit(".png")).alias("file")))


@query("WITH RECURSIVE i AS (SELECT p_partkey AS layout, p_partkey//2 AS sub FROM part WHERE p_partkey>0), a AS (SELECT layout, sub FROM i UNION SELECT a.layout, i.sub FROM a JOIN i ON i.layout=a.sub) SELECT layout, sub FROM a")
def include_closure(s, d):
    return resources.include_closure(table(s, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("layout"), F.floor(F.col("p_partkey") / 2).cast("bigint").alias("sub")))


@query("SELECT p_partkey AS layout FROM part WHERE p_partkey NOT IN (SELECT p_partkey//2 FROM part WHERE p_partkey>0)")
def top_layouts(s, d):
    p = table(s, d, "part")
    return resources.top_layouts(p.select(F.col("p_partkey").alias("layout")), p.where("p_partkey > 0").select(F.floor(F.col("p_partkey") / 2).cast("bigint").alias("sub")))


@query("SELECT o_orderpriority AS xml, string_agg(uid||'='||h, ';' ORDER BY uid) AS handlers FROM (SELECT o_orderpriority, (o_custkey%7)::VARCHAR AS uid, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS h FROM orders GROUP BY ALL) GROUP BY ALL")
def handler_sets(s, d):
    events = table(s, d, "orders").select(F.col("o_orderpriority").alias("xml"), (F.col("o_custkey") % 7).cast("string").alias("uid"), F.col("o_orderstatus").alias("handler"))
    entries = F.array_sort(F.map_entries("handlers"))
    return resources.handler_sets(events).select("xml", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("handlers"))


@query("SELECT o_orderpriority AS app, count(*) AS registered, count_if(o_custkey%3>0) AS resolved, round(count_if(o_custkey%3>0)/count(*),6) AS share FROM orders GROUP BY ALL")
def resolved_share(s, d):
    events = table(s, d, "orders").select(F.col("o_orderpriority").alias("app"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("uid"))
    return resources.resolved_share(events, "app").withColumn("share", F.round("share", 6))


@query("SELECT doc_id AS xml, pos, nth FROM (SELECT conv_id AS doc_id, turn AS pos, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations)")
def tag_occurrence(s, d):
    views = table(s, d, "conversations").select(F.col("conv_id").alias("xml"), F.col("turn").alias("pos"), F.col("role").alias("tag"))
    return resources.occurrence(views).select("xml", "pos", "nth")


@query(sql("SELECT app_id, node_id, CASE WHEN h>=2147483648 THEN h-4294967296 ELSE h END AS hash FROM (SELECT app_id, node_id, list_reduce(list_transform(string_split(name,''), lambda c: ascii(c)::BIGINT), lambda a, c: (a*31+c) % 4294967296) AS h FROM nodes)"))
def node_hash(s, d):
    return nodes(s, d).select("app_id", "node_id", names.java_hash(F.col("name")).alias("hash"))


@query(sql("SELECT app_id, node_id, to_hex(node_id) AS hex, substr(name, strpos(name,':')) AS suffix, CASE WHEN name LIKE '<%' THEN name END AS signature, split_part(substr(name,2),':',1) AS package, xml AS base, node_id%3=1 AS own FROM nodes WHERE NOT is_widget OR xml IS NULL"))
def name_parts(s, d):
    n, name = nodes(s, d).where("NOT is_widget OR xml IS NULL"), F.col("name")
    descriptor = F.concat(F.lit("L"), F.replace(names.class_of(name), F.lit("."), F.lit("/")))
    return n.select("app_id", "node_id", names.to_hex_upper(F.col("node_id")).alias("hex"), names.method_suffix(name).alias("suffix"), names.signature_in(F.concat(F.lit("invoke "), name, F.lit("(x)"))).alias("signature"), names.tpl_package(descriptor).alias("package"), names.layout_base(F.concat("xml", F.lit(".xml.xml"))).alias("base"), F.col("is_self").alias("own"))


def _ops(s, d):
    n = nodes(s, d).where("NOT is_widget").select("app_id", "node_id", "name", (F.col("node_id") % 5 == 0).alias("is_java"))
    app = own(s, d).where("o_orderkey % 2 = 0").select("app_id", F.concat(F.lit("<o.M: void m"), "o_orderkey", F.lit("()>")).alias("name"), F.array((F.col("o_orderkey") % 264).cast("int"), F.lit(7)).alias("ops"))
    sdk = nodes(s, d).where("NOT is_widget AND NOT is_self AND node_id % 2 = 0").select("name", F.array((F.col("node_id") % 264).cast("int")).alias("ops"))
    return evaluate.opcodes_of(n, app, sdk)


@query(sql("SELECT app_id, node_id, CASE WHEN node_id%3=1 AND (node_id//3)%2=0 THEN ((node_id//3)%264)||',7' WHEN node_id%3=2 AND node_id%2=0 THEN (node_id%264)::VARCHAR WHEN node_id%5=0 THEN '104,15' ELSE '0' END AS ops FROM nodes WHERE NOT is_widget"))
def opcode_fallback(s, d):
    return _ops(s, d).select("app_id", "node_id", F.array_join(F.col("ops").cast("array<string>"), ",").alias("ops"))


@query(None)
def uhg_encode(s, d):
    """529 components of each handler graph."""
    return evaluate.uhg_vectors(catalogue.handler_graphs(s, d), _ops(s, d), names.KEYS)


@query(sql("SELECT a.app_id, a.uid, a.eid, f.flag, round(f.k/a.n,6) AS mean, round(sqrt((f.k/a.n)*(1-f.k/a.n)),6) AS std FROM (SELECT app_id, uid, eid, count(*) AS n FROM ends GROUP BY ALL) a JOIN (SELECT uid, eid, op AS flag, count(*) AS k FROM (SELECT DISTINCT e.uid, e.eid, e.node, unnest(CASE WHEN node%3=1 AND (node//3)%2=0 THEN [(node//3)%264, 7] WHEN node%3=2 AND node%2=0 THEN [node%264] WHEN node%5=0 THEN [104,15] ELSE [0] END) AS op FROM ends e) GROUP BY ALL) f USING (uid, eid)").replace(" SELECT a.app_id, a.uid, a.eid, f.flag", ", ends AS (SELECT app_id, uid, eid, src AS node FROM graph WHERE type=0 UNION SELECT app_id, uid, eid, dst FROM graph WHERE type=0) SELECT a.app_id, a.uid, a.eid, f.flag"))
def uhg_opcode_stats(s, d):
    """The components of uhg_encode that SQL can give: mean and deviation of each opcode that a graph's methods hold."""
    flags = F.arrays_zip(F.slice("vec", 2, 264).alias("mean"), F.slice("vec", 266, 264).alias("std"))
    each = uhg_encode(s, d).select(*names.KEYS, F.posexplode(flags).alias("flag", "x")).where("x.mean > 0")
    return each.select(*names.KEYS, "flag", F.round("x.mean", 6).alias("mean"), F.round("x.std", 6).alias("std"))


@query("SELECT o_custkey AS class, arg_min(o_totalprice::BIGINT, o_orderkey) AS layout FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders WHERE o_orderkey%3=0) GROUP BY ALL")
def content_views(s, d):
    k = F.col("o_orderkey")
    stmts = table(s, d, "orders").select(F.col("o_custkey").alias("class"), k.alias("pos"), F.when(k % 3 == 0, "setContentView").otherwise("inflate").alias("callee"), F.array(F.floor("o_totalprice").cast("string")).alias("args"))
    return statements.content_views(stmts, ["class"])


@query("SELECT DISTINCT (c.o_orderkey//5%4)||'$k' AS key, '<o.M: void h'||s.o_custkey||'()>' AS caller, '<o.C: void c'||(s.o_orderkey%9)||'()>' AS callee FROM orders s JOIN orders c ON c.o_custkey=s.o_custkey AND c.o_orderkey = (SELECT max(t.o_orderkey) FROM orders t WHERE t.o_custkey=s.o_custkey AND t.o_orderkey%5=0 AND t.o_orderkey<=s.o_orderkey) WHERE s.o_orderkey%5 IN (1,2) AND c.o_orderkey//5%4<3")
def switch_edges(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 5 == 0, "case").when(k % 5 < 3, "invoke").otherwise("other")
    stmts = table(s, d, "orders").select("o_custkey", k.alias("pos"), kind.alias("kind"), F.concat(F.lit("<o.M: void h"), c, F.lit("()>")).alias("caller"), (F.floor(k / 5) % 4).cast("int").alias("test"), F.concat(F.lit("<o.C: void c"), k % 9, F.lit("()>")).alias("callee"))
    cases = s.range(3).select(F.col("id").cast("int").alias("condition"), F.concat("id", F.lit("$k")).alias("key"))
    return statements.switch_edges(stmts, ["o_custkey"], "caller", "test", cases)


@query("SELECT DISTINCT o_custkey AS id, 'm'||o_orderkey AS method FROM orders WHERE o_orderkey%11=o_custkey%11")
def field_uses(s, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    stmts = table(s, d, "orders").select(c.alias("class"), F.concat(F.lit("m"), k).alias("method"), F.concat(F.lit("x = r0.<C: View f"), k % 11, F.lit(">")).alias("text"))
    fields = table(s, d, "customer").select(F.col("c_custkey").alias("class"), F.concat(F.lit("f"), F.col("c_custkey") % 11).alias("field"), F.col("c_custkey").alias("id"))
    return statements.field_uses(stmts, fields)


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey%4 AS kind, 'v'||(o_orderkey%3) AS lhs, CASE o_orderkey%4 WHEN 1 THEN 'v'||(o_orderkey//4%3) WHEN 2 THEN 'v'||(o_orderkey//4%3) WHEN 3 THEN 'v'||(o_orderkey//5%3) END AS want FROM orders),
p AS (SELECT s.*, (SELECT max(d.k) FROM s d WHERE d.c=s.c AND d.kind<3 AND d.lhs=s.want AND d.k<s.k) AS up FROM s),
walk AS (SELECT c, k, up, k AS at_ FROM p WHERE kind=3 UNION ALL SELECT w.c, w.k, p.up, p.k FROM walk w JOIN p ON p.c=w.c AND p.k=w.up)
SELECT w.c AS o_custkey, w.k AS pos, '<o.T'||(w.at_%13)||': void run()>' AS method FROM walk w JOIN p ON p.c=w.c AND p.k=w.at_ WHERE p.kind=0""")
def thread_starts(s, d):
    k = F.col("o_orderkey")
    kind, var = k % 4, lambda n: F.concat(F.lit("v"), (F.floor(k / n) % 3).cast("string"))
    none = F.lit(None).cast("string")
    stmts = table(s, d, "orders").select(
        "o_custkey",
        k.alias("pos"),
        F.when(kind < 3, var(1)).alias("lhs"),
        F.when(kind == 0, F.concat(F.lit("o.T"), k % 13)).when(kind == 1, var(4)).when(kind == 2, "java.lang.Thread").alias("rhs"),
        F.when(kind == 1, "local").when(kind < 3, "new").alias("rhs_kind"),
        F.when(kind == 3, "start").otherwise(none).alias("callee"),
        F.when(kind == 3, var(5)).alias("receiver"),
        F.when(kind == 2, F.array(var(4))).otherwise(F.array().cast("array<string>")).alias("args"),
    )
    return statements.thread_starts(stmts, ["o_custkey"])


def _broken(s, d):
    """The fixture with faults: app 3 has nodes without a name, 5 nodes twice, 7 edges to no node, 11 an unknown type, 13 two of these."""
    n, e = nodes(s, d), edges(s, d)
    app, k = F.col("app_id"), F.col("node_id")
    n = n.withColumn("name", F.when(app.isin("3", "13") & (k % 10 == 0), None).otherwise(F.col("name")))
    n = n.unionByName(n.where(app.isin("5", "13") & (k % 9 == 0)))
    e = e.withColumn("type", F.when((app == "11") & (F.col("src") % 7 == 0), 9).otherwise(F.col("type")))
    return stored(n), stored(e.unionByName(e.where((app == "7") & (F.col("dst") % 5 == 0)).withColumn("dst", F.col("dst") + 10**12)))


_FAULTS = """bn AS (SELECT * REPLACE (CASE WHEN app_id IN ('3','13') AND node_id%10=0 THEN NULL ELSE name END AS name) FROM nodes),
b AS (SELECT app_id, 'node without name' AS fault, count(*) AS n FROM (SELECT * FROM bn UNION ALL SELECT * FROM bn WHERE app_id IN ('5','13') AND node_id%9=0) WHERE name IS NULL GROUP BY ALL
  UNION ALL SELECT app_id, 'node id given twice', count(*) FROM nodes WHERE app_id IN ('5','13') AND node_id%9=0 GROUP BY ALL
  UNION ALL SELECT app_id, 'unknown edge type', count(*) FROM edges WHERE app_id='11' AND src%7=0 GROUP BY ALL
  UNION ALL SELECT app_id, 'edge to no node', count(DISTINCT dst) FROM edges WHERE app_id='7' AND dst%5=0 GROUP BY ALL)"""


@query(sql(f", {_FAULTS} SELECT a.app_id, 'call counts' AS stage, CASE WHEN f.why IS NULL THEN 'ok' ELSE 'failed' END AS status, coalesce(f.why, coalesce(c.n,0)::VARCHAR) AS detail FROM (SELECT DISTINCT app_id FROM nodes) a LEFT JOIN (SELECT app_id, string_agg(fault||': '||n, ', ' ORDER BY fault) AS why FROM b GROUP BY ALL) f USING (app_id) LEFT JOIN (SELECT app_id, count(DISTINCT src) AS n FROM edges WHERE type=0 GROUP BY ALL) c USING (app_id)"))
def run_log(s, d):
    """A job over all apps, five of them broken: what became of each."""
    return isolate.run(*_broken(s, d), "call counts", _callers)[1]


@query(sql(f", {_FAULTS} SELECT app_id, src, count(*) AS n FROM edges WHERE type=0 AND app_id NOT IN (SELECT app_id FROM b) GROUP BY ALL"))
def sound_apps(s, d):
    """The same job's result: the calls of each caller in the apps that are not broken."""
    return isolate.run(*_broken(s, d), "call counts", _callers)[0]


def _callers(n, e):
    return e.where(F.col("type") == names.CALL).groupBy("app_id", "src").agg(F.count("*").alias("n"))
