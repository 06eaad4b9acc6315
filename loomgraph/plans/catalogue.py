"""All named queries of the graph engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import access, evaluate, graph, link, markup, projection, resources, statements
from ..operators.scratch import folder, stored
from ..sources import readers
from ..streaming import increment
from .fixture import SQL, edges, hop1_sql, nodes, own, sql, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return add


def handler_graphs(s: SparkSession, d: str, **kw) -> DataFrame:
    return graph.handler_edges(stored(edges(s, d, **kw)), stored(nodes(s, d)))


@query(sql("SELECT app_id, node_id, name, is_self, is_widget, uid, xml, package FROM nodes"))
def node_table(s, d):
    return nodes(s, d)


@query(sql("SELECT app_id, src, dst, type FROM edges"))
def edge_table(s, d):
    return edges(s, d)


@query(sql("SELECT app_id, type, count(*) AS n FROM edges GROUP BY app_id, type"))
def edge_type_counts(s, d):
    return edges(s, d).groupBy("app_id", "type").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT 'android.support.v4.media.X'||(c_custkey%7) AS cls, c_custkey FROM customer UNION ALL SELECT 'com.android.internal.t'||(c_custkey%5), c_custkey FROM customer UNION ALL SELECT 'java.util.L'||c_custkey, c_custkey FROM customer)
SELECT cls, c_custkey, CASE WHEN starts_with(cls,'android.support.v') THEN 'android.'||split_part(cls,'.',4) WHEN starts_with(cls,'com.android.') THEN 'android.'||split_part(cls,'.',3) ELSE split_part(cls,'.',1)||'.'||split_part(cls,'.',2) END AS package FROM c""")
def package_native(s, d):
    c = table(s, d, "customer").select("c_custkey")
    forms = F.array(F.concat(F.lit("android.support.v4.media.X"), F.col("c_custkey") % 7), F.concat(F.lit("com.android.internal.t"), F.col("c_custkey") % 5), F.concat(F.lit("java.util.L"), "c_custkey"))
    return c.select(F.explode(forms).alias("cls"), "c_custkey").withColumn("package", names.native_package(F.col("cls")))


@query(sql("SELECT n.app_id, n.node_id, n.name, coalesce((SELECT min_by(prefix, ord) FROM (VALUES ('Brand1',0),('Brand2',1),('Brand23',2),('o.',3)) t(prefix,ord) WHERE starts_with(substr(n.name,2), prefix)),'-') AS package FROM nodes n WHERE NOT is_widget"))
def package_prefix(s, d):
    prefixes = s.createDataFrame([("Brand1", 0), ("Brand2", 1), ("Brand23", 2), ("o.", 3)], "prefix string, ord int")
    return link.package_of(nodes(s, d).where("NOT is_widget").select("app_id", "node_id", "name"), prefixes).select("app_id", "node_id", "name", "package")


@query("SELECT o_orderkey, lower(to_hex(o_orderkey)) AS hex, o_orderkey AS back FROM orders")
def hex_dec_roundtrip(s, d):
    h = names.to_hex(F.col("o_orderkey"))
    return table(s, d, "orders").select("o_orderkey", h.alias("hex"), names.from_hex(h).alias("back"))


@query("SELECT c_custkey, c_custkey||'$'||c_mktsegment AS key, c_custkey::VARCHAR AS uid, c_mktsegment AS xml FROM customer")
def composite_key(s, d):
    k = table(s, d, "customer").select("c_custkey", names.composite(F.col("c_custkey"), F.col("c_mktsegment")).alias("key"))
    return k.withColumn("uid", F.substring_index("key", "$", 1)).withColumn("xml", F.substring_index("key", "$", -1))


_TYPES = ["void", "boolean", "byte", "short", "char", "int", "long", "float", "double", "java.lang.String", "a.B<c.D>", "int[][]", "a.b.C[]"]
_CODES = ["V", "Z", "B", "S", "C", "I", "J", "F", "D", "Ljava/lang/String;", "La/B;", "[[I", "[La/b/C;"]
_list_of = lambda words: "[" + ",".join(f"'{w}'" for w in words) + "]"


@query(f"SELECT DISTINCT a||' m'||p_size||'('||CASE WHEN p_size%4=0 THEN '' ELSE b||CASE WHEN p_size%4=2 THEN ','||a ELSE '' END END||')' AS java, 'm'||p_size||'('||CASE WHEN p_size%4=0 THEN '' ELSE y||CASE WHEN p_size%4=2 THEN x ELSE '' END END||')'||x AS smali FROM (SELECT p_size, {_list_of(_TYPES)}[p_partkey%13+1] AS a, {_list_of(_TYPES)}[p_size%13+1] AS b, {_list_of(_CODES)}[p_partkey%13+1] AS x, {_list_of(_CODES)}[p_size%13+1] AS y FROM part)")
def smali_signature(s, d):
    """Signatures that parts stand for: the type by the key, the first argument by the size, in four shapes."""
    p, types = table(s, d, "part"), F.array(*map(F.lit, _TYPES))
    a, b, shape = F.get(types, F.col("p_partkey") % 13), F.get(types, F.col("p_size") % 13), F.col("p_size") % 4
    args = F.when(shape == 0, "").when(shape == 2, F.concat(b, F.lit(","), a)).otherwise(b)
    return p.select(F.concat(a, F.lit(" m"), "p_size", F.lit("("), args, F.lit(")")).alias("java")).distinct().withColumn("smali", names.smali_method(F.col("java")))


@query(sql("SELECT app_id, node_id, CASE WHEN regexp_matches(name,'^<(android|androidx|com\\.android)\\.') THEN 'ANDROID' WHEN regexp_matches(name,'^<(java|javax|com\\.sun)\\.') THEN 'JAVA' ELSE 'METHOD' END AS kind, split_part(substr(name,2),':',1) AS cls FROM nodes WHERE NOT is_widget"))
def node_kinds(s, d):
    return nodes(s, d).where("NOT is_widget").select("app_id", "node_id", names.node_kind(F.col("name")).alias("kind"), names.class_of(F.col("name")).alias("cls"))


@query(sql("SELECT DISTINCT w.app_id, w.node_id AS src, m.node_id AS dst, 4 AS type FROM own_ o JOIN nodes w ON w.app_id=o.app_id AND w.uid=o.o_custkey AND w.is_widget JOIN nodes m ON m.app_id=o.app_id AND m.name='<o.M: void m'||o.o_orderkey||'()>' WHERE o_orderpriority='1-URGENT'"))
def link_event_edges(s, d):
    n = stored(nodes(s, d))
    pairs = own(s, d).where("o_orderpriority = '1-URGENT'").select("app_id", F.col("o_custkey").alias("uid"), F.concat(F.lit("<o.M: void m"), "o_orderkey", F.lit("()>")).alias("method"))
    return link.link(pairs, n.where("is_widget"), n.where("NOT is_widget"), names.EVENT)


@query(sql("SELECT app_id, src, dst, type FROM edges WHERE type<>3 UNION ALL SELECT DISTINCT app_id, src, dst, 3 FROM edges WHERE type=4"))
def replace_edges_of_type(s, d):
    e = edges(s, d)
    return link.replace_type(e, e.where("type = 4").select("app_id", "src", "dst", F.lit(3).alias("type")).distinct(), names.USE)


@query(sql("SELECT app_id, src, string_agg(dst||':'||type, ' ' ORDER BY dst, type) AS next FROM (SELECT app_id, CASE WHEN type=2 THEN dst ELSE src END AS src, CASE WHEN type=2 THEN src ELSE dst END AS dst, type FROM edges WHERE type<>1) GROUP BY app_id, src"))
def adjacency(s, d):
    lists = graph.adjacency(edges(s, d)).groupBy("app_id", "src").agg(F.array_sort(F.collect_list(F.struct("dst", "type"))).alias("n"))
    return lists.select("app_id", "src", F.array_join(F.transform("n", lambda x: F.concat_ws(":", x["dst"].cast("string"), x["type"].cast("string"))), " ").alias("next"))


@query(sql("SELECT app_id, seed, node FROM reach0"))
def reach_hop0(s, d):
    e = stored(edges(s, d))
    return graph.reach(e, nodes(s, d), e.where("type = 4").select("app_id", F.col("dst").alias("seed")), 0)


@query(hop1_sql("SELECT DISTINCT app_id, seed, node FROM deep"))
def reach_hop1(s, d):
    e = stored(edges(s, d, callbacks=True))
    return graph.reach(e, nodes(s, d), e.where("type = 4").select("app_id", F.col("dst").alias("seed")), 1)


@query(hop1_sql("SELECT app_id, uid, eid, src, dst, type FROM every1 WHERE (uid,eid) IN (SELECT (uid,eid) FROM every1 GROUP BY uid,eid HAVING count(*)>1)"))
def uhg_edges_hop1(s, d):
    return graph.handler_edges(stored(edges(s, d, callbacks=True)), stored(nodes(s, d)), 1)


@query(sql(", beyond AS (SELECT app_id, p*3+2 AS seed, p*3+2 AS node FROM parts UNION SELECT r.app_id, r.seed, e.dst FROM beyond r JOIN ok e ON e.app_id=r.app_id AND e.src=r.node AND e.api_call) SELECT app_id, seed, node FROM beyond"))
def reach_unbounded(s, d):
    """Hop -1 among library methods, from each of them."""
    n = stored(nodes(s, d))
    library = n.where("NOT is_self AND NOT is_widget").select("app_id", "node_id")
    return graph.reach(stored(edges(s, d).join(library.withColumnRenamed("node_id", "src"), ["app_id", "src"], "left_semi")), n, library.select("app_id", F.col("node_id").alias("seed")), -1)


@query(sql(", every AS (SELECT app_id, eid AS node FROM events_ UNION SELECT r.app_id, e.dst FROM every r JOIN ok e ON e.app_id=r.app_id AND e.src=r.node) SELECT app_id, node FROM every"))
def reached_by_handlers(s, d):
    """What the handlers of an app reach together without a limit of hops."""
    return graph.reached_by_app(stored(edges(s, d)), nodes(s, d))


@query(sql(", walk AS (SELECT app_id, src, dst FROM ok WHERE type=0 AND src%3=1 AND dst%3=1 UNION SELECT w.app_id, w.src, f.dst FROM walk w JOIN ok f ON f.app_id=w.app_id AND f.src=w.dst AND f.type=0 AND f.dst%3=1), twins AS (SELECT a.app_id, a.src AS node, a.dst AS other FROM walk a JOIN walk b ON b.app_id=a.app_id AND b.src=a.dst AND b.dst=a.src WHERE a.src<>a.dst) SELECT app_id, node, min(other) AS least, count(*) AS n FROM (SELECT * FROM twins UNION SELECT app_id, node, node FROM twins) GROUP BY app_id, node"))
def strong_components(s, d):
    """Own methods that call each other in a circle: the least of each circle and its size."""
    return graph.circles(edges(s, d), nodes(s, d))


@query(sql("SELECT a.app_id, a.uid, a.eid, n_nodes, n_edges FROM (SELECT app_id, uid, eid, count(DISTINCT node) AS n_nodes FROM (SELECT app_id, uid, eid, src AS node FROM graph UNION ALL SELECT app_id, uid, eid, dst FROM graph) GROUP BY ALL) a JOIN (SELECT app_id, uid, eid, count(*) AS n_edges FROM graph GROUP BY ALL) b USING (app_id, uid, eid)"))
def uhg_size(s, d):
    return graph.sizes(handler_graphs(s, d))


@query(sql("SELECT app_id, uid, eid, src, dst, type FROM graph"))
def uhg_edges(s, d):
    return handler_graphs(s, d)


@query(sql("SELECT h.app_id, h.uid, h.eid, h.src AS child FROM (SELECT app_id, uid, eid, src, count(*) AS held FROM graph WHERE type IN (3,4) AND src%3=0 GROUP BY ALL) h JOIN (SELECT app_id, src, count(*) AS total FROM edges WHERE type IN (3,4) GROUP BY ALL) t USING (app_id, src) WHERE held=total AND h.src<>h.uid"))
def child_ui(s, d):
    return graph.child_widgets(handler_graphs(s, d), edges(s, d), nodes(s, d))


@query("SELECT doc_id FROM documents WHERE contains(lower(text),'the') OR contains(lower(text),'und ')")
def keep_by_text(s, d):
    return link.keep_by_words(table(s, d, "documents"), "text", ["the", "Und "]).select("doc_id")


@query(sql("SELECT DISTINCT graph.app_id, graph.uid, eid FROM graph JOIN nodes ON nodes.app_id=graph.app_id AND dst=node_id WHERE package<>'-' AND (contains(lower(name),'brand1') OR contains(lower(name),'brand55'))"))
def keep_by_method(s, d):
    api = link.keep_by_words(nodes(s, d).where("package <> '-'"), "name", ["brand1", "Brand55"]).select("app_id", F.col("node_id").alias("dst"))
    return handler_graphs(s, d).join(api, ["app_id", "dst"], "left_semi").select("app_id", "uid", "eid").distinct()


@query(sql("SELECT app_id, node_id, NOT contains(name,'(') OR contains(split_part(split_part(name,':',-1),'(',1),'m1') OR contains(split_part(name,':',1),'Brand2') AS noise FROM nodes"))
def noise_filter(s, d):
    return nodes(s, d).select("app_id", "node_id", names.is_noise(F.col("name"), ["m1"], ["Brand2"]).alias("noise"))


@query(sql("SELECT app_id, uid, eid, src, dst, type FROM graph WHERE type<>4 OR src=uid"))
def prune_events(s, d):
    return graph.prune_events(handler_graphs(s, d))


_CASE = """cases AS (SELECT app_id, uid, eid, eid AS src, min(dst) AS dst FROM graph WHERE src=eid AND type=0 AND dst%3=2 GROUP BY ALL UNION ALL SELECT DISTINCT app_id, uid, eid, src, -1 FROM graph WHERE type=0 AND src<>eid AND src%15=1),
seeds AS (SELECT b.* FROM graph b WHERE b.type<>4 AND (uid,eid,src) IN (SELECT (uid,eid,src) FROM cases) AND NOT (type=0 AND (uid,eid,src,dst) IN (SELECT (uid,eid,src,dst) FROM cases))),
gone AS (SELECT DISTINCT uid, eid, dst AS node FROM seeds WHERE (uid,eid,dst) NOT IN (SELECT (uid,eid,dst) FROM cases) UNION SELECT n.uid, n.eid, g.dst FROM gone n JOIN graph g ON g.uid=n.uid AND g.eid=n.eid AND g.src=n.node WHERE (g.uid,g.eid,g.dst) NOT IN (SELECT (uid,eid,dst) FROM cases))"""


@query(f"WITH RECURSIVE {SQL}, {_CASE} SELECT app_id, uid, eid, src, dst, type FROM graph g WHERE (type<>4 OR src=uid) AND (uid,eid,src) NOT IN (SELECT (uid,eid,node) FROM gone) AND (uid,eid,src,dst,type) NOT IN (SELECT (uid,eid,src,dst,type) FROM seeds)")
def prune_switch(s, d):
    """Pairs of the handler and its first part, and pairs of some methods and a callee that no graph holds."""
    g = stored(handler_graphs(s, d))
    held = g.where("src = eid AND type = 0 AND dst % 3 = 2").groupBy(*names.KEYS, "src").agg(F.min("dst").alias("dst"))
    absent = g.where("type = 0 AND src <> eid AND src % 15 = 1").select(*names.KEYS, "src", F.lit(-1).cast("bigint").alias("dst")).distinct()
    return graph.prune_cases(g, stored(held.unionByName(absent)))


@query(f"WITH RECURSIVE {SQL.replace('coalesce(nxt,frst)', 'nxt')}, step AS (SELECT app_id, uid, eid, src, dst FROM graph WHERE type=0 AND src%3=1 AND dst%3=1), alive AS (SELECT DISTINCT app_id, uid, eid, src AS node FROM graph WHERE NOT (type=0 AND src%3=1 AND dst%3=1) UNION SELECT s.app_id, s.uid, s.eid, s.src FROM alive a JOIN step s ON s.app_id=a.app_id AND s.uid=a.uid AND s.eid=a.eid AND s.dst=a.node) SELECT app_id, uid, eid, src, dst, type FROM graph WHERE NOT (type=0 AND src%3=1 AND dst%3=1) OR (app_id,uid,eid,dst) IN (SELECT (app_id,uid,eid,node) FROM alive)")
def prune_leaf(s, d):
    """On the graph without rings, as its circles have no leaf."""
    return graph.prune_leaves(handler_graphs(s, d, ring=False), nodes(s, d))


@query(sql("SELECT c.app_id, c.uid, c.eid, c.node, CASE WHEN o.inner_ IS NULL THEN -1 WHEN o.inner_ THEN 0 ELSE 1 END AS next_type FROM (SELECT DISTINCT app_id, uid, eid, dst AS node FROM graph WHERE type=0 AND dst%3=1) c LEFT JOIN (SELECT app_id, uid, eid, src AS node, bool_and(dst%3=1) AS inner_ FROM graph GROUP BY ALL) o USING (app_id, uid, eid, node)"))
def next_edge_type(s, d):
    return graph.next_edge_type(stored(handler_graphs(s, d)), nodes(s, d))


@query(sql("SELECT app_id, dst AS node, sum(type)>0 AS linked FROM edges GROUP BY app_id, dst"))
def linked_to_ui(s, d):
    return graph.linked_to_ui(edges(s, d))


@query(sql("SELECT DISTINCT app_id, src FROM edges WHERE type=0"))
def non_leaf(s, d):
    return edges(s, d).where("type = 0").select("app_id", "src").distinct()


@query(sql("SELECT app_id, src, count(*) AS n FROM edges e WHERE type=0 AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.app_id=e.app_id AND n.node_id=e.dst AND n.package IN ('-','Brand#11','Brand#12')) GROUP BY app_id, src"))
def unresolved_callees(s, d):
    known = nodes(s, d).where(F.col("package").isin("-", "Brand#11", "Brand#12")).select("app_id", F.col("node_id").alias("dst"))
    return edges(s, d).where("type = 0").join(known, ["app_id", "dst"], "left_anti").groupBy("app_id", "src").agg(F.count("*").alias("n"))


@query(sql("SELECT e.app_id, e.src, e.dst, e.type, a.name AS src_name, b.name AS dst_name FROM edges e JOIN nodes a ON a.app_id=e.app_id AND a.node_id=e.src JOIN nodes b ON b.app_id=e.app_id AND b.node_id=e.dst"))
def edge_endpoints(s, d):
    n = nodes(s, d)
    return edges(s, d).join(n.select("app_id", F.col("node_id").alias("src"), F.col("name").alias("src_name")), ["app_id", "src"]).join(n.select("app_id", F.col("node_id").alias("dst"), F.col("name").alias("dst_name")), ["app_id", "dst"]).select("app_id", "src", "dst", "type", "src_name", "dst_name")


@query(sql("SELECT app_id, uid, eid, 'digraph {' || chr(10) || string_agg('  '||src||' -> '||dst||' [label='||type||'];', chr(10) ORDER BY src, dst, type) || chr(10) || '}' AS dot FROM graph WHERE type IN (0,4) GROUP BY app_id, uid, eid"))
def dot_lines(s, d):
    return readers.dot_lines(handler_graphs(s, d).where("type IN (0, 4)"), names.KEYS)


_BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]


@query(sql("SELECT edges.app_id, src, " + "||".join(f"(CASE WHEN bool_or(package='{b}') THEN '1' ELSE '0' END)" for b in _BRANDS) + " AS bits FROM edges JOIN nodes ON nodes.app_id=edges.app_id AND node_id=dst AND dst%3=2 WHERE src%3=1 AND type=0 GROUP BY edges.app_id, src"))
def permission_multihot(s, d):
    items = edges(s, d).where("type = 0 AND src % 3 = 1").join(nodes(s, d).where("NOT is_self AND NOT is_widget").select("app_id", F.col("node_id").alias("dst"), "package"), ["app_id", "dst"])
    bits = evaluate.multi_hot(items.withColumn("key", F.struct("app_id", "src")), "key", "package", _BRANDS)
    return bits.select("key.*", F.array_join(F.col("bits").cast("array<string>"), "").alias("bits"))


@query("SELECT l_orderkey AS grp, l_linenumber AS flag, round(k/n,6) AS mean, round(sqrt((k/n)*(1-k/n)),6) AS std FROM (SELECT l_orderkey%100 AS l_orderkey, l_linenumber, count(DISTINCT l_partkey)::DOUBLE AS k FROM lineitem GROUP BY ALL) JOIN (SELECT l_orderkey%100 AS l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) USING (l_orderkey)")
def opcode_stats(s, d):
    items = table(s, d, "lineitem").select((F.col("l_orderkey") % 100).alias("grp"), F.col("l_partkey").alias("m"), F.col("l_linenumber").alias("flag"))
    out = evaluate.flag_stats(items, "grp", "m", "flag", items)
    return out.select("grp", "flag", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(None)
def laplacian_features(s, d):
    return evaluate.laplacian(handler_graphs(s, d).where("type = 0"), names.KEYS).select(*names.KEYS, F.round("eigen_mean", 9).alias("eigen_mean"))


@query(None)
def word2vec_mean(s, d):
    return evaluate.word2vec_mean(handler_graphs(s, d), nodes(s, d), names.KEYS)


@query("SELECT vec_id, round((x-lo)/(hi-lo),6) AS scaled FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings), (SELECT min(embedding[1]::DOUBLE) AS lo, max(embedding[1]::DOUBLE) AS hi FROM embeddings)")
def minmax_first_component(s, d):
    return evaluate.minmax_first(table(s, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("scaled", 6).alias("scaled"))


_KNN = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), pairs AS (SELECT a.vec_id AS id, a.label AS truth, b.label AS label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.e,b.e),9), b.vec_id) AS r FROM v a, v b), votes AS (SELECT id, truth, label, count(*) AS n FROM pairs WHERE r<=10 GROUP BY ALL), pred AS (SELECT id, truth, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS k FROM votes) WHERE k=1)"


def _scores_sql(rows: str) -> str:
    return f"SELECT label, round(p,6) AS precision, round(r,6) AS recall, round(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END,6) AS f1 FROM (SELECT l.label, coalesce((SELECT count_if(truth=predicted)::DOUBLE/count(*) FROM {rows} x WHERE x.predicted=l.label HAVING count(*)>0),0) AS p, coalesce((SELECT count_if(truth=predicted)::DOUBLE/count(*) FROM {rows} x WHERE x.truth=l.label HAVING count(*)>0),0) AS r FROM (SELECT truth AS label FROM {rows} UNION SELECT predicted FROM {rows}) l)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_KNN} SELECT id, truth, predicted FROM pred")
def knn_predict(s, d):
    return evaluate.knn(table(s, d, "embeddings"), "vec_id", "embedding", "label")


@query(f"WITH {_KNN} {_scores_sql('pred')}")
def knn_metrics(s, d):
    return _rounded(evaluate.scores(stored(knn_predict(s, d)), "truth", "predicted"))


_CLUSTER = "c AS (SELECT vec_id, vec_id%7 AS cluster, label FROM embeddings), dom AS (SELECT cluster, label AS dominant FROM (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, label) AS k FROM c GROUP BY cluster, label) WHERE k=1)"


def _clusters(s, d):
    rows = table(s, d, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("cluster"), "label")
    return rows, evaluate.dominant_label(rows, "cluster", "label")


@query(f"WITH {_CLUSTER} SELECT cluster, dominant FROM dom")
def cluster_dominant_label(s, d):
    return _clusters(s, d)[1]


@query(f"WITH {_CLUSTER}, m AS (SELECT label AS truth, dominant AS predicted FROM c JOIN dom USING (cluster)) {_scores_sql('m')}")
def cluster_metrics(s, d):
    rows, dom = _clusters(s, d)
    return _rounded(evaluate.scores(rows.join(dom, "cluster"), "label", "dominant"))


@query(f"WITH {_CLUSTER} SELECT dominant, label, count(*) AS n FROM c JOIN dom USING (cluster) GROUP BY ALL")
def confusion(s, d):
    rows, dom = _clusters(s, d)
    return rows.join(dom, "cluster").groupBy("dominant", "label").agg(F.count("*").alias("n"))


@query(None)
def ward_clusters(s, d):
    return evaluate.ward(table(s, d, "embeddings"), "vec_id", "embedding", 200)


@query("WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1)-1 AS i FROM embeddings), m AS (SELECT i, avg(x) AS mu FROM v GROUP BY i), c AS (SELECT vec_id, i, x-mu AS x FROM v JOIN m USING (i)) SELECT a.i::INT AS i, b.i::INT AS j, round(sum(a.x*b.x)/count(*),9) AS cov FROM c a JOIN c b ON a.vec_id=b.vec_id AND a.i<=b.i GROUP BY a.i, b.i")
def vector_covariance(s, d):
    rows = projection.usable(table(s, d, "embeddings"), "embedding")
    return projection.covariance(rows, "embedding", projection.means(rows, "embedding")).select("i", "j", F.round("cov", 9).alias("cov"))


@query(None)
def vector_layout(s, d):
    return projection.project(table(s, d, "embeddings").select("vec_id", "label", "embedding"), "embedding").drop("embedding")


@query("SELECT a.label, round((a.m-b.m)/nullif(b.m,0),6) AS uplift FROM (SELECT label, avg(embedding[1]::DOUBLE) AS m FROM embeddings GROUP BY label) a JOIN (SELECT label, avg(embedding[2]::DOUBLE) AS m FROM embeddings GROUP BY label) b USING (label)")
def metric_uplift(s, d):
    e = table(s, d, "embeddings").groupBy("label").agg(F.avg(F.get("embedding", F.lit(0)).cast("double")).alias("a"), F.avg(F.get("embedding", F.lit(1)).cast("double")).alias("b"))
    return e.select("label", F.round((F.col("a") - F.col("b")) / F.nullif("b", F.lit(0.0)), 6).alias("uplift"))


@query("SELECT o_orderkey, CASE WHEN p.p_partkey%5=0 THEN q.p_name ELSE p.p_name END AS value FROM orders o LEFT JOIN part p ON p.p_partkey=o.o_custkey LEFT JOIN part q ON p.p_partkey%5=0 AND q.p_partkey=p.p_partkey+1")
def reference_resolve(s, d):
    refs = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("ref"))
    values = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") + 1).alias("points_to"))
    return link.resolve(refs, values).select("o_orderkey", "value")


@query("SELECT o_orderkey, coalesce(p_name,'NOT_FOUND') AS value FROM orders LEFT JOIN part ON p_partkey=o_orderkey")
def attribute_resolve(s, d):
    values = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"), F.lit(None).cast("bigint").alias("points_to"))
    return link.resolve(table(s, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("ref")), values, "NOT_FOUND").select("o_orderkey", "value")


_LEAVES = (*markup.VOID, "p", "b")
_quoted = lambda text: text.replace("'", "''")
_TREE = f"""clean AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '{markup.ASIDE}', '', 'g'), '{markup.RAW[0]}', '\\1\\2', 'g'), '{markup.RAW[1]}', '\\1\\2', 'g') AS html FROM pages),
found AS (SELECT page_id, unnest(regexp_extract_all(html, '{_quoted(markup.TAG)}')) AS source, generate_subscripts(regexp_extract_all(html, '{_quoted(markup.TAG)}'), 1) AS pos FROM clean),
named AS (SELECT *, regexp_extract(source, '{markup.NAME}', 1) AS tag, source LIKE '</%' AS closing FROM found),
moves AS (SELECT *, source LIKE '%/>' OR list_contains({list(_LEAVES)}, tag) AS single, CASE WHEN source LIKE '%/>' OR list_contains({list(_LEAVES)}, tag) THEN 0 WHEN closing THEN -1 ELSE 1 END AS move FROM named),
sums AS (SELECT *, sum(move) OVER (PARTITION BY page_id ORDER BY pos) AS total FROM moves),
opens AS (SELECT page_id, pos, tag, source, (total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY pos)) - CASE WHEN single THEN 0 ELSE 1 END)::INT AS depth, closing FROM sums),
els AS (SELECT page_id, pos, tag, source, depth, row_number() OVER (PARTITION BY page_id ORDER BY pos)-1 AS ordinal FROM opens WHERE NOT closing),
tree AS (SELECT x.page_id, x.ordinal, coalesce((SELECT max(y.ordinal) FROM els y WHERE y.page_id=x.page_id AND y.depth=x.depth-1 AND y.pos<x.pos),-1) AS parent, x.depth, x.tag, coalesce(regexp_extract(x.source, 'href="([^"]*)"', 1),'') AS href FROM els x)"""


def _tree(s, d):
    return markup.tree(table(s, d, "pages"), "page_id", "html", _LEAVES)


@query(f"WITH {_TREE} SELECT page_id, ordinal, parent, depth, tag, href FROM tree")
def html_tree(s, d):
    return _tree(s, d).select("page_id", "ordinal", "parent", "depth", "tag", F.coalesce(markup.attribute("href"), F.lit("")).alias("href"))


@query(f"WITH {_TREE} SELECT page_id, count(*) AS n_elements, max(depth) AS deepest, count(DISTINCT tag) AS n_tags, count(DISTINCT tag) FILTER (tag IN ('nav','ul','li','div','article')) AS n_holders, max(n) AS widest FROM (SELECT *, count(*) OVER (PARTITION BY page_id, parent) AS n FROM tree) GROUP BY page_id")
def layout_stats(s, d):
    rows = _tree(s, d)
    wide = rows.groupBy("page_id", "parent").agg(F.count("*").alias("n")).groupBy("page_id").agg(F.max("n").alias("widest"))
    holders = F.countDistinct(F.when(F.col("tag").isin("nav", "ul", "li", "div", "article"), F.col("tag")))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_elements"), F.max("depth").alias("deepest"), F.countDistinct("tag").alias("n_tags"), holders.alias("n_holders")).join(wide, "page_id")


@query(f"WITH {_TREE}, parts AS (SELECT *, tag='div' AND page_id%2=0 AS includes FROM tree) SELECT page_id, parent, page_id AS of, ordinal FROM parts WHERE parent>=0 AND NOT includes UNION ALL SELECT x.page_id, x.parent, r.page_id, r.ordinal FROM parts x JOIN tree r ON r.page_id=x.page_id+1 AND r.parent<0 WHERE x.includes AND x.parent>=0")
def hold_edges(s, d):
    """Which element holds which; the div of every other page stands for an include of the next page."""
    swap = (F.col("tag") == "div") & (F.col("page_id") % 2 == 0)
    named = F.array(F.struct(F.lit("layout").alias("name"), F.concat(F.lit("@layout/"), F.col("page_id") + 1).alias("value")))
    rows = _tree(s, d).withColumn("attributes", F.when(swap, named).otherwise(F.col("attributes"))).withColumn("tag", F.when(swap, "include").otherwise(F.col("tag")))
    return markup.hold_edges(rows.withColumn("page_id", F.col("page_id").cast("string")), "page_id").select(F.col("page_id").cast("bigint").alias("page_id"), "parent", F.col("of").cast("bigint").alias("of"), "ordinal")


@query(f"WITH {_TREE} SELECT page_id, ordinal, href AS uid, tag FROM tree x WHERE href<>'' AND NOT EXISTS (SELECT 1 FROM tree y WHERE y.page_id=x.page_id AND y.parent=x.ordinal)")
def telling_elements(s, d):
    """Leaf elements with an address, which serves as id and source."""
    rows = markup.views(_tree(s, d), "page_id", "href", {"src": "href", "text": "title"})
    return resources.telling_views(rows).select("page_id", "ordinal", "uid", "tag")


@query(f"WITH {_TREE} SELECT tag||'Layout' AS tag, true AS container, count(*) AS n FROM tree WHERE tag IN ('div','ul') GROUP BY tag UNION ALL SELECT tag, false, count(*) FROM tree WHERE tag NOT IN ('div','ul') GROUP BY tag")
def container_kinds(s, d):
    tag = F.when(F.col("tag").isin("div", "ul"), F.concat("tag", F.lit("Layout"))).otherwise(F.col("tag"))
    rows = markup.views(_tree(s, d).withColumn("tag", tag), "page_id")
    return rows.groupBy("tag", F.col("is_container").alias("container")).agg(F.count("*").alias("n"))


@query(f"WITH {_TREE} SELECT page_id, ordinal, '<'||tag||CASE WHEN href<>'' THEN ' href=\"'||replace(replace(replace(href,'&','&amp;'),'\"','&quot;'),chr(10),'&#10;')||'\"' ELSE '' END||'>' AS text FROM tree WHERE tag IN ('a','li')")
def start_tags(s, d):
    return markup.start_tags(_tree(s, d).where("tag IN ('a', 'li')"), "page_id")


@query(sql("SELECT app_id, node_id, array_to_string(string_split(name,' ')[:2],' ') AS label FROM nodes WHERE contains(name,':')"))
def node_labels(s, d):
    return access.labels(nodes(s, d), 2)


@query(sql("SELECT app_id, uid, eid, src, dst, type FROM graph WHERE uid IN (3,6,30,60,90,120,300)"))
def graphs_of_widgets(s, d):
    return access.of_widgets(handler_graphs(s, d), [3, 6, 30, 60, 90, 120, 300])


@query(sql("SELECT app_id, count(DISTINCT package) FILTER (NOT is_widget AND NOT is_self) AS n_packages, count(DISTINCT xml) AS n_layouts, count(DISTINCT uid) AS n_widgets FROM nodes GROUP BY app_id"))
def distinct_counts(s, d):
    library = F.when(~F.col("is_widget") & ~F.col("is_self"), F.col("package"))
    return nodes(s, d).groupBy("app_id").agg(F.countDistinct(library).alias("n_packages"), F.countDistinct("xml").alias("n_layouts"), F.countDistinct("uid").alias("n_widgets"))


@query("SELECT DISTINCT app_id, name FROM (SELECT (l_suppkey%25)::VARCHAR AS app_id, unnest(['m'||l_orderkey, 'a'||l_partkey]) AS name FROM lineitem)")
def streamed_nodes(s, d):
    """Nodes of calls that lines stand for, read as a stream; a pattern lets the source take a single file."""
    lines = s.readStream.schema(table(s, d, "lineitem").schema).parquet(f"{d}/lineitem.parque[t]")
    calls = lines.select((F.col("l_suppkey") % 25).cast("string").alias("app_id"), F.concat(F.lit("m"), "l_orderkey").alias("caller"), F.concat(F.lit("a"), "l_partkey").alias("callee"))
    out = folder(s)
    increment.distinct_nodes(calls, f"{out}/nodes", f"{out}/state").awaitTermination()
    return s.read.schema("app_id string, name string").parquet(f"{out}/nodes")


_PAIRS = f"""SELECT id, truth, predicted, 'whole' AS e FROM pred UNION ALL SELECT id, truth, predicted, 'part' FROM (WITH {_KNN.replace('embedding::DOUBLE[] AS e', 'embedding[1:4]::DOUBLE[] AS e')} SELECT id, truth, predicted FROM pred)"""


@query(f"""WITH {_KNN}, both_ AS ({_PAIRS}), labels_ AS (SELECT DISTINCT truth AS label FROM both_), f AS (SELECT e, label, coalesce(2.0*h/nullif(p+t,0),0) AS f1 FROM (SELECT e, label, count(*) FILTER (truth=label AND predicted=label) AS h, count(*) FILTER (predicted=label) AS p, count(*) FILTER (truth=label) AS t FROM both_, labels_ GROUP BY ALL))
SELECT a.e AS encoding, round(avg(a.f1),6) AS mean_f1, round(avg((a.f1-b.f1)/nullif(b.f1,0)),6) AS mean_gain, count(*) FILTER (a.f1=0) AS n_zero FROM f a JOIN f b ON b.label=a.label AND b.e='part' GROUP BY a.e""")
def encoding_gain(s, d):
    """Votes over whole vectors against votes over their first four components."""
    e = table(s, d, "embeddings")
    kinds = {"whole": e, "part": e.withColumn("embedding", F.slice("embedding", 1, 4))}
    rows = [evaluate.knn(v, "vec_id", "embedding", "label").withColumn("e", F.lit(k)) for k, v in kinds.items()]
    scores = evaluate.score_table(stored(rows[0].unionByName(rows[1])), "e", "truth", "predicted", list(kinds))
    return evaluate.improvement(scores, list(kinds), "part").select("encoding", F.round("mean_f1", 6).alias("mean_f1"), F.round("mean_gain", 6).alias("mean_gain"), "n_zero")


@query("WITH RECURSIVE p AS (SELECT o_orderkey AS class, o_orderkey//3 AS parent FROM orders WHERE o_orderkey>0), a AS (SELECT class, parent AS ancestor FROM p UNION SELECT a.class, p.parent FROM a JOIN p ON p.class=a.ancestor) SELECT class, ancestor FROM a")
def superclass_closure(s, d):
    parents = table(s, d, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("class"), F.floor(F.col("o_orderkey") / 3).cast("bigint").alias("parent"))
    return statements.superclasses(parents)


@query("SELECT conv_id, turn, last_value(CASE WHEN role='user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS defined FROM conversations")
def latest_definition(s, d):
    return statements.latest_definition(table(s, d, "conversations"), ["conv_id"], "turn", "role = 'user'", "turn").select("conv_id", "turn", "defined")


@query("SELECT conv_id, turn, first_value(CASE WHEN role='assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stored FROM conversations")
def forward_store(s, d):
    return statements.forward_store(table(s, d, "conversations"), ["conv_id"], "turn", "role = 'assistant'", "turn").select("conv_id", "turn", "stored")


@query("SELECT conv_id, turn, block FROM (SELECT conv_id, turn, last_value(CASE WHEN role='user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM conversations) WHERE block IS NOT NULL")
def case_blocks(s, d):
    return statements.case_blocks(table(s, d, "conversations"), ["conv_id"], "turn", "role = 'user'").select("conv_id", "turn", "block")


@query("SELECT o_orderkey, 'C'||o_custkey||CASE o_orderpriority WHEN '1-URGENT' THEN '.onClick' ELSE '.onTouch' END AS handler FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')")
def registered_handlers(s, d):
    callee = F.when(F.col("o_orderpriority") == "1-URGENT", "setOnClickListener").when(F.col("o_orderpriority") == "2-HIGH", "setOnTouchListener").otherwise("run")
    calls = table(s, d, "orders").select("o_orderkey", callee.alias("callee"), F.concat(F.lit("C"), "o_custkey").alias("listener"))
    return statements.registrations(calls, "callee", "listener").select("o_orderkey", "handler")


_STEPS = """s AS (SELECT o_custkey, o_orderkey AS pos, 'v'||(o_orderkey%3) AS lhs, CASE o_orderkey%5 WHEN 1 THEN 'v'||(o_orderkey//5%3) WHEN 2 THEN 'v'||(o_orderkey//7%3) END AS want, CASE o_orderkey%5 WHEN 0 THEN o_orderpriority WHEN 3 THEN '[p] k '||o_orderstatus END AS value FROM orders),
p AS (SELECT s.*, (SELECT max(d.pos) FROM s d WHERE d.o_custkey=s.o_custkey AND d.lhs=s.want AND d.pos<s.pos) AS up FROM s),
walk AS (SELECT o_custkey, pos, pos AS origin, up, value FROM p UNION ALL SELECT w.o_custkey, w.pos, p.pos, p.up, p.value FROM walk w JOIN p ON p.o_custkey=w.o_custkey AND p.pos=w.up)"""


@query(f"WITH RECURSIVE {_STEPS} SELECT o_custkey, pos, value, origin FROM walk WHERE up IS NULL")
def string_behind_local(s, d):
    kind, var = F.col("o_orderkey") % 5, lambda n: F.concat(F.lit("v"), (F.floor(F.col("o_orderkey") / n) % 3).cast("string"))
    stmts = table(s, d, "orders").select(
        "o_custkey",
        F.col("o_orderkey").alias("pos"),
        var(1).alias("lhs"),
        F.when(kind == 0, F.col("o_orderpriority")).when(kind == 1, var(5)).alias("rhs"),
        F.when(kind == 0, "string").when(kind == 1, "local").when(kind == 4, "other").otherwise("invoke").alias("rhs_kind"),
        F.when(kind == 2, "valueOf").when(kind == 3, "getString").alias("callee"),
        F.when(kind == 2, F.array(var(7))).when(kind == 3, F.array(F.lit("k"), "o_orderstatus")).alias("args"),
    )
    return statements.string_behind(stmts, ["o_custkey"]).select("o_custkey", "pos", "value", "origin")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_maps(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal>0)")
def incremental_skip(s, d):
    log = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("ok").alias("status"))
    return increment.not_done(table(s, d, "orders"), log, "o_custkey").select("o_orderkey")


from . import apps, statements as _statements  # noqa: E402, F401  register their queries


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
