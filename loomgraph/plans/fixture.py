"""The property graphs that the driver's tables stand for, one app for each nation: widgets, own methods, library methods.

An app holds its customers as widgets, their orders as own methods, and the parts in them as library methods, which many
apps have with the same ids and names. Each customer has a second widget, which uses an order of its own, or of the next
customer of the app.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import APP, CALL, EVENT, HOLD, USE
from ..operators.scratch import stored

SECOND = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, c_custkey)."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias(APP), "c_custkey")


def own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their app."""
    return table(spark, sf_dir, "orders").join(apps(spark, sf_dir).withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, o_orderkey, p_partkey): the parts of each app's orders, each once."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    return items.join(own(spark, sf_dir).select(APP, "o_orderkey"), "o_orderkey").select(APP, "o_orderkey", "p_partkey")


def library_class(part: DataFrame) -> Column:
    """The class of a part's method: of the platform for three parts in five, else named by brand."""
    kind = part["p_partkey"] % 5
    return F.when(kind == 0, "android.support.v4.media.X").when(kind == 1, "java.util.L").when(kind == 2, "com.android.internal.T").otherwise(F.concat(F.replace(part["p_brand"], F.lit("#"), F.lit("")), F.lit(".A")))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, p_brand, name)."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_brand", F.concat(F.lit("<"), library_class(p), F.lit(": void a"), "p_partkey", F.lit("()>")).alias("name"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id is 3k for widgets, 3k+1 for own methods, 3k+2 for library methods."""
    c = table(spark, sf_dir, "customer").withColumn(APP, F.col("c_nationkey").cast("string"))
    none = [F.lit(None).cast("bigint").alias("uid"), F.lit(None).cast("string").alias("xml")]
    flags = lambda own_, widget: [F.lit(own_).alias("is_self"), F.lit(widget).alias("is_widget")]
    w = c.select(APP, (F.col("c_custkey") * 3).alias("node_id"), F.concat(F.lit("w"), "c_custkey").alias("name"), *flags(False, True), F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("xml"), F.lit(None).cast("string").alias("package"))
    v = c.select(APP, ((F.col("c_custkey") + SECOND) * 3).alias("node_id"), F.concat(F.lit("v"), "c_custkey").alias("name"), *flags(False, True), (F.col("c_custkey") + SECOND).alias("uid"), F.lit("SUB").alias("xml"), F.lit(None).cast("string").alias("package"))
    m = own(spark, sf_dir).select(APP, (F.col("o_orderkey") * 3 + 1).alias("node_id"), F.concat(F.lit("<o.M: void m"), "o_orderkey", F.lit("()>")).alias("name"), *flags(True, False), *none, F.lit("-").alias("package"))
    a = held(spark, sf_dir).select(APP, "p_partkey").distinct().join(library(spark, sf_dir), "p_partkey")
    a = a.select(APP, (F.col("p_partkey") * 3 + 2).alias("node_id"), "name", *flags(False, False), *none, F.col("p_brand").alias("package"))
    return w.unionByName(v).unionByName(m).unionByName(a)


def edges(spark: SparkSession, sf_dir: str, ring: bool = True, callbacks: bool = False) -> DataFrame:
    """EVENT, USE and HOLD edges, and calls: own methods of a customer in order (closed to a ring), to parts, between parts.

    With callbacks one part in 20 calls an own method, where the app has it.
    """
    c = apps(spark, sf_dir)
    o = stored(own(spark, sf_dir).select(APP, "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    h = stored(items.join(o.select(APP, "o_orderkey"), "o_orderkey").select(APP, "o_orderkey", "p_partkey").distinct())
    n = table(spark, sf_dir, "part").count()
    kind = lambda d, k: d.select(APP, "src", "dst", F.lit(k).alias("type"))
    method, widget, part = (lambda x: x * 3 + 1), (lambda x: x * 3), (lambda x: x * 3 + 2)
    touch = lambda pr, k: kind(o.where(F.col("o_orderpriority") == pr).select(APP, widget(F.col("o_custkey")).alias("src"), method(F.col("o_orderkey")).alias("dst")), k)
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    first = F.first("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = F.lead("o_orderkey").over(w)
    chain = o.select(APP, "o_orderkey", (F.coalesce(follow, first) if ring else follow).alias("next")).where("next IS NOT NULL AND next <> o_orderkey")
    calls = kind(chain.select(APP, method(F.col("o_orderkey")).alias("src"), method(F.col("next")).alias("dst")), CALL)
    uses = kind(h.select(APP, method(F.col("o_orderkey")).alias("src"), part(F.col("p_partkey")).alias("dst")), CALL)
    parts = stored(h.select(APP, "p_partkey").distinct())
    inner = parts.select(APP, part(F.col("p_partkey")).alias("src"), part((F.col("p_partkey") * 7 + 1) % n).alias("dst")).where("src <> dst")
    inner = kind(inner.join(parts.select(APP, part(F.col("p_partkey")).alias("dst")), [APP, "dst"], "left_semi"), CALL)
    hold = kind(c.select(APP, (F.lit(-10) - F.col(APP).cast("bigint")).alias("src"), widget(F.col("c_custkey")).alias("dst")), HOLD)
    next_ = c.withColumn("after", F.coalesce(F.lead("c_custkey").over(Window.partitionBy(APP).orderBy("c_custkey")), "c_custkey"))
    user = next_.select(APP, F.col("c_custkey").alias("of"), F.when(F.col("c_custkey") % 3 == 0, F.col("after")).otherwise(F.col("c_custkey")).alias("o_custkey"))
    second = kind(user.join(o.where("o_orderpriority = '5-LOW'"), [APP, "o_custkey"]).select(APP, widget(F.col("of") + SECOND).alias("src"), method(F.col("o_orderkey")).alias("dst")), USE)
    out = touch("1-URGENT", EVENT).unionByName(touch("2-HIGH", USE))
    back = parts.where("p_partkey % 20 = 7").join(o.select(APP, ((F.col("o_orderkey") - 1) / 5).alias("p_partkey"), "o_orderkey"), [APP, "p_partkey"])
    back = kind(back.select(APP, part(F.col("p_partkey").cast("bigint")).alias("src"), method(F.col("o_orderkey")).alias("dst")), CALL)
    for d in (second, calls, uses, inner, hold, *([back] if callbacks else [])):
        out = out.unionByName(d)
    return out


#: The same graphs for DuckDB.
SQL = """own_ AS (SELECT c_nationkey::VARCHAR AS app_id, orders.* FROM orders JOIN customer ON c_custkey=o_custkey),
held AS (SELECT DISTINCT app_id, o_orderkey, l_partkey AS p FROM lineitem JOIN own_ ON l_orderkey=o_orderkey),
lib AS (SELECT p_partkey AS p, p_brand, CASE p_partkey%5 WHEN 0 THEN 'android.support.v4.media.X' WHEN 1 THEN 'java.util.L' WHEN 2 THEN 'com.android.internal.T' ELSE replace(p_brand,'#','')||'.A' END AS cls FROM part),
parts AS (SELECT DISTINCT app_id, p FROM held),
nodes AS (
  SELECT c_nationkey::VARCHAR AS app_id, c_custkey*3 AS node_id, 'w'||c_custkey AS name, false AS is_self, true AS is_widget, c_custkey AS uid, c_mktsegment AS xml, NULL::VARCHAR AS package FROM customer
  UNION ALL SELECT c_nationkey::VARCHAR, (c_custkey+1000000000)*3, 'v'||c_custkey, false, true, c_custkey+1000000000, 'SUB', NULL FROM customer
  UNION ALL SELECT app_id, o_orderkey*3+1, '<o.M: void m'||o_orderkey||'()>', true, false, NULL, NULL, '-' FROM own_
  UNION ALL SELECT app_id, p*3+2, '<'||cls||': void a'||p||'()>', false, false, NULL, NULL, p_brand FROM parts JOIN lib USING (p)),
chain AS (SELECT app_id, o_orderkey, lead(o_orderkey) OVER w AS nxt, first_value(o_orderkey) OVER w AS frst FROM own_ WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
second AS (SELECT c_nationkey::VARCHAR AS app_id, c_custkey, CASE WHEN c_custkey%3=0 THEN coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), c_custkey) ELSE c_custkey END AS whose FROM customer),
edges AS (
  SELECT app_id, o_custkey*3 AS src, o_orderkey*3+1 AS dst, 4 AS type FROM own_ WHERE o_orderpriority='1-URGENT'
  UNION ALL SELECT app_id, o_custkey*3, o_orderkey*3+1, 3 FROM own_ WHERE o_orderpriority='2-HIGH'
  UNION ALL SELECT s.app_id, (s.c_custkey+1000000000)*3, o_orderkey*3+1, 3 FROM second s JOIN own_ ON o_custkey=whose WHERE o_orderpriority='5-LOW'
  UNION ALL SELECT app_id, o_orderkey*3+1, coalesce(nxt,frst)*3+1, 0 FROM chain WHERE coalesce(nxt,frst) <> o_orderkey
  UNION ALL SELECT app_id, o_orderkey*3+1, p*3+2, 0 FROM held
  UNION ALL SELECT a.app_id, a.p*3+2, b.p*3+2, 0 FROM parts a JOIN parts b ON b.app_id=a.app_id AND b.p=(a.p*7+1) % (SELECT count(*) FROM part) WHERE a.p<>b.p
  UNION ALL SELECT c_nationkey::VARCHAR, (-10-c_nationkey)::BIGINT, c_custkey*3, 2 FROM customer),
ok AS (SELECT app_id, src, dst, type, (src%3=2 AND dst%3=2) AS api_call FROM edges WHERE type IN (0,3,4) AND dst%3 IN (1,2)),
events_ AS (SELECT DISTINCT app_id, src AS uid, dst AS eid FROM edges WHERE type=4),
reach0 AS (SELECT DISTINCT app_id, eid AS seed, eid AS node FROM events_ UNION SELECT r.app_id, r.seed, e.dst FROM reach0 r JOIN ok e ON e.app_id=r.app_id AND e.src=r.node AND NOT e.api_call),
every_ AS (
  SELECT DISTINCT * FROM (SELECT v.app_id, v.uid, v.eid, b.src, b.dst, b.type FROM events_ v JOIN (
      SELECT r.app_id, r.seed, e.src, e.dst, e.type FROM reach0 r JOIN ok e ON e.app_id=r.app_id AND e.src=r.node AND NOT e.api_call
      UNION ALL SELECT r.app_id, r.seed, e.src, e.dst, e.type FROM reach0 r JOIN edges e ON e.app_id=r.app_id AND e.dst=r.node AND e.type IN (3,4) AND e.src%3=0 AND e.src>=0) b ON b.app_id=v.app_id AND b.seed=v.eid
    UNION ALL SELECT app_id, uid, eid, uid, eid, 4 FROM events_)),
graph AS (SELECT * FROM every_ WHERE (app_id,uid,eid) IN (SELECT (app_id,uid,eid) FROM every_ GROUP BY app_id,uid,eid HAVING count(*)>1))"""


#: What handlers reach at hop 1, with the depth of library methods, on the graph with callbacks; of use behind SQL.
HOP1 = """deep AS (SELECT DISTINCT app_id, eid AS seed, eid AS node, -1 AS d FROM events_
  UNION SELECT r.app_id, r.seed, e.dst, CASE WHEN e.dst%3=1 THEN -1 WHEN e.api_call THEN r.d+1 ELSE 0 END FROM deep r JOIN ok e ON e.app_id=r.app_id AND e.src=r.node AND (NOT e.api_call OR r.d<1)),
every1 AS (SELECT DISTINCT v.app_id, v.uid, v.eid, b.src, b.dst, b.type FROM events_ v JOIN (
    SELECT r.app_id, r.seed, e.src, e.dst, e.type FROM deep r JOIN ok e ON e.app_id=r.app_id AND e.src=r.node AND (NOT e.api_call OR r.d<1)
    UNION SELECT r.app_id, r.seed, e.src, e.dst, e.type FROM deep r JOIN edges e ON e.app_id=r.app_id AND e.dst=r.node AND e.type IN (3,4) AND e.src%3=0 AND e.src>=0) b ON b.app_id=v.app_id AND b.seed=v.eid
  UNION SELECT app_id, uid, eid, uid, eid, 4 FROM events_)"""


def sql(body: str) -> str:
    return f"WITH RECURSIVE {SQL} {body}"


def hop1_sql(body: str) -> str:
    hold = "  UNION ALL SELECT c_nationkey::VARCHAR, (-10-c_nationkey)"
    back = "  UNION ALL SELECT o.app_id, p*3+2, o_orderkey*3+1, 0 FROM parts JOIN own_ o ON o.app_id=parts.app_id AND o.o_orderkey=5*p+1 WHERE p%20=7\n"
    return f"WITH RECURSIVE {SQL.replace(hold, back + hold)}, {HOP1} {body}"
