"""Writers of app folders below one path, by app_id: node and edge CSV, JSON maps, event XML, handler graphs, the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import printable


def _save(df: DataFrame, path: str, kind: str, **options: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options).partitionBy("app_id").format(kind).save(path)


def indexed(nodes: DataFrame, key: str = "hash") -> DataFrame:
    """Adds `index`: the place of a node in its app from 0, by key."""
    return nodes.withColumn("index", F.row_number().over(Window.partitionBy("app_id").orderBy(key)) - 1)


def indexed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between hashes as edges between indexes; the last node of a hash counts, edges without one go."""
    last = nodes.groupBy("app_id", "hash").agg(F.max("index").alias("index"))
    end = lambda c: last.select("app_id", F.col("hash").alias(c), F.col("index").alias(f"{c}_index"))
    return edges.join(end("src"), ["app_id", "src"]).join(end("dst"), ["app_id", "dst"]).select("app_id", F.col("src_index").alias("src"), F.col("dst_index").alias("dst"), "type")


def write_nodes(nodes: DataFrame, path: str) -> None:
    """node.csv of indexed nodes; null classes, layouts and ids are -1."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-1"))
    rows = nodes.select("app_id", F.col("index").alias("_c0"), F.col("name").alias("Name"), F.col("hash").alias("Hash"), F.col("java").alias("Java"), F.col("android").alias("Android"), F.col("ui").alias("UI"), text("class").alias("Class"), text("xml").alias("XML"), text("uid").alias("UId"), F.col("package").alias("Package"))
    _save(rows.repartition("app_id").sortWithinPartitions("app_id", "_c0"), path, "csv", header="true")


def write_edges(edges: DataFrame, path: str) -> None:
    place = F.row_number().over(Window.partitionBy("app_id").orderBy("src", "dst", "type")) - 1
    _save(edges.select("app_id", place.alias("_c0"), F.col("src").alias("From"), F.col("dst").alias("To"), F.col("type").alias("Type")), path, "csv", header="true")


def _as_array(df: DataFrame, row) -> DataFrame:
    return df.groupBy("app_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value"))


def write_handler_graphs(rows: DataFrame, path: str) -> None:
    """One JSON array for each app of packed handler graphs (uid, eid, size, edges)."""
    _save(_as_array(rows, F.struct("uid", "eid", "size", "edges")), path, "text")


def write_events(events: DataFrame, path: str) -> None:
    """Activity elements with their views and handlers."""
    views = events.groupBy("app_id", "xml", "uid").agg(F.array_sort(F.collect_set(F.struct(F.col("handler").alias("_handler")))).alias("EventAndHandler"))
    acts = views.groupBy("app_id", "xml").agg(F.array_sort(F.collect_list(F.struct(F.col("uid").alias("_id"), "EventAndHandler"))).alias("View"))
    _save(acts.select("app_id", F.col("xml").alias("_name"), "View"), path, "xml", rootTag="GUIHierarchy", rowTag="Activity")


def write_additional(links: DataFrame, pairs: DataFrame, path: str) -> None:
    """One JSON object for each app: links (app_id, field, key, value) as maps to lists, pairs (app_id, field, key, ord, caller, callee) as maps to lists of pairs."""
    one = lambda df, item: df.groupBy("app_id", "field", "key").agg(F.array_sort(F.collect_list(item)).alias("v")).groupBy("app_id", "field").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v"))))).alias("v"))
    paired = pairs.withColumn("p", F.struct("ord", F.col("caller").alias("_1"), F.col("callee").alias("_2")))
    fields = one(links.distinct(), F.col("value")).unionByName(one(paired, F.col("p")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "v"))), lambda x: F.concat(F.lit('"'), x["field"], F.lit('":'), x["v"])), ",")
    _save(fields.groupBy("app_id").agg(F.concat(F.lit("{"), body, F.lit("}")).alias("value")), path, "text")


def write_contexts(views: DataFrame, path: str) -> None:
    """ui_context: a JSON map from layout to a map from view to its name, text, hint, src and background, without control characters."""
    kept = [printable(F.col(c)).alias(c) for c in ("name", "text", "hint", "src", "background")]
    per = views.groupBy("app_id", "xml").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("view_id", F.struct(*kept).alias("v"))))).alias("m"))
    _save(per.groupBy("app_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("xml", "m")).cast("array<struct<xml:string,m:map<string,struct<name:string,text:string,hint:string,src:string,background:string>>>>"), lambda a, b: F.when(a["xml"] < b["xml"], -1).otherwise(1)))).alias("value")), path, "text")


def write_code_texts(texts: DataFrame, path: str) -> None:
    """in_code_str: a JSON map from layout to `id class method type value` items."""
    item = F.concat_ws(" ", F.col("id").cast("string"), "class", "method", "type", "value")
    per = texts.groupBy("app_id", "xml").agg(F.array_sort(F.collect_set(item)).alias("v"))
    _save(per.groupBy("app_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("xml", "v"))))).alias("value")), path, "text")


def write_flows(flows: DataFrame, path: str) -> None:
    """One JSON array for each app of (sink, source, path)."""
    _save(_as_array(flows, F.struct("sink", "source", "path")), path, "text")


def log_run(rows: DataFrame, path: str) -> None:
    """Appends (app_id, stage, status, detail) to the run log, which tells counts of links and failed apps."""
    rows.select("app_id", "stage", "status", F.col("detail").cast("string").alias("detail")).write.mode("append").parquet(path)
