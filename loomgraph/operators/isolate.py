"""Apps whose tables are broken are told and left out, and all others go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import APP, EVENT
from .scratch import stored


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(app_id, fault, n): what is wrong with the graph of an app, and how often. Rows that a reader could not parse are null.

    Ends of edges below 0 are containers, which have no node.
    """
    told = lambda df, what: df.groupBy(APP).agg(F.count("*").alias("n")).select(APP, F.lit(what).alias("fault"), "n")
    known = nodes.select(APP, "node_id").distinct()
    end = lambda c: edges.where(F.col(c) >= 0).select(APP, F.col(c).alias("node_id"))
    lost = end("src").unionByName(end("dst")).join(known, [APP, "node_id"], "left_anti").distinct()
    twice = nodes.where("node_id IS NOT NULL").groupBy(APP, "node_id").count().where("count > 1")
    return (
        told(nodes.where("node_id IS NULL"), "node without id")
        .unionByName(told(nodes.where("name IS NULL"), "node without name"))
        .unionByName(told(twice, "node id given twice"))
        .unionByName(told(edges.where(F.col("type").isNull() | ~F.col("type").between(0, EVENT)), "unknown edge type"))
        .unionByName(told(edges.where("src IS NULL OR dst IS NULL"), "edge without end"))
        .unionByName(told(lost, "edge to no node"))
    )


def run(nodes: DataFrame, edges: DataFrame, stage: str, work: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What `work` makes of the sound apps' nodes and edges (with app_id), and the run log (app_id, stage, status, detail).

    The log has a row for each app: `failed` and its faults with their counts, or `ok` and the number of its result's rows.
    """
    bad = stored(faults(nodes, edges))
    broken = bad.select(APP).distinct()
    out = stored(work(nodes.join(broken, APP, "left_anti"), edges.join(broken, APP, "left_anti")))
    apps = nodes.select(APP).unionByName(edges.select(APP)).distinct()
    why = bad.groupBy(APP).agg(F.array_join(F.array_sort(F.collect_list(F.concat("fault", F.lit(": "), "n"))), ", ").alias("why"))
    rows = out.groupBy(APP).agg(F.count("*").alias("rows"))
    log = apps.join(why, APP, "left").join(rows, APP, "left")
    return out, log.select(APP, F.lit(stage).alias("stage"), F.when(F.col("why").isNull(), "ok").otherwise("failed").alias("status"), F.coalesce("why", F.coalesce("rows", F.lit(0)).cast("string")).alias("detail"))
