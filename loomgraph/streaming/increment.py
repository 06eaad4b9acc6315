"""Incremental work: apps that were done before are left out, as a batch or as a stream of new folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def not_done(work: DataFrame, log: DataFrame, key: str, again: bool = False) -> DataFrame:
    """Work without a row of status ok in the log; `again` takes all."""
    return work if again else work.join(log.where("status = 'ok'").select(key).distinct(), key, "left_anti")


def follow(spark: SparkSession, path: str, schema: str, log: str, key: str, work: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Runs `work` on each batch of new Parquet rows whose key is not in the log, then logs their keys."""

    def batch(df: DataFrame, _: int) -> None:
        known = spark.read.schema(f"{key} {df.schema[key].dataType.simpleString()}, status STRING").parquet(log)
        todo = not_done(df, known, key)
        work(todo)
        todo.select(key).distinct().selectExpr(key, "'ok' AS status").write.mode("append").parquet(log)

    return spark.readStream.schema(schema).parquet(path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def distinct_nodes(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each (app_id, name) that a stream of calls (app_id, caller, callee) names once, whatever batch it comes in.

    The names seen are kept as state by app and name, so that they are dealt to all tasks.
    """
    named = calls.select("app_id", F.explode(F.array("caller", "callee")).alias("name")).dropDuplicates(["app_id", "name"])
    return named.writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("path", path).format("parquet").trigger(availableNow=True).start()
