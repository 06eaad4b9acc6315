"""Written intermediate tables on the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_and_count(df: DataFrame, wanted: Column | None = None) -> tuple[DataFrame, int]:
    """The stored table, and how many of its rows there are, or are wanted ones, which is observed while it is written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(F.lit(True) if wanted is None else wanted).alias("n")))
    return out, seen.get["n"]


def stored_and_any(df: DataFrame, wanted: Column) -> tuple[DataFrame, bool]:
    """The stored table, and whether any of its rows is a wanted one."""
    out, n = stored_and_count(df, wanted)
    return out, n > 0
