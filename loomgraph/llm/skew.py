"""Joins and orders that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

PART = 33  # fixed value: monotonically_increasing_id keeps the partition above its lowest 33 bits


def joined(rows: DataFrame, facts: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """rows with the columns of facts, one row for each key; rows whose key facts lacks are left out.

    Keys that hold more than one row in `most`, of which there are fewer than `most`, are sent to every task; all
    other rows are shuffled, and none of their keys can fill a task.
    """
    total = rows.count()
    heavy = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") * most > total).select(key)
    near = F.broadcast(facts.join(F.broadcast(heavy), key))
    far = rows.join(F.broadcast(heavy), key, "left_anti").join(facts, key)
    return rows.join(near, key).unionByName(far)


def in_order(rows: DataFrame, key: str, order: list, path: str, *columns) -> DataFrame:
    """The rows sorted by key and order over all partitions, with `pos`, which grows with that order; stored at path.

    A key with very many rows lies in many partitions. Rows that agree in key and order change places freely.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key).asc_nulls_first(), *order]
    return textops.stored(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).select(*columns, F.monotonically_increasing_id().alias("pos")), path)
