"""Vectors in few dimensions: their covariance, and the projection on its leading axes.

This stands in for a t-SNE picture, which has no distributed form: it keeps the directions along which the
rows differ most, not their neighbourhoods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector takes part: of the commonest length (ties to the longest), without null or non-finite components, cast to doubles."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.withColumn(vector, F.col(vector).cast("array<double>")).where((F.size(vector) > 0) & F.forall(vector, finite))
    length = rows.groupBy(F.size(vector).alias("n")).count().agg(F.max_by("n", F.struct("count", "n"))).first()[0]
    return rows.where(F.size(vector) == F.lit(length or 0))


def means(rows: DataFrame, vector: str) -> list[float]:
    """The mean of each component of usable rows; no rows give none."""
    parts = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    return [r["x"] for r in parts.orderBy("i").collect()]


def covariance(rows: DataFrame, vector: str, centre: list[float]) -> DataFrame:
    """(i, j, cov) for i <= j: the population covariance of the components of usable rows about their means.

    Each task multiplies its centred rows batch by batch and gives one matrix, whose entries are then summed by
    (i, j): the shuffle grows with tasks times the square of the length, not with the rows. The length is bounded
    by what a square matrix of it may take in a task.
    """
    mean = np.array(centre)
    i, j = np.triu_indices(len(mean))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(mean), len(mean))), 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_list()) - mean
                total += x.T @ x
                n += len(x)
        if n:
            yield pd.DataFrame({"i": i, "j": j, "s": total[i, j], "n": n})

    parts = rows.select(F.col(vector).alias("v")).mapInPandas(products, "i int, j int, s double, n long")
    return parts.groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("cov"))


def axes(cov: DataFrame, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading axes as rows, and each one's share of the variance.

    An axis points to where its largest component (the first of equal ones) is positive. length squared numbers
    come to the driver. Where all rows are equal the shares are 0.
    """
    full = np.zeros((length, length))
    for r in cov.collect():
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = r["cov"]
    values, found = np.linalg.eigh(full)
    values, found = np.maximum(values[::-1], 0), found.T[::-1]
    lead = found[np.arange(length), np.argmax(np.round(np.abs(found), 9), axis=1)]
    return (found * np.where(lead < 0, -1.0, 1.0)[:, None])[:k], (values / (values.sum() or 1.0))[:k]


def project(vectors: DataFrame, vector: str, names: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Rows whose vector takes part (see usable), with their coordinates on the leading axes in columns of these names.

    vectors is read four times (length, means, covariance, result): store it first if it is dear to compute.
    Columns that have the names are replaced, all others stay; repeated rows come back as they are. With fewer
    components than names the further coordinates are 0; no usable rows give an empty table.
    """
    rows = usable(vectors, vector)
    centre = means(rows, vector)
    lead = axes(covariance(rows, vector, centre), len(centre), len(names))[0] if centre else np.zeros((0, 0))
    doubles = lambda a: F.lit([float(x) for x in a]).cast("array<double>")

    def along(axis: np.ndarray) -> Column:
        parts = F.zip_with(F.col(vector), doubles(axis), lambda v, a: v * a)
        return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) - F.lit(float(np.dot(centre, axis)))

    return rows.withColumns({name: along(lead[k]) if k < len(lead) else F.lit(0.0) for k, name in enumerate(names)})
