"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, searched by beams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between a[i] and each of b[i]."""
    d = b - a[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-first search of all queries side by side: the beam's ids and distances in order, and what was expanded.

    edges has -1 where a row has fewer neighbours. Every step expands the nearest node of each beam that
    was not expanded yet, until no query has one.
    """
    n = len(queries)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf)
    done = np.zeros((n, beam), bool)
    ids[:, 0] = start
    dist[:, 0] = _dist(queries, np.broadcast_to(x[start], (n, 1, x.shape[1])))[:, 0]
    seen: list[np.ndarray] = []
    live = np.arange(n)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        best = open_.argmin(1)
        going = np.isfinite(open_[np.arange(len(live)), best])
        live, best = live[going], best[going]
        if not len(live):
            break
        node = ids[live, best]
        done[live, best] = True
        step = np.full(n, -1, np.int64)
        step[live] = node
        seen.append(step)
        near = edges[node]
        far = np.where(near < 0, np.inf, _dist(queries[live], x[np.maximum(near, 0)]))
        known = (near[:, :, None] == ids[live][:, None, :]).any(2)
        far[known] = np.inf
        all_ids, all_dist = np.hstack([ids[live], near]), np.hstack([dist[live], far])
        all_done = np.hstack([done[live], np.zeros(near.shape, bool)])
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        rows = np.arange(len(live))[:, None]
        ids[live], dist[live], done[live] = all_ids[rows, order], all_dist[rows, order], all_done[rows, order]
        ids[live] = np.where(np.isfinite(dist[live]), ids[live], -1)
    return ids, dist, np.stack(seen, 1) if seen else np.full((n, 0), -1, np.int64)


def robust_prune(x: np.ndarray, node: int, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Keeps the nearest candidate, drops those that alpha times its distance reaches, and repeats."""
    near = np.unique(near[(near >= 0) & (near != node)])
    d = ((x[near] - x[node]) ** 2).sum(1)
    order = np.argsort(d, kind="stable")
    near, d = near[order], d[order]
    between = ((x[near][:, None, :] - x[near][None, :, :]) ** 2).sum(2)
    alive, kept = np.ones(len(near), bool), []
    while len(kept) < degree:
        left = np.flatnonzero(alive)
        if not len(left):
            break
        k = left[0]
        kept.append(k)
        alive &= alpha * alpha * between[k] > d
        alive[k] = False
    return near[kept]


def build(x: np.ndarray, degree: int = 24, beam: int = 40, alpha: float = 1.2, batch: int = 256) -> tuple[np.ndarray, int]:
    """Edges (-1 padded) and the start node. Two passes over a fixed random order; searches of a batch run side by side."""
    n = len(x)
    rng = np.random.RandomState(7)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    edges = np.full((n, degree), -1, np.int64)
    fill = min(degree // 2, n - 1)
    if fill > 0:
        edges[:, :fill] = (np.arange(n)[:, None] + rng.randint(1, n, (n, fill))) % n
    for a in (1.0, alpha) if n > 1 else ():
        order = rng.permutation(n)
        for i in range(0, n, batch):
            some = order[i : i + batch]
            ids, _, seen = beam_search(x, edges, start, x[some], beam)
            back: dict[int, list[int]] = {}
            for node, found, steps in zip(some, ids, seen, strict=True):
                kept = robust_prune(x, node, np.concatenate([found, steps, edges[node]]), degree, a)
                edges[node] = -1
                edges[node, : len(kept)] = kept
                for k in kept:
                    back.setdefault(int(k), []).append(int(node))
            for node, more in back.items():
                old = edges[node][edges[node] >= 0]
                both = np.concatenate([old, np.setdiff1d(more, old)])
                if len(both) > degree:
                    both = robust_prune(x, node, both, degree, a)
                edges[node] = -1
                edges[node, : len(both)] = both
    return edges, start


def _arrays(values: pd.Series | list) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 2048, query_rows: int = 512, degree: int = 24, beam: int = 96) -> DataFrame:
    """The k nearest other rows of `vectors` for each row of `queries`: query_id, rank (from 1), vec_id, score.

    Equal vectors are one node of the graph: a node keeps the k + 1 smallest keys, all that an answer can
    hold. Nodes are dealt to shards of about shard_rows by hash; each shard builds one graph, and every
    block of queries meets every shard by a join on the shard's number. score is the Euclidean distance
    in double precision; ties go to the smaller key. A query's own key is never an answer, so a repeated
    key counts once. Rows with a null key, a null, empty or all-zero vector, null or non-finite components
    or another length than most (the commonest length) take no part. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    wide = "array<double>"
    fit = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(wide).alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity')) AND exists(v, c -> c <> 0)"
    )
    home = textops.shared_dir(spark)
    good = fit(vectors)
    # Two rounds: the smallest keys within each of 32 parts of a group first, so that no group meets whole in one task.
    parts = Window.partitionBy("h", "v", F.pmod(F.hash("id"), F.lit(32))).orderBy("id")
    rows = good.select("id", "v", F.xxhash64("v").alias("h")).withColumn("r", F.row_number().over(parts)).where(F.col("r") <= k + 1)
    whole = Window.partitionBy("h", "v").orderBy("id")
    rows = rows.dropDuplicates(["h", "v", "id"]).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    nodes = textops.stored(rows.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), f"{home}/nodes")
    sizes = nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n_shards = sizes["dim"], max(1, -(-sizes["n"] // shard_rows))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        x = _arrays(pdf["v"])
        edges, start = build(x, degree)
        keys = [np.asarray(i, np.int64) for i in pdf["ids"]]
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(x)], "start": [start], "x": [x.tobytes()], "edges": [edges.astype("<i4").tobytes()], "counts": [np.array([len(i) for i in keys], "<i4").tobytes()], "keys": [np.concatenate(keys).astype("<i8").tobytes()]})

    dealt = nodes.where(F.size("v") == dim).withColumn("shard", F.pmod("h", F.lit(n_shards)).cast("int"))
    index = textops.stored(dealt.groupBy("shard").applyInPandas(graph, "shard int, n int, start int, x binary, edges binary, counts binary, keys binary"), f"{home}/index")
    asked = fit(queries).where(F.size("v") == dim).dropDuplicates(["id"])
    n_blocks = max(1, -(-asked.count() // query_rows))
    blocks = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("qs"))
    # Spark reckons the blocks' size before they are repeated for each shard, and would collect them all in the driver.
    pairs = blocks.select("qs", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")).join(index.hint("merge"), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                n = r["n"]
                x, edges = np.frombuffer(r["x"]).reshape(n, dim), np.frombuffer(r["edges"], "<i4").reshape(n, -1).astype(np.int64)
                counts, keys = np.frombuffer(r["counts"], "<i4"), np.frombuffer(r["keys"], "<i8")
                first = np.cumsum(counts) - counts
                ids, q = np.array([p["id"] for p in r["qs"]], np.int64), _arrays([p["v"] for p in r["qs"]])
                found, _, _ = beam_search(x, edges, r["start"], q, max(beam, k + 1))
                out: list[tuple[int, int, float]] = []
                for i, (qid, row_ids) in enumerate(zip(ids, found, strict=True)):
                    row_ids = row_ids[row_ids >= 0]
                    d = np.sqrt(((x[row_ids] - q[i]) ** 2).sum(1))
                    got = [(float(s), int(v), int(qid)) for s, node in zip(d, row_ids, strict=True) for v in keys[first[node] : first[node] + counts[node]] if v != qid]
                    out += [(b, a, s) for s, a, b in sorted(got)[:k]]
                if out:
                    a, b, s = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
