"""Strong components of many graphs at once: graphs of a bounded size share bins, each followed by one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored_and_count

#: Edges of a graph that one task follows, and of a bin on average.
LARGEST, BIN = 3_000_000, 300_000


def strong(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes one node of its strong component over the edges a -> b, by one search in depth (Tarjan's)."""
    order = np.argsort(a, kind="stable")
    next_, first = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    at, seen, low, of, count = first[:n], [0] * n, [0] * n, [-1] * n, 0
    for root in range(n):
        if seen[root]:
            continue
        count += 1
        seen[root] = low[root] = count
        path, open_ = [root], [root]
        while path:
            v = path[-1]
            k = at[v]
            if k < first[v + 1]:
                at[v], w = k + 1, next_[k]
                if not seen[w]:
                    count += 1
                    seen[w] = low[w] = count
                    path.append(w)
                    open_.append(w)
                elif of[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == seen[v]:
                while of[v] < 0:
                    of[open_.pop()] = v
    return np.array(of, np.int64)


def strong_parts(table: pa.Table) -> pa.Table:
    """(node, component) of the components of more than one node over edges (src, dst) between longs."""
    src, dst = (table.column(c).to_numpy() for c in ("src", "dst"))
    nodes, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
    part = strong(code[: len(src)], code[len(src) :], len(nodes))
    more = np.flatnonzero(np.bincount(part, minlength=len(nodes))[part] > 1)
    return pa.table({"node": nodes[more], "component": nodes[part[more]]})


def of_small(edges: DataFrame, group: str, n: int) -> tuple[DataFrame, DataFrame | None]:
    """The components (node, component) of groups of at most LARGEST of the n edges (group, src, dst), and the edges of larger groups, if any."""
    large, some = stored_and_count(edges.groupBy(group).count().where(F.col("count") > LARGEST).select(group))
    small = edges.join(F.broadcast(large), group, "left_anti") if some else edges
    found = small.groupBy(F.pmod(F.xxhash64(group), F.lit(-(-n // BIN) or 1)).alias("bin")).applyInArrow(lambda t: strong_parts(t.select(["src", "dst"])), "node long, component long")
    return found, edges.join(F.broadcast(large), group, "left_semi") if some else None
