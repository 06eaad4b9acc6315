"""Reachability over edges (src, dst) whose ends are of any type that can be ordered: labels, strong components, closure.

Rounds grow with the logarithm of paths where labels jump, and with the levels between strong components in a closure.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bins import of_small
from .scratch import stored, stored_and_any, stored_and_count

#: After so many rounds the parts of a growing table are written as one.
TOGETHER = 12


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def least_ancestors(edges: DataFrame, salt: int = 0) -> DataFrame:
    """(node, label): the least node that leads to each end of an edge, itself included, in an order by salt.

    The label is a struct (hash, node). Each node follows one of its predecessors, and the one that follows, so that a round
    takes the least of the labels of all predecessors that moved and of as many nodes along that way as twice the rounds
    before it. No label moves any more when none is above a predecessor's.
    """
    ends = edges.select(F.col("src").alias("node"), F.lit(None).cast(edges.schema["src"].dataType).alias("by")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("by")))
    hashed = F.xxhash64("node", F.lit(salt)) if salt else F.lit(0).cast("bigint")
    now = ends.groupBy("node").agg(F.min("by").alias("by")).select("node", F.coalesce("by", "node").alias("via"), F.struct(hashed.alias("hash"), "node").alias("label"), F.lit(True).alias("moved"))
    now = stored(now)
    while True:
        led = edges.join(now.where("moved").select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("led"))
        way = now.select(F.col("node").alias("via"), F.col("via").alias("next"), F.col("label").alias("way"))
        least = F.least("label", "led", "way")
        new = now.drop("moved").join(led, "node", "left").join(way, "via").select("node", F.col("next").alias("via"), least.alias("label"), (least < F.col("label")).alias("moved"))
        now, moving = stored_and_any(new, F.col("moved"))
        if not moving:
            return now.select("node", "label")


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes that starts (node) lead to, themselves included.

    Nodes that are not reached yet follow one predecessor as above; each is reached once, when a node of the last round
    leads to it or when the one it follows is.
    """
    front = found = stored(starts.select("node").distinct())
    step = stored(edges.select("src", "dst").where("src <> dst").distinct())
    rest = step.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via")).join(front, "node", "left_anti")
    rest, k = stored(rest), 0
    while True:
        hit = step.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().withColumn("hit", F.lit(True))
        by = front.select(F.col("node").alias("via"), F.lit(True).alias("by"))
        flagged = rest.join(hit, "node", "left").join(by, "via", "left").select("node", "via", F.coalesce("hit", "by", F.lit(False)).alias("hit"))
        way = flagged.select(F.col("node").alias("via"), F.col("via").alias("next"), F.col("hit").alias("led"))
        new = flagged.join(way, "via", "left").select("node", F.coalesce("next", "via").alias("via"), (F.col("hit") | F.coalesce("led", F.lit(False))).alias("hit"))
        new, more = stored_and_any(new, F.col("hit"))
        if not more:
            return found
        front, rest, k = new.where("hit").select("node"), new.where("NOT hit").select("node", "via"), k + 1
        found = found.unionByName(front)
        if k % TOGETHER == 0:
            found = stored(found)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those to or from nodes on no circle, as long as a pass takes an eighth of them away."""
    now, n = stored_and_count(edges.select("src", "dst").where("src <> dst").distinct())
    while n:
        now, left = stored_and_count(now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if left * 8 > n * 7:
            break
        n = left
    return now


def numbers(nodes: DataFrame) -> DataFrame:
    """(node, no): a long for each distinct node, which is shorter to move than most keys."""
    return stored(nodes.select("node").distinct().withColumn("no", F.monotonically_increasing_id()))


def components(edges: DataFrame, group: list[str] = ()) -> DataFrame:
    """(node, component): strongly connected parts of more than one node, each named by one of them.

    group: what no edge changes, as fields of the ends where these are structs, else as columns of the edges. Graphs of one
    group of a bounded size are followed by one task (`bins`); without groups, and for larger ones, labels go by rounds.
    """
    struct, names = edges.schema["src"].dataType.typeName() == "struct", None
    if not group:
        now = _trimmed(edges)
    else:
        keys = F.struct(*[F.col(f"src.{g}" if struct else g).alias(g) for g in group]).alias("group")
        now = edges.select("src", "dst", keys).where("src <> dst")
    if edges.schema["src"].dataType.typeName() != "long":
        now = stored(now.distinct()) if group else now
        names = numbers(now.select(F.col("src").alias("node")).unionByName(now.select(F.col("dst").alias("node"))))
        to = lambda c: names.select(F.col("node").alias(c), F.col("no").alias(f"{c}_no"))
        now = now.join(to("src"), "src").join(to("dst"), "dst").select(F.col("src_no").alias("src"), F.col("dst_no").alias("dst"), *now.columns[2:])
    now, n = stored_and_count(now)
    found, large = of_small(now, "group", n) if group else (None, now)
    if large is not None:
        far = _by_rounds(_trimmed(large) if group else large)
        found = far if found is None else found.unionByName(far)
    if names is None:
        return found
    found = stored(found)
    back = lambda c: names.select(F.col("no").alias(c), F.col("node").alias(f"{c}_name"))
    return found.join(back("node"), "node").join(back("component"), "component").select(F.col("node_name").alias("node"), F.col("component_name").alias("component"))


def _by_rounds(now: DataFrame) -> DataFrame:
    """(node, component) over edges between longs, by labels.

    Nodes of one part have the same least ancestor, and, among nodes that share it, the same least descendant. Where both
    are one node, it names the part of all that have them. Edges between nodes that differ in either are in no part; what is
    left is labelled anew in another order.
    """
    found, salt = None, 0
    while True:
        up = least_ancestors(now, salt).select("node", F.col("label.node").alias("up"))
        ends = lambda df, labels, c: df.join(labels.select(F.col("node").alias("src"), F.col(c).alias("__a")), "src").join(labels.select(F.col("node").alias("dst"), F.col(c).alias("__b")), "dst").where("__a = __b").select("src", "dst")
        inner = stored(ends(now, up, "up"))
        down = least_ancestors(_reversed(inner), salt).select("node", F.col("label.node").alias("down"))
        both = stored(down.join(up, "node"))
        part = both.where("up = down").select("node", F.col("down").alias("component"))
        found = part if found is None else found.unionByName(part)
        now, more = stored_and_any(ends(inner, both.where("up <> down"), "down"), F.lit(True))
        if not more:
            break
        now, salt = _trimmed(now), salt + 1
    return found.join(found.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("node", "component")


class Reach(NamedTuple):
    """What starts lead to, by parts: strong components and single nodes, each a long."""

    of: DataFrame  # (node, part): the part of every start and of every node with out-edges that a start may lead to
    pairs: DataFrame  # (start, part): the parts that the part of a start leads to, itself included
    leaves: DataFrame  # (part, node): other nodes, which have no out-edges, that a part leads to; each pair once


def _all_pairs(links: DataFrame) -> DataFrame:
    """(start, part): what each source of links (src, dst) without circles leads to, in rounds that grow with the logarithm of paths.

    A pair whose shortest path has k to 2k links has a node k links on from its start, so that the pairs of k links meet
    those of up to k.
    """
    known, n = stored_and_count(links.select(F.col("src").alias("start"), F.col("dst").alias("part"), F.lit(1).alias("d")))
    k = 1
    while n:
        far = known.where(F.col("d") == k).select("start", F.col("part").alias("by"))
        led = far.join(known.select(F.col("start").alias("by"), "part", (F.col("d") + k).alias("d")), "by").groupBy("start", "part").agg(F.min("d").alias("d"))
        new, n = stored_and_count(led.join(known, ["start", "part"], "left_anti"))
        known, k = known.unionByName(new), 2 * k
    return known.select("start", "part")


def condensed(edges: DataFrame, starts: DataFrame, group: list[str] = ()) -> Reach:
    """Reach of starts (node) over edges. New pairs only are followed between parts; a path may have any length.

    group: fields of the nodes, which are structs then, that no edge changes. Where all nodes with out-edges are starts, pairs
    are doubled, as none between is in vain.
    """
    starts, n_starts = stored_and_count(starts.select("node").distinct())
    step = edges.select("src", "dst").where("src <> dst").distinct()
    step = stored(step.join(step.select(F.col("dst").alias("src")).unionByName(starts.select(F.col("node").alias("src"))).distinct(), "src", "left_semi"))
    names, n_names = stored_and_count(step.select(F.col("src").alias("node")).unionByName(starts).distinct().withColumn("no", F.monotonically_increasing_id()))
    named = step.join(names.select(F.col("node").alias("dst"), F.col("no").alias("b")), "dst", "left").join(names.select(F.col("node").alias("src"), F.col("no").alias("a")), "src")
    named = stored(named.select("a", "b", F.when(F.col("b").isNull(), F.col("dst")).alias("leaf"), *[F.col(f"src.{g}").alias(g) for g in group]))
    inner = named.where("b IS NOT NULL").select(F.col("a").alias("src"), F.col("b").alias("dst"), *group)
    parts = stored(components(inner, group))
    to_part = lambda df, c: df.join(parts.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    of = stored(to_part(names.select("node", F.col("no").alias("part")), "part"))
    links = stored(to_part(to_part(inner.select("src", "dst"), "src"), "dst").where("src <> dst").distinct())
    begin = starts.join(of, "node").select(F.col("part").alias("start")).distinct()
    front = stored(begin.withColumn("part", F.col("start")))
    known, k = front, 0
    if n_starts == n_names:
        known = known.unionByName(_all_pairs(links))
    while n_starts < n_names:
        out = front.join(links, F.col("part") == F.col("src")).select("start", F.col("dst").alias("part")).distinct()
        front, more = stored_and_any(out.join(known, ["start", "part"], "left_anti"), F.lit(True))
        if not more:
            break
        known, k = known.unionByName(front), k + 1
        if k % TOGETHER == 0:
            known = stored(known)
    leaves = to_part(named.where("b IS NULL").select(F.col("a").alias("part"), F.col("leaf").alias("node")), "part").distinct()
    return Reach(of, known, leaves)


def closure(edges: DataFrame, seeds: DataFrame, group: list[str] = ()) -> DataFrame:
    """(seed, node): all that each seed leads to, itself included.

    Strong components become one node each; seeds of one part share what it leads to. Memory grows with the edges and the
    result.
    """
    seeds = stored(seeds.select("seed").distinct())
    r = condensed(edges, seeds.select(F.col("seed").alias("node")), group)
    leaves = r.pairs.join(r.leaves, "part").select("start", "node").distinct()
    led = r.pairs.join(r.of, "part").select("start", "node").unionByName(leaves)
    begin = seeds.join(r.of, seeds["seed"] == r.of["node"]).select("seed", F.col("part").alias("start"))
    return begin.join(led, "start").select("seed", "node")
