"""Handler graphs: bounded reachability from event handlers, induced edges, and pruning.

Edges are (app_id, src, dst, type); nodes are (app_id, node_id, name, is_self, is_widget). Ids and names are an app's own.
All handler graphs of all apps are built at once: reach depends only on the handler, so widgets are joined to it afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import APP, CALL, EVENT, FIND, HOLD, KEYS, USE, is_noise
from . import within
from .bins import LARGEST
from .closure import closure, components, condensed, reached
from .scratch import stored
from .within import reached_within


def adjacency(edges: DataFrame, find_edge: bool = False) -> DataFrame:
    """HOLD edges turn round, FIND edges go unless wanted."""
    kept = edges if find_edge else edges.where(F.col("type") != FIND)
    hold = F.col("type") == HOLD
    return kept.select(APP, F.when(hold, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(hold, F.col("src")).otherwise(F.col("dst")).alias("dst"), "type")


def eligible(edges: DataFrame, nodes: DataFrame, calls: list[str] = (), classes: list[str] = (), find_edge: bool = False) -> DataFrame:
    """Edges that a traversal may take, with whether each end is an own method and whether both are library methods (api_call)."""
    ends = nodes.select(APP, F.col("node_id").alias("dst"), F.col("is_self").alias("dst_self"), is_noise(F.col("name"), calls, classes).alias("noise"))
    starts = nodes.select(APP, F.col("node_id").alias("src"), F.col("is_self").alias("src_self"))
    return adjacency(edges, find_edge).join(ends, [APP, "dst"]).where("NOT noise").join(starts, [APP, "src"]).select(APP, "src", "dst", "type", ((F.col("type") == CALL) & ~F.col("dst_self") & ~F.col("src_self")).alias("api_call"), "src_self", "dst_self")


def _states(ok: DataFrame, nodes: DataFrame, seeds: DataFrame, hop: int) -> tuple[DataFrame, DataFrame]:
    """The edges that paths may take between states (src, dst, edge), and the state of each seed (app_id, seed, node).

    A state is an app's node; with a limit it is one of a node and its depth. Own methods have the depth -1, whatever led to
    them; a library method that an own one calls has 0, one that a library method calls has one more than that.
    """
    edge = F.struct(APP, "src", "dst", "type").alias("edge")
    if hop < 1:
        at = lambda c: F.struct(APP, F.col(c).alias("id"))
        taken = ok if hop < 0 else ok.where("NOT api_call")
        return taken.select(at("src").alias("src"), at("dst").alias("dst"), edge), seeds.select(APP, "seed", at("seed").alias("node"))
    at = lambda c, d: F.struct(APP, F.col(c).alias("id"), d.cast("int").alias("depth"))
    depths = F.when(F.col("src_self"), F.array(F.lit(-1))).when(F.col("api_call"), F.sequence(F.lit(0), F.lit(hop - 1))).otherwise(F.sequence(F.lit(0), F.lit(hop)))
    to = F.when(F.col("dst_self"), F.lit(-1)).when(F.col("api_call"), F.col("d") + 1).otherwise(F.lit(0))
    begin = seeds.distinct().join(nodes.select(APP, F.col("node_id").alias("seed"), "is_self"), [APP, "seed"])
    taken = ok.withColumn("d", F.explode(depths)).select(at("src", F.col("d")).alias("src"), at("dst", to).alias("dst"), edge)
    return taken, begin.select(APP, "seed", at("seed", F.when(F.col("is_self"), -1).otherwise(0)).alias("node"))


def reach(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hop: int = 0, calls: list[str] = (), classes: list[str] = (), find_edge: bool = False) -> DataFrame:
    """(app_id, seed, node) under the hop rule: from an own method's library call at most `hop` library calls on; -1 has no limit.

    seeds: app_id and seed. A library method that calls an own one leads back to it, and its calls count anew. Of several
    ways to a node the shortest counts.
    """
    taken, begin = _states(stored(eligible(edges, nodes, calls, classes, find_edge)), nodes, seeds, hop)
    pairs = closure(taken, begin.select(F.col("node").alias("seed")), [APP]).select(f"seed.{APP}", F.col("seed.id").alias("seed"), F.col("node.id").alias("node"))
    return pairs if hop < 1 else pairs.distinct()


def handler_edges(edges: DataFrame, nodes: DataFrame, hop: int = 0, calls: list[str] = (), classes: list[str] = (), find_edge: bool = False) -> DataFrame:
    """(app_id, uid, eid, src, dst, type) of every handler graph of more than one edge; methods with a listed word are not entered.

    Edges lie with the parts (strong components and single nodes) that hold their sources, edges of widgets with those of
    their targets, and handlers with the parts they lead to: the two meet once, at the end, where no edge comes twice. Only
    under a hop rule an edge may lie with several depths of its source.
    """
    events = stored(edges.where(F.col("type") == EVENT).select(APP, F.col("src").alias("uid"), F.col("dst").alias("eid")).distinct())
    ok = stored(eligible(edges, nodes, calls, classes, find_edge).dropDuplicates([APP, "src", "dst", "type"]))
    taken, begin = _states(ok, nodes, events.select(APP, F.col("eid").alias("seed")), hop)
    r = condensed(taken, begin, [APP])
    of = r.of.withColumnRenamed("node", "state")
    widgets = nodes.where("is_widget").select(APP, F.col("node_id").alias("src"))
    into = stored(edges.where(F.col("type").isin(USE, EVENT)).select(APP, "src", "dst", "type").distinct().join(widgets, [APP, "src"], "left_semi"))
    plain = lambda df: df.select(F.col(f"state.{APP}").alias(APP), F.col("state.id").alias("dst"), *[c for c in df.columns if c != "state"])
    out = taken.join(of, F.col("src") == F.col("state")).select("part", "edge.src", "edge.dst", "edge.type")
    users = into.join(plain(of), [APP, "dst"]).select("part", "src", "dst", "type")
    held = stored(out.unionByName(users))
    used = plain(r.leaves.withColumnRenamed("node", "state")).join(into.select(APP, "dst").distinct(), [APP, "dst"], "left_semi").select("part", APP, "dst")
    tips = stored(r.pairs.join(used, "part").select("start", APP, "dst").distinct().join(into, [APP, "dst"]).select("start", "src", "dst", "type"))
    starts = begin.select(APP, F.col("seed").alias("eid"), "node").distinct().join(r.of, "node").select(APP, "eid", F.col("part").alias("start"))
    begun = stored(events.join(starts, [APP, "eid"]).select(*KEYS, "start"))
    led = stored(begun.join(r.pairs, "start").select(*KEYS, "part"))
    own = events.join(widgets.withColumnRenamed("src", "uid"), [APP, "uid"], "left_anti")
    there = led.join(held.where(F.col("type") == EVENT), "part").where("src = uid AND dst = eid").select(*KEYS)
    own = stored(own.join(there, KEYS, "left_anti"))
    counts = led.join(held.groupBy("part").agg(F.count("*").alias("n")), "part").select(*KEYS, "n")
    counts = counts.unionByName(begun.join(tips.groupBy("start").agg(F.count("*").alias("n")), "start").select(*KEYS, "n")).unionByName(own.select(*KEYS, F.lit(1).cast("bigint").alias("n")))
    big = stored(counts.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n > 1").select(*KEYS))
    some = lambda df: df.join(big, KEYS, "left_semi")
    columns = [*KEYS, "src", "dst", "type"]
    every = some(led).join(held, "part").select(columns).unionByName(some(begun).join(tips, "start").select(columns))
    every = every.unionByName(some(own).select(*KEYS, F.col("uid").alias("src"), F.col("eid").alias("dst"), F.lit(EVENT).alias("type")))
    return every if hop < 1 else every.distinct()


def sizes(graph: DataFrame) -> DataFrame:
    """Distinct nodes and edges of each handler graph; each edge is counted with its source."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("n")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("n"))))
    per = graph.select(*KEYS, ends.alias("end")).groupBy(*KEYS, F.col("end.node").alias("node")).agg(F.sum("end.n").alias("n"))
    return per.groupBy(*KEYS).agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n_edges"))


def child_widgets(graph: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(app_id, uid, eid, child): other widgets all of whose event and use edges lie in the handler graph."""
    widgets = nodes.where("is_widget").select(APP, F.col("node_id").alias("src"))
    total = edges.where(F.col("type").isin(USE, EVENT)).distinct().join(widgets, [APP, "src"], "left_semi").groupBy(APP, "src").agg(F.count("*").alias("total"))
    held = graph.join(widgets, [APP, "src"], "left_semi").where(F.col("type").isin(USE, EVENT)).groupBy(*KEYS, "src").agg(F.count("*").alias("held"))
    return held.join(total, [APP, "src"]).where("held = total AND src <> uid").select(*KEYS, F.col("src").alias("child"))


def prune_events(graph: DataFrame) -> DataFrame:
    """Event edges go, but for those of the own widget."""
    return graph.where((F.col("type") != EVENT) | (F.col("src") == F.col("uid")))


def _at(c: str) -> Column:
    """A node of one handler graph."""
    return F.struct(*KEYS, F.col(c).alias("id"))


def prune_cases(graph: DataFrame, cases: DataFrame) -> DataFrame:
    """Removes what the callers of case pairs (app_id, uid, eid, src, dst) call beside them, and what that leads to.

    A pair counts whether or not its call is in the graph. Removal spreads over all edges from the targets and does not
    expand callees of case pairs; edges that a kept branch shares go as well.
    """
    pairs = stored(cases.select(*KEYS, "src", "dst").distinct())
    large = stored(graph.groupBy(*KEYS).count().where(F.col("count") > within.LARGEST).select(*KEYS))
    rows = graph.withColumn("case", F.lit(False)).unionByName(pairs.select("*", F.lit(CALL).alias("type"), F.lit(True).alias("case")), allowMissingColumns=True)
    some = large.isEmpty()
    rest = rows if some else rows.join(F.broadcast(large), KEYS, "left_anti")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in graph.schema.fields)
    found = within.whole(rest, KEYS, lambda t: within.without_cases(t, KEYS, CALL, EVENT), schema)
    if some:
        return found
    of = lambda df: df.join(F.broadcast(large), KEYS, "left_semi")
    return found.unionByName(_without_cases_by_rounds(stored(of(graph)), of(pairs)))


def _without_cases_by_rounds(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    base = prune_events(graph)
    kept_call = pairs.withColumn("type", F.lit(CALL))
    seeds = stored(base.where(F.col("type") != EVENT).join(pairs.select(*KEYS, "src").distinct(), [*KEYS, "src"], "left_semi").join(kept_call, [*KEYS, "src", "dst", "type"], "left_anti"))
    kept = pairs.select(*KEYS, F.col("dst").alias("src")).distinct()
    some = graph.join(seeds.select(*KEYS).distinct(), KEYS, "left_semi").join(kept, [*KEYS, "src"], "left_anti")
    starts = seeds.select(*KEYS, F.col("dst").alias("src")).distinct().join(kept, [*KEYS, "src"], "left_anti")
    gone = stored(reached_within(some, starts.withColumnRenamed("src", "node"), KEYS).withColumnRenamed("node", "src").join(kept, [*KEYS, "src"], "left_anti"))
    left = base.join(gone, [*KEYS, "src"], "left_anti")
    return left.join(seeds.select(*KEYS, "src", "dst", "type"), [*KEYS, "src", "dst", "type"], "left_anti")


def prune_leaves(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Removes calls between own methods whose callee has no out-edges, again and again until none is left.

    What stays are the callees from which such calls lead to a method on a cycle of them or with another out-edge.
    """
    own = nodes.where("is_self").select(APP, "node_id")
    flagged = graph.join(own.select(APP, F.col("node_id").alias("src"), F.lit(True).alias("a")), [APP, "src"], "left").join(own.select(APP, F.col("node_id").alias("dst"), F.lit(True).alias("b")), [APP, "dst"], "left")
    flagged = stored(flagged.select(*KEYS, "src", "dst", "type", ((F.col("type") == CALL) & F.coalesce("a", F.lit(False)) & F.coalesce("b", F.lit(False))).alias("inner")))
    calls = stored(flagged.where("inner").select(_at("src").alias("src"), _at("dst").alias("dst")).distinct())
    ends = flagged.where("NOT inner OR src = dst").select(_at("src").alias("node")).distinct()
    anchors = stored(ends.unionByName(components(calls, KEYS).select("node")).distinct())
    alive = reached(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), anchors)
    alive = alive.select(*[F.col(f"node.{k}") for k in KEYS], F.col("node.id").alias("dst"))
    return flagged.where("NOT inner").unionByName(flagged.where("inner").join(alive, [*KEYS, "dst"], "left_semi").select(flagged.columns)).drop("inner")


def next_edge_type(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each own method that is called: -1 without out-edges, 0 if it only calls own methods, else 1."""
    self_ = nodes.select(APP, F.col("node_id").alias("dst"), "is_self")
    callee = graph.where(F.col("type") == CALL).select(*KEYS, F.col("dst").alias("node")).distinct().join(nodes.where("is_self").select(APP, F.col("node_id").alias("node")), [APP, "node"], "left_semi")
    out = graph.join(self_, [APP, "dst"]).groupBy(*KEYS, F.col("src").alias("node")).agg(F.bool_and("is_self").alias("inner"))
    return callee.join(out, [*KEYS, "node"], "left").select(*KEYS, "node", F.when(F.col("inner").isNull(), -1).when(F.col("inner"), 0).otherwise(1).alias("next_type"))


def linked_to_ui(edges: DataFrame) -> DataFrame:
    return edges.groupBy(APP, F.col("dst").alias("node")).agg((F.sum("type") > 0).alias("linked"))


def reached_by_app(edges: DataFrame, nodes: DataFrame, calls: list[str] = (), classes: list[str] = (), find_edge: bool = False) -> DataFrame:
    """(app_id, node): what the handlers of each app lead to without a limit of hops, in space that grows with the edges only."""
    ok = eligible(edges, nodes, calls, classes, find_edge).select(APP, "src", "dst")
    return reached_within(ok, edges.where(F.col("type") == EVENT).select(APP, F.col("dst").alias("node")), [APP], LARGEST)


def circles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(app_id, node, least, n): own methods that call each other in a circle, with the circle's least method and its size."""
    at = lambda c: F.struct(APP, F.col(c).alias("id"))
    own = nodes.where("is_self").select(APP, "node_id")
    calls = edges.where(F.col("type") == CALL).join(own.withColumnRenamed("node_id", "src"), [APP, "src"], "left_semi").join(own.withColumnRenamed("node_id", "dst"), [APP, "dst"], "left_semi")
    parts = stored(components(stored(calls.select(at("src").alias("src"), at("dst").alias("dst")).distinct()), [APP]))
    all_ = parts.groupBy("component").agg(F.min("node.id").alias("least"), F.count("*").alias("n"))
    return parts.join(all_, "component").select(f"node.{APP}", F.col("node.id").alias("node"), "least", "n")
