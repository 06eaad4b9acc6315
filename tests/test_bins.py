"""Strong components and reach of groups that share a bin, against those by rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import bins, closure, graph, within


def _groups(spark):
    rng = np.random.default_rng(3)
    edges = [(f"g{k}", 1000 * k + int(a), 1000 * k + int(b)) for k, m in ((0, 40), (1, 400), (2, 90)) for a, b in rng.integers(0, 90, (m, 2))]
    edges += [("g3", 3000 + k, 3000 + (k + 1) % 500) for k in range(500)]
    return spark.createDataFrame(edges, "g string, src long, dst long")


def _parts(df):
    of = {}
    for node, part in df.collect():
        of.setdefault(part, set()).add(node)
    assert all(part in nodes for part, nodes in of.items())
    return {frozenset(x) for x in of.values()}


@pytest.mark.parametrize("largest", [0, 100, 10_000])
def test_components_in_bins_are_those_by_rounds(spark, monkeypatch, largest):
    edges, rounds, by_rounds = _groups(spark), [], closure._by_rounds
    wanted = _parts(closure.components(edges))
    monkeypatch.setattr(closure, "_by_rounds", lambda df: rounds.append(1) or by_rounds(df))
    monkeypatch.setattr(bins, "LARGEST", largest)
    assert _parts(closure.components(edges, ["g"])) == wanted and frozenset(range(3000, 3500)) in wanted
    assert len(rounds) == (largest < 10_000)
    at = lambda c: F.struct("g", F.col(c).alias("id")).alias(c)
    assert {frozenset(x.id for x in p) for p in _parts(closure.components(edges.select(at("src"), at("dst")), ["g"]))} == wanted


def test_closure_from_all_nodes_doubles_its_pairs(spark, monkeypatch):
    edges = _groups(spark).where("g <> 'g1'").unionByName(spark.createDataFrame([("g4", 4000 + k, 4001 + k) for k in range(100)], "g string, src long, dst long"))
    seeds = edges.select(F.col("src").alias("seed")).distinct()
    wanted = set()
    led = {}
    for _, a, b in edges.collect():
        led.setdefault(a, set()).add(b)
    for (s,) in seeds.collect():
        found, front = {s}, [s]
        while front:
            front = [y for x in front for y in led.get(x, ()) if y not in found and not found.add(y)]
        wanted |= {(s, x) for x in found}
    writes, store = [], closure.stored_and_count
    monkeypatch.setattr(closure, "stored_and_count", lambda *a: writes.append(1) or store(*a))
    assert set(map(tuple, closure.closure(edges, seeds).collect())) == wanted
    assert len(writes) < 30
    few = seeds.where("seed % 7 = 1")
    assert set(map(tuple, closure.closure(edges, few).collect())) == {(s, x) for s, x in wanted if s % 7 == 1}


@pytest.mark.parametrize("largest", [1, 10_000])
def test_what_handlers_of_an_app_reach(spark, monkeypatch, largest):
    rounds = []
    monkeypatch.setattr(graph, "LARGEST", largest)
    monkeypatch.setattr(within, "reached", lambda *a: rounds.append(1) or closure.reached(*a))
    edges = spark.createDataFrame([("A", 0, 1, 4), *[("A", k, k + 1, 0) for k in range(1, 30)], ("A", 40, 41, 0), ("B", 0, 7, 4)], "app_id string, src long, dst long, type int")
    nodes = spark.createDataFrame([(a, k, f"<x.C: void m{k}()>", True, k == 0) for a in "AB" for k in range(42)], "app_id string, node_id long, name string, is_self boolean, is_widget boolean")
    got = sorted(map(tuple, graph.reached_by_app(edges, nodes).collect()))
    assert got == [("A", k) for k in range(1, 31)] + [("B", 7)]
    assert len(rounds) == (largest == 1)
