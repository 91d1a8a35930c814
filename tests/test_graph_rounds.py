"""Levels and rings of graphs that are kept from one task, against plain models."""

import random
import time

import pytest
from pyspark.sql import functions as F

from stratalens.operators import graph as G


def model_levels(nodes, edges):
    """Longest paths; nodes on a cycle or in need of one have none."""
    needs = {n: set() for n in nodes}
    for a, b in edges:
        if b in needs:
            needs.setdefault(a, set()).add(b)
    level, rest = {}, {n for n in nodes}
    while ready := [n for n in rest if all(d in level for d in needs[n])]:
        level |= {n: max((level[d] + 1 for d in needs[n]), default=0) for n in ready}
        rest -= set(ready)
    return level


def model_rings(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    reach = {}
    for a in to:
        seen, todo = set(), list(to[a])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += to.get(x, ())
        reach[a] = seen
    return {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in to if a in reach[a]}


def graphs():
    r = random.Random(11)
    out = []
    for k in (0, 2):  # sparse graphs, with chains, trees and cycles of single needs
        n = 60
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(n + 10 * k)}
        out.append(edges)
    chain = [(i, i + 1) for i in range(40)]
    out.append(set(chain) | {(41, 20), (42, 20), (20, 60), (60, 61), (61, 20), (70, 70), (71, 70), (100, 101), (101, 100), (102, 100), (103, 102)})
    out.append({(i, (i + 1) % 50) for i in range(50)} | {(7, 80), (80, 81), (81, 9), (90, 3)})
    out.append({(i, j) for i in range(6) for j in range(i)} | {(6, 5), (7, 6), (8, 7), (8, 2)})
    return out


@pytest.mark.parametrize("number", range(len(graphs())))
def test_against_plain_models(spark, monkeypatch, number):
    monkeypatch.setattr(G, "LOCAL_EDGES", 3)
    edges = sorted(graphs()[number])
    nodes = sorted({x for e in edges for x in e})
    e = spark.createDataFrame(edges, "src long, dst long")
    n = spark.createDataFrame([(x,) for x in nodes], "node long")
    assert {r["node"]: r["level"] for r in G.levels(n, e).collect()} == model_levels(nodes, edges)
    assert {r["node"]: r["ring"] for r in G.rings(e).collect()} == model_rings(edges)


def test_a_deep_chain_and_a_long_ring(spark, monkeypatch):
    monkeypatch.setattr(G, "LOCAL_EDGES", 1000)
    deep = 100_000
    i = spark.range(deep)
    edges = i.filter("id > 0").select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    start = time.perf_counter()
    got = G.levels(i.select(F.col("id").alias("node")), edges)
    assert got.filter("node = level").count() == deep == got.count()
    took = time.perf_counter() - start
    ring = edges.union(spark.createDataFrame([(0, deep - 1), (deep, 5), (7, deep + 1)], "src long, dst long"))
    got = G.rings(ring)
    assert got.filter("ring = 0").count() == deep == got.count()
    assert took < 60


def test_rounds_of_levels_broadcast_nothing(spark, monkeypatch):
    plans, settle = [], G.settle

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(G, "LOCAL_EDGES", 20)
    monkeypatch.setattr(G, "settle", seen)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 40)] + [(i, i - 7) for i in range(8, 40, 4)], "src long, dst long")
    got = dict(map(tuple, G.levels(spark.range(40).select(F.col("id").alias("node")), edges).collect()))
    want = {}
    for i in range(40):
        needs = [i // 2] * (i > 0) + [i - 7] * (i > 7 and i % 4 == 0)
        want[i] = max((want[j] + 1 for j in needs), default=0)
    assert got == want and len(plans) > 5
    assert not any("Broadcast" in p for p in plans)
    assert spark.conf.get(key) == before
