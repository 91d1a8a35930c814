"""Reach within parts of the edges: few rounds along numbers, and the plain model at several times a part."""

import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import graph as G


def model(roots, edges, stop):
    seen, left = set(), [r for r in roots if r not in stop]
    while left:
        n = left.pop()
        if n not in seen:
            seen.add(n)
            left += [b for a, b in edges if a == n and b not in stop]
    return sorted(seen)


@pytest.mark.parametrize("seed", range(3))
def test_several_times_a_part(spark, monkeypatch, seed):
    r = random.Random(seed)
    edges = [(r.randrange(30), r.randrange(40)) for _ in range(45)]
    roots, stop = [r.randrange(30) for _ in range(3)] + [77], [r.randrange(30) for _ in range(3)]
    monkeypatch.setattr(G, "LOCAL_EDGES", 9)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for name in (lambda n: n, lambda n: f"n{n}"):
            kind = "long" if name(0) == 0 else "string"
            table = lambda rows: spark.createDataFrame([(name(n),) for n in rows], f"node {kind}")
            e = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"src {kind}, dst {kind}")
            got = [x["node"] for x in G.reach(table(roots), e, table(stop)).collect()]
            assert sorted(got) == sorted(name(n) for n in model(roots, edges, stop))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(G, "LOCAL_EDGES", 1000)
    rounds, settle = [], G.settle
    monkeypatch.setattr(G, "settle", lambda df: rounds.append(1) or settle(df))
    chain = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert G.reach(spark.createDataFrame([(0,)], "node long"), chain).count() == 3001
    assert len(rounds) < 100  # a round a step would take 3,000
