"""Rings within parts of the edges, at several times a part, against the plain model."""

import random

import pytest

from stratalens.operators import graph as G

from .test_graph_rounds import graphs, model_rings


@pytest.mark.parametrize("number", range(len(graphs()) + 2))
def test_several_times_a_part(spark, monkeypatch, number):
    r = random.Random(number)
    made = [{(r.randrange(12), r.randrange(12)) for _ in range(40)} for _ in range(2)]
    edges = [e for e in (graphs() + made)[number] for _ in range(2)]
    r.shuffle(edges)
    monkeypatch.setattr(G, "LOCAL_EDGES", 9)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        members, left = G._rings_within(spark.createDataFrame(edges, "src long, dst long").coalesce(1), 1)
        found = G._led_on(members, G._rings_by_rounds(left))
        assert sorted(map(tuple, found.collect())) == sorted(model_rings(edges).items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_closure_of_a_graph_with_rings(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 4), (6, 6), (7, 0)]
    got = sorted(map(tuple, G.closure(spark.createDataFrame(edges, "src long, dst long")).collect()))
    ring, late = [0, 1, 2], [4, 5]
    want = [(a, b) for a in [*ring, 7] for b in [*ring, 3, *late]] + [(a, b) for a in [3, *late] for b in late] + [(6, 6)]
    assert got == sorted(want)
