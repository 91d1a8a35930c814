"""Properties: plain models of the segmenter and closures, row order, determinism, reuse."""

import random
import time

import pytest
from pyspark.sql import functions as F

from stratalens.functions import text as X
from stratalens.operators import facts as V, graph as G, incremental as I, ledger as L, rules as R, segment as S
from stratalens.plans import QUERIES
from stratalens.plans.store import store

SF = "/root/testdata/sf0.001"
SPACE = "\t\n\x0b\x0c\r \x85\xa0       　"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_segment(text):
    """(kind, path, text) of each block, line by line."""
    out, para, path, fence = [], [], [], None
    lines = [x.rstrip("\r") for x in text.split("\n")]
    if lines[0].lstrip("﻿").strip(SPACE) == "---":
        for i, x in enumerate(lines[1:], 1):
            if x.strip(SPACE) == "---":
                lines = lines[i + 1 :]
                break

    def flush():
        if para:
            out.append(("prose", list(path), "\n".join(para)))
            para.clear()

    for x in lines:
        if fence is not None:
            fence.append(x)
            if x.startswith("```"):
                out.append(("code", list(path), "\n".join(fence)))
                fence = None
        elif x.startswith("#"):
            flush()
            depth = len(x) - len(x.lstrip("#"))
            path = path[: depth - 1] + [x.lstrip("#").strip(SPACE)]
            out.append(("heading", list(path), x))
        elif x.startswith("```"):
            flush()
            fence = [x]
        elif not x.strip(SPACE):
            flush()
        else:
            para.append(x)
    if fence is not None:
        out.append(("code", list(path), "\n".join(fence)))
    flush()
    return out


@pytest.mark.parametrize("folded", [10**6, 0, 8])
def test_segmenter_against_a_plain_model(spark, folded):
    r = random.Random(7)
    parts = ["###### F", "#" * 15 + " deep", "# A", "## B", "### C  ", "text", "more text", "", "  ", "```", "```py", "---", "﻿---", "| a |", "end\r", "#x", "　"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame([(str(i), "v", t) for i, t in enumerate(texts)], "path string, revision string, text string")
    got = {}
    for x in S.segment(df, folded_lines=folded).orderBy("path", "ordinal").collect():
        got.setdefault(int(x["path"]), []).append((x["kind"], x["heading_path"], x["text"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_segment(t), repr(t)


def test_long_documents_take_linear_time(spark):
    text = "\n\n".join(f"{'#' * (i % 20 + 1)} h{i}" if i % 7 == 0 else f"paragraph {i}\nsecond line" for i in range(20_000))
    df = spark.createDataFrame([("a", "v", text)], "path string, revision string, text string")
    S.segment(df, folded_lines=0).count()
    start = time.perf_counter()
    assert S.segment(df).agg(F.max("ordinal"), F.count_if(F.col("kind") == "heading"), F.sum(F.size("heading_path"))).first()[:2] == (20_000, 2858)
    assert time.perf_counter() - start < 5


def test_deeply_nested_headings_keep_their_paths(spark):
    lines = [f"{'#' * d} h{i}" for i, d in enumerate([*range(1, 31), 20, 21, 5, 6, 40, 40])]
    text = "\n".join(lines)
    df = spark.createDataFrame([("a", "v", text)], "path string, revision string, text string")
    got = [(x["kind"], x["heading_path"], x["text"]) for x in S.segment(df, folded_lines=0).orderBy("ordinal").collect()]
    assert got == plain_segment(text)


def test_normalise_against_a_plain_model(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(SPACE + "abé​⁠.") for _ in range(r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for x in df.select("t", X.normalise("t").alias("n")).collect():
        words = "".join(" " if c in SPACE else c for c in x["t"]).split(" ")
        assert x["n"] == " ".join(w for w in words if w)


@pytest.mark.parametrize("local", [10**6, 3, 0])
@pytest.mark.parametrize("seed", [11, 12])
def test_closure_and_rings_against_a_plain_model(spark, monkeypatch, local, seed):
    monkeypatch.setattr(G, "LOCAL_EDGES", local)
    r = random.Random(seed)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(20)}
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            break
        reach |= more
    df = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    assert rows(G.closure(df)) == sorted(reach, key=str)
    ring = {a: min(b for x, b in reach if x == a and (b, a) in reach) for a, b in reach if a == b}
    assert dict(rows(G.rings(df))) == ring
    roots = df.filter("src < 3").select(F.col("src").alias("node")).distinct()
    stop = spark.createDataFrame([(5,), (2,)], "node bigint")
    free = {(a, b) for a, b in edges if not {a, b} & {5, 2}}
    seen = {a for a, _ in edges if a < 3 and a != 2}
    while more := {b for a, b in free if a in seen} - seen:
        seen |= more
    assert sorted(x["node"] for x in G.reach(roots, df, stop).collect()) == sorted(seen)
    down = {(max(e), min(e)) for e in edges if e[0] != e[1]}
    level = {}
    for n in range(14):
        level[n] = max((level[b] + 1 for a, b in down if a == n), default=0)
    nodes = spark.range(14).select(F.col("id").alias("node"))
    got = G.levels(nodes, spark.createDataFrame(sorted(down), "src bigint, dst bigint"))
    assert dict(rows(got)) == level


def test_containment_of_paths_against_a_plain_model(spark):
    r = random.Random(5)
    paths = [(i, "/".join(r.choice("abc") for _ in range(r.randint(1, 4)))) for i in range(40)]
    df = spark.createDataFrame(paths, "id bigint, path string")
    want = set()
    for i, a in paths:
        for j, b in paths:
            if i != j and (a == b or a.startswith(b + "/") or b.startswith(a + "/")):
                want.add((i, j, max(a, b, key=len)))
    assert set(map(tuple, L.shared_subjects(df, df).collect())) == want


def test_recheck_equals_checking_all(spark):
    s = store(spark, SF).sources.select("path", "language", "text")
    before = s.filter(F.length("path") % 3 != 0).withColumn("text", F.when(F.length("text") % 2 == 0, F.concat("text", F.lit("\n#[allow(x)]"))).otherwise(F.col("text")))
    again = I.recheck(s, I.digests(before), R.judge(before), R.judge)
    assert rows(again.select("rule", "path", "line_no")) == rows(R.judge(s).select("rule", "path", "line_no"))
    same = I.cost(s, I.digests(s)).first()
    assert same["materialisations"] == 0 and same["sources"] == s.count()


def test_row_order_does_not_matter(spark):
    docs = store(spark, SF).docs.select("path", F.col("sha256").alias("digest"))
    one = V.snapshot_digest(docs).first()["digest"]
    assert one == V.snapshot_digest(docs.orderBy(F.rand(3)).repartition(5)).first()["digest"]
    assert one != V.snapshot_digest(docs.filter("path <> 'src1/1'").union(spark.createDataFrame([("x", "y")], "path string, digest string"))).first()["digest"]


def test_two_runs_agree_whatever_the_partitions(spark):
    names = ["gate_partition", "revision_walk", "block_diff", "claim_refusals", "text_rule_findings", "effective_policy"]
    first = {n: rows(QUERIES[n](spark, SF)) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert {n: rows(QUERIES[n](spark, SF)) for n in names} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
