import math

import numpy as np
import pytest

from stratalens.llm import ann


def brute(rows, queries, k=5):
    """Exact nearest by cosine; rows and queries: (id, vector)."""
    dim = 8 if rows and rows[0][1] is not None and len(rows[0][1]) == 8 else max((len(v) for _, v in rows if v is not None), default=0)
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, unit = np.array([i for i, _ in ok]), np.array([v / np.linalg.norm(v) for _, v in ok])
    out = {}
    for q, v in ok:
        if q not in queries:
            continue
        s = unit @ (v / np.linalg.norm(v))
        best = {}
        for i, x in zip(ids.tolist(), s.tolist()):
            if i != q:
                best[i] = max(x, best.get(i, -2))
        out[q] = sorted(best.items(), key=lambda t: (-round(t[1], 12), t[0]))[:k]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    n = sum(len(w) for w in want.values())
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / n


def test_chi_square():
    assert abs(ann.chi2_cdf(21.026, 12) - 0.95) < 1e-4 and abs(ann.chi2_cdf(3.841, 1) - 0.95) < 1e-3
    assert abs(ann.chi2_quantile(0.95, 6) - 12.592) < 1e-2 and ann.chi2_cdf(0, 3) == 0


def test_leaves_and_cells():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(5000, 4)), np.zeros((3000, 4))])
    leaves = ann.KdTree(x).leaves()
    assert sorted(i for rows, _, _ in leaves for i in rows.tolist()) == list(range(8000))
    assert all((x[rows] >= low).all() and (x[rows] <= high).all() for rows, low, high in leaves)
    cells = ann.Cells(x[::7], 32)
    at = cells.of(x)
    assert len(cells.low) > 8 and (x >= cells.low[at]).all() and (x <= cells.high[at]).all()
    assert (ann.box_distances(x[:50], cells.low, cells.high)[np.arange(50), at[:50]] == 0).all()
    assert list(ann._runs([(0, 5), (2, 4), (3, 30), (9, 1)], 10)) == [(0, 2, 1), (3, 3, 3), (9, 9, 1)]


def test_clustered_table(spark):
    """A made table of 40,000 rows in 400 clusters: recall, and how many cells are left out."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(400, 32))
    x = centres[r.integers(0, 400, 40_000)] + 0.15 * r.normal(size=(40_000, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    rows = list(enumerate(x.tolist()))
    want = brute(rows, set(range(0, 40_000, 50)))
    got = collected(ann.nearest(df, df.filter("vec_id % 50 = 0"), block=100, tree_rows=5_000, sample_rows=4_000))
    assert recall(got, want) >= 0.95


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_recall(spark, sf):
    from stratalens.llm.queries import op10_nearest

    d = f"/root/testdata/{sf}"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, {i for i, _ in rows if i % 50 == 0})
    got = collected(op10_nearest(spark, d))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.95
    exact = dict(rows)
    for q, found in got.items():
        for i, s in found:
            a, b = np.array(exact[q], float), np.array(exact[i], float)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


@pytest.mark.parametrize("block,tree_rows", [(20_000, 50_000), (2, 37)])
def test_odd_rows(spark, block, tree_rows):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(400)] + [(7, rows[7][1])] * 3
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [1.0, None] + [0.0] * 6), (2150, [float("nan")] * 8), (2200, [float("inf")] + [0.0] * 7), (2250, [1.0]), (2300, []), (None, hot), (2350, [1e300] * 8), (2400, [1e-300] * 8)]
    queries = {i for i, _ in rows if i is not None and i % 50 == 0}
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<double>, rank int").repartition(5)
    got = collected(ann.nearest(df, df.filter("vec_id % 50 = 0"), block=block, tree_rows=tree_rows, certainty=0.9999))
    scaled = [(i, None if v is None else [x / 1e300 if x == 1e300 else x * 1e300 if x == 1e-300 else x for x in v] if None not in v else v) for i, v in rows]
    want = brute(scaled, queries)
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = collected(ann.nearest(df, df.filter("vec_id % 50 = 0")))
    assert [i for i, _ in got[0]] == [50, 1] and [i for i, _ in got[50]] == [0, 1]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_lengths_and_text_ids(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [1.0, 0.0, 0.0]), ("d", [1.0, 0.5, 0.0]), ("e", [0.0, 1.0]), ("long", [1.0] * 20_000)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = collected(ann.nearest(df, df))
    assert {q: [i for i, _ in f] for q, f in got.items()} == {"a": ["b", "e"], "b": ["a", "e"], "e": ["b", "a"], "c": ["d"], "d": ["c"]}
