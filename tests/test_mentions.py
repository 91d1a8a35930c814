"""Names in texts, against Python's own search."""

import random

import pytest

from stratalens.operators import mentions as M
from stratalens.operators.graph import settle


def case(seed):
    r = random.Random(seed)
    letters = "abcé 世"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 300))) for _ in range(60)] + ["", None, "ab" * 4000, "needle in the hay"]
    names = ["", None, "a", "世", "needle", "needle in the hay", "needle in the hay.", "ab" * 100, "ba" * 8, "aaaaaaaa"]
    for size in (1, 2, 3, 5, 6, 7, 8, 12, 15, 16, 17, 40):
        for _ in range(12):
            text = r.choice(texts) or "x"
            at = r.randrange(len(text))
            names.append(text[at : at + size] if r.random() < 0.7 else "".join(r.choice(letters) for _ in range(size)))
    return names, texts


@pytest.mark.parametrize("seed,step", [(1, None), (2, 50), (3, 7)])
def test_against_search(spark, monkeypatch, seed, step):
    if step:
        monkeypatch.setattr(M, "STEP_BYTES", step)
    names, texts = case(seed)
    n = spark.createDataFrame([(x, 1) for x in names], "name string, path int").repartition(3)
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y")], "path int, text string, name string").repartition(3)
    want = {(x, i) for x in names if x for i, t in enumerate(texts) if t and x in t}
    assert {tuple(r) for r in M.mentions(n, d, settle).collect()} == want


def test_anchors_of_a_name_are_anchors_of_its_texts():
    import numpy as np

    r = np.random.default_rng(4)
    order = r.integers(0, 5, 1 << M.ORDER_BITS).astype(np.uint16)
    text = r.integers(0, 3, 4000).astype(np.uint8)
    for least, q, w in M.CLASSES:
        whole = set(M._anchors(M._grams(text, q), w, order).tolist())
        assert len(whole) < 3 * len(set(M._grams(text, q).tolist())) / 4
        for at in range(0, 3900, 13):
            h = M._grams(text[at : at + q + w - 1], q)
            assert int(h[M._ranks(h, order).argmin()]) in whole


def test_many_names_and_empty_tables(spark):
    n = spark.range(50_000).selectExpr("concat('name number ', id) AS name")
    d = spark.createDataFrame([(i, f"here is name number {i}00 and name number {i}1") for i in range(50)], "path long, text string")
    got = {(r["name"], r["path"]) for r in M.mentions(n, d, settle).collect()}
    texts = {i: f"here is name number {i}00 and name number {i}1" for i in range(50)}
    want = {(f"name number {int(str(x)[:k])}", i) for i in texts for x in (f"{i}00", f"{i}1") for k in range(1, len(str(x)) + 1) if not (str(x)[0] == "0" and k > 1)}
    assert got == want
    assert M.mentions(n.limit(0), d, settle).count() == 0 and M.mentions(n, d.limit(0), settle).count() == 0


def test_texts_of_a_batch_are_read_together(monkeypatch):
    import types

    import numpy as np
    import pyarrow as pa

    calls, grams = [], M._grams
    monkeypatch.setattr(M, "_grams", lambda *a: calls.append(1) or grams(*a))
    full = types.SimpleNamespace(value=(np.zeros(1 << M.ORDER_BITS, np.uint16), np.full(1 << M.TABLE_BITS - 3, 255, np.uint8)))
    texts = [None, "", "ab", *(f"text {i}" for i in range(2000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["path", "text"]).slice(1)
    got = {(r["path"], r["anchor"]) for out in M._scan(full, [2, -2])([batch]) for r in out.to_pylist()}
    want = {(i, int(h)) for i, t in enumerate(texts) for h in grams(np.frombuffer((t or "").encode(), np.uint8), 2).astype(np.int64)}
    assert got == want and len(calls) < 50
