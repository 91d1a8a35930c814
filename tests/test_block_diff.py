"""The pairing of two versions' blocks against a plain model of the claiming loop."""

import random

from stratalens.functions import text as X
from stratalens.operators import difference as D


def model(before, after):
    taken, out, added = [False] * len(before), [], []
    norm = lambda t: " ".join(t.split())
    for to, text in after:
        for same in (lambda t: t == text, lambda t: norm(t) == norm(text)):  # noqa: B023
            i = next((i for i, (_, t) in enumerate(before) if not taken[i] and same(t)), None)
            if i is not None:
                break
        if i is None:
            added.append(to)
            continue
        taken[i] = True
        exact = before[i][1] == text
        out.append((before[i][0], to, ("same" if before[i][0] == to else "moved") if exact else "reflowed"))
    removed = [o for i, (o, _) in enumerate(before) if not taken[i]]
    out += [(o, o, "reworded") if o in removed else (None, o, "added") for o in added]
    return sorted(out + [(o, None, "removed") for o in removed if o not in added], key=str)


def test_against_the_loop(spark):
    r = random.Random(2)
    texts = ["a b", "a  b", "a b ", "c", " c", "d", "e f g", "e\tf g"]
    a, b, want = [], [], {}
    for doc in range(300):
        before = [(i + 1, r.choice(texts)) for i in range(r.randint(0, 9))]
        after = [(o, t) for o, t in before if r.random() < 0.8]
        r.shuffle(after)
        after = [(i + 1, r.choice(texts) if r.random() < 0.4 else t) for i, (_, t) in enumerate(after)] + [(20, r.choice(texts))]
        a += [(f"d{doc}", o, t) for o, t in before]
        b += [(f"d{doc}", o, t) for o, t in after]
        want[f"d{doc}"] = model(before, after)
    frame = lambda rows: spark.createDataFrame(rows, "path string, ordinal int, text string").withColumns({"content_hash": X.content_hash("text"), "normalized_hash": X.normalised_hash("text")})
    got = {}
    for x in D.block_diff(frame(a), frame(b)).collect():
        got.setdefault(x["path"], []).append((x["a_ordinal"], x["b_ordinal"], x["change"]))
    assert {d: sorted(x, key=str) for d, x in got.items()} == want
    assert D.block_diff(frame(a).limit(0), frame(b).limit(0)).count() == 0


def test_places_of_a_repeated_text_are_not_gathered(spark):
    s = spark.createDataFrame([("a", "p", 1, " x  y "), ("b", "p", 2, "x y"), ("c", None, 1, "x y"), ("d", "p", 3, "z"), ("e", "p", 4, " "), ("f", "p", 5, None)], "statement_id string, path string, ordinal long, text string")
    blocks = spark.createDataFrame([("p", 1, "x y"), ("p", 1, "x y"), ("q", 2, "x y"), ("p", 3, "x y"), (None, 1, "x y")], "path string, ordinal long, text string")
    got = D.locate_statements(s, blocks.withColumn("normalized_hash", X.normalised_hash("text")))
    assert sorted(map(tuple, got.collect())) == [("a", "held"), ("b", "moved"), ("c", "moved"), ("d", "gone"), ("e", "unlocatable"), ("f", "unlocatable")]
    plan = got._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
