import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from stratalens.llm import lexical
from stratalens.llm.queries import ORACLES, op12_lexical_search

WORD = re.compile(lexical.WORD)


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = Counter(x for _, w in bags for x in set(w))
    out = []
    for item, text in items:
        scored = []
        for doc_id, ws in bags:
            tf = Counter(ws)
            if not ws:
                continue
            m = 25 + (75 * len(ws) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if t in tf)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort()
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(scored[:k])]
    return sorted(out, key=str)


def corpus(seed=5, n=400):
    r = np.random.default_rng(seed)
    topics = [[f"w{t}x{j}" for j in range(30)] for t in range(8)] + [["the", "of", "and", "in"]]
    docs = []
    for i in range(n):
        own = topics[i % 8]
        words = [own[int(x) % 30] for x in r.zipf(1.5, int(r.integers(1, 60)))] + list(r.choice(topics[8], int(r.integers(0, 20))))
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, docs[3][1]) for i in range(60)]  # ties
    docs += [(5000, None), (5001, ""), (5002, " .;"), (None, docs[3][1]), (7, docs[3][1]), (7, docs[3][1]), (5003, "The THE É é tHe" + " long" * 30_000)]
    items = [(0, docs[3][1]), (1, "the"), (2, "W1X1 w2x2 w1x1, unknown"), (3, None), (4, ""), (5, "nowhere"), (6, "é of and in w7x0"), (6, "é of and in w7x0"), (7, docs[20][1] + " long")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_rows": 10}, {"shard_rows": 25, "sample": 64}, {"shard_rows": 60, "block_bytes": 700}, {"shard_rows": 1, "k": 3}])
def test_against_brute_force(spark, options):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item string").repartition(4)
    b = spark.createDataFrame([(*x, 2, "q") for x in items], "item_id long, text string, score int, doc_id string")
    got = lexical.search(d, b, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, options.get("k", 10))


def test_bounds_stop_early(spark):
    docs, items = corpus(n=4000)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    vocabulary = sorted(set(terms(items[2][1])) | set(terms(docs[20][1])))
    index = lexical.Index(d, vocabulary, 20, 2048)
    wanted = [[(vocabulary.index(t), c) for t, c in Counter(terms(text)).items()] for text in (items[2][1], docs[20][1])]
    got = sorted((r["item"], r["rank"], r["doc_id"], r["score"]) for r in index.search(wanted, 10).collect())
    assert got == sorted(brute(docs, [(0, items[2][1]), (1, docs[20][1])]))
    assert sum(index.visited) < 2 * index.n_shards * 0.7


def test_bisection_puts_topics_together():
    r = np.random.default_rng(1)
    topic = r.permutation(np.repeat(np.arange(4), 64))
    doc = np.repeat(np.arange(256), 12)
    term = topic[doc] * 20 + r.integers(0, 20, len(doc))
    weights, thresholds = lexical.bisect(doc, term, 256, 80, 2)
    node = np.zeros(256, np.int64)
    for _ in range(2):
        sums = np.bincount(doc, weights=weights[node[doc], term], minlength=256)
        node = 2 * node + 1 + (sums.astype(np.float32) >= thresholds[node])
    purity = sum(Counter(topic[node == k]).most_common(1)[0][1] for k in set(node))
    assert purity >= 0.9 * 256


def test_equal_hashes_are_told_apart(monkeypatch):
    whole = lexical.C.word_hashes
    monkeypatch.setattr(lexical.C, "word_hashes", lambda *a: whole(*a) & np.uint64(7 << 61))
    words = [f"w{i}" for i in range(50)]
    v = lexical.Vocabulary(words[::2])
    clean = np.frombuffer("\0".join(words).encode(), np.uint8)
    s, e = lexical.C.word_bounds(clean, np.zeros(1, np.int64))
    places, ids = v.find(clean, s, e)
    assert sorted(zip(places.tolist(), ids.tolist())) == [(2 * i, i) for i in range(25)]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one, item = spark.createDataFrame([("a", "x y")], "doc_id string, text string"), spark.createDataFrame([("i", "y")], "item_id string, text string")
    assert lexical.search(d, b).collect() == [] and lexical.search(d, item).collect() == [] and lexical.search(one, b).collect() == []
    assert [(r[0], r[1], r[2]) for r in lexical.search(one, item).collect()] == [("i", 1, "a")]


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = op12_lexical_search(spark, sf_dir)
    want = con.execute(ORACLES["op12_lexical_search"])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
