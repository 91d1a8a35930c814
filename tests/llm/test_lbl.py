import math
import zlib
from collections import Counter

import numpy as np
import pytest

from stratalens.llm import lbl


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\r\x0b\x0c":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + ["</end>"]


def plain_base(rows):
    held = [d is None or zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (d, t), h in zip(rows, held):
        own = tokens(t)
        out.append((d, h, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)))
    return out


def compare(got, rows):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=str)
    want = sorted(plain_base(rows), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want])


@pytest.mark.parametrize("top", [1000, 3, 0])
def test_base_and_odd_rows(spark, top):
    rows = [(i, f"The cat {i % 7} sat on  the MAT\n{'é' * (i % 3)}") for i in range(60)]
    rows += [(100, None), (101, ""), (None, "the cat"), (102, "word " * 3000), (102, "word " * 3000), (103, "Unseen x y")]
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = lbl.lm_scores(d, top=top).collect()
    compare(got, rows)
    assert all(r["score"] < 0 for r in got)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert lbl.lm_scores(d).count() == 0
    only_held = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = lbl.lm_scores(only_held).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["base_score"] == 0


def test_probabilities_sum_to_one():
    keep, buckets = 255, 256
    words = {b"w%d" % i: 1 + i % 5 for i in range(900)} | {lbl.END: 40}
    top = sorted(words.items(), key=lambda x: (-x[1], x[0]))
    head = {lbl.END, *[w for w, _ in top if w != lbl.END][:keep]}
    masses = {}
    for w, n in words.items():
        if w not in head:
            masses[lbl.bucket(w, buckets)] = masses.get(lbl.bucket(w, buckets), 0) + n + 0.5
    voc = lbl.Vocabulary(top[:400], masses, sum(words.values()), len(words), keep, buckets)
    model = lbl.Lbl(voc)
    model.flat += np.random.default_rng(1).normal(0, 0.3, len(model.flat)).astype(np.float32)
    symbols = np.arange(voc.size)
    for u, v in ((3, 5), (voc.size, voc.size)):
        p = np.exp(model.log_p(np.full(voc.size, u), np.full(voc.size, v), symbols))
        assert abs(p.sum() - 1) < 1e-6
        total = p[: voc.head].sum()
        for w, n in words.items():
            if w not in head:
                total += p[voc.head + lbl.bucket(w, buckets)] * (n + 0.5) / 10 ** voc.log_mass[lbl.bucket(w, buckets)]
        for b in range(buckets):
            total += p[voc.head + b] * 0.5 / 10 ** voc.log_mass[b]
        assert abs(total - 1) < 1e-6


def plain_score(rows, voc, model):
    """Each text's log10 probability, token by token, from the parameters alone."""
    counts = Counter(w for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 5 != 1 for w in tokens(t))
    name = lambda w: lbl.END if w == "</end>" else w.encode()
    head = {w: i for i, w in enumerate(voc.blob.split(b" ")[: voc.head])}
    mass = Counter()
    for w, n in counts.items():
        if name(w) not in head:
            mass[zlib.crc32(name(w)[-3:]) % voc.buckets] += n + 0.5
    r, q, k, c1, c2, b, kb = (x.astype(float) for x in (model.r, model.q, model.k, model.c1, model.c2, model.b, model.kb))
    out = []
    for _, t in rows:
        u = v = voc.size
        total = 0.0
        for w in tokens(t):
            group = zlib.crc32(name(w)[-3:]) % voc.buckets
            s = head.get(name(w), voc.head + group)
            hat = r[u] @ c1 + r[v] @ c2
            c, first = s // voc.width, s // voc.width * voc.width
            kinds, own = hat @ k.T + kb, hat @ q[first : first + voc.width].T + b[first : first + voc.width]
            total += kinds[c] - np.log(np.exp(kinds).sum()) + own[s - first] - np.log(np.exp(own).sum())
            if s >= voc.head:
                total += math.log((counts[w] + 0.5) / (mass[group] + 0.5))
            u, v = s, u
        out.append(total / math.log(10))
    return out


@pytest.mark.parametrize("top", [1000, 30])
def test_score_against_brute_force(spark, top):
    rng = np.random.default_rng(2)
    words = [f"w{i}é" if i % 3 else f"V{i}" for i in range(60)]
    rows = [(i, " ".join(words[j] for j in np.minimum(rng.geometric(0.08, 30), 60) - 1)) for i in range(200)] + [(300, None), (301, "unseen words W1é"), (None, "w1é")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    table = lbl.word_counts(d.filter(~lbl.held_out()))
    counts = lbl.build_vocabulary(table, top, words=20, buckets=16)
    texts = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    _, ends, _, sym = lbl._symbol_block(counts, [t or "" for t in texts])
    model = lbl.Lbl(counts)
    model.train([(*lbl._contexts(sym, ends, counts.size), sym)] * 3, counts, seed=1)
    keyed = d.selectExpr("monotonically_increasing_id() as row", "doc_id", "text")
    got = {r["doc_id"]: r["score"] for r in lbl.score(keyed, table, counts, model).collect()}
    assert np.allclose([got[i] for i, _ in rows], plain_score(rows, counts, model), rtol=1e-6)


def test_scores_do_not_depend_on_partitions(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = []
    for n in (1, 8, 64):
        got.append({r["doc_id"]: r["score"] for r in lbl.lm_scores(d.repartition(n), per_shard=10_000).collect()})
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(math.isclose(x, got[0][i], rel_tol=1e-9) for i, x in other.items())


def test_ids_keep_their_type_and_long_texts(spark):
    rows = [("a", "x y z"), ("b", "x " * 100_000), (None, "z")]
    got = {r["doc_id"]: r["n_tokens"] for r in lbl.lm_scores(spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id string, text string, row int, shard string")).collect()}
    assert got == {"a": 4, "b": 100_001, None: 2}


def test_query_beats_unigrams_on_held_out(spark):
    from stratalens.llm.queries import op8_lm_scores

    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op8_lm_scores(spark, sf).collect()
    compare(got, rows)
    n = sum(r["n_tokens"] for r in got if r["held_out"])
    base = sum(r["base_score"] for r in got if r["held_out"]) / n
    own = sum(r["score"] for r in got if r["held_out"]) / n
    print("log10 a token, held out:", base, own)
    assert own > base + 0.15


def test_log_sums_of_rows_far_and_near():
    import time

    r = np.random.default_rng(1)
    s = r.normal(0, 3, (200, 90))
    s[50] += 200
    s[51] -= 200
    s[52, 3] = 500
    top = s.max(axis=1)
    want = np.log(np.exp(s - top[:, None]).sum(axis=1)) + top
    assert np.allclose(lbl._log_sum(s), want, rtol=1e-6, atol=2e-6)
    assert lbl._log_sum(s[:10]).tolist() == lbl._log_sum(s)[:10].tolist()  # a row alone, or beside far ones
    near = r.normal(0, 1, (1024, 102))
    shifted = lambda x: np.log(np.exp((x - x.max(axis=1)[:, None]).astype(np.float32)).sum(axis=1, dtype=np.float64)) + x.max(axis=1)

    def best(f):
        times = []
        for _ in range(30):
            start = time.perf_counter()
            f(near)
            times.append(time.perf_counter() - start)
        return min(times)

    assert best(lbl._log_sum) < 0.8 * best(shifted)
