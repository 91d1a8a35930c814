import random

import numpy as np
import xxhash

from stratalens.llm import simhash


def plain_fingerprint(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    grams = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(rows, k=4):
    """rows: (id, fp); the smallest id reachable, by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    comp = {f: f for f in fps}

    def root(f):
        while comp[f] != f:
            f = comp[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= k:
                comp[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {(d, f): least.get(root(f)) for d, f in rows}


def texts(n=60, seed=5):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnop") * r.randint(1, 4) for _ in range(300)] for _ in range(6)]
    out = [(100, None), (101, ""), (102, " \n\t"), (3, "one"), (4, "One"), (None, "one"), (5, "a b c"), (6, "a b c d")]
    for i in range(n):
        w = list(base[i % 6])
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = "zz"
        out.append((1000 - i, " ".join(w) if i % 2 else " " + "\x0b".join(w)))
    return out + [out[-1], (7, "x " * 30000)]


def test_fingerprints_and_components(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket_rows in (20_000, 8):
        got = simhash.near_duplicates(df, bucket_rows=bucket_rows).collect()
        mask = 2**64 - 1
        want = [(d, plain_fingerprint(t)) for d, t in rows]
        comp = plain_components(want)
        assert sorted((str(r["id"]), r["fp"] & mask, r["component_id"]) for r in got) == sorted((str(d), f, comp[d, f]) for d, f in want)


def test_forest_finds_every_link():
    r = np.random.default_rng(1)
    seeds = r.integers(0, 2**63, 40, dtype=np.uint64)
    codes = [int(s) for s in seeds]
    for s in seeds:
        for _ in range(12):
            x = int(s)
            for b in r.choice(64, r.integers(1, 8), replace=False):
                x ^= 1 << int(b)
            codes.append(x)
    codes = np.unique(np.array(codes, np.uint64))
    src, dst = simhash.forest(codes, 4)
    parent = {int(c): int(c) for c in codes}
    for a, b in zip(src.tolist(), dst.tolist()):
        parent[a] = b
    want = plain_components([(int(c), int(c)) for c in codes])
    mine = {}
    for c in parent:
        mine.setdefault(parent[c], set()).add(c)
    theirs = {}
    for (c, _), root in want.items():
        theirs.setdefault(root, set()).add(c)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_random_codes_and_levels(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**62, 30, dtype=np.int64)
    codes = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 62, (12, 2))}
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    want = plain_components([(c, c) for c in codes])
    for rows in (10_000, 24):
        member = {x["node"]: x["root"] for x in simhash.components(simhash.similar_edges(df, 4, rows)).collect()}
        got, expected = {}, {}
        for c in codes:
            got.setdefault(member.get(c, c), set()).add(c)
            expected.setdefault(want[c, c], set()).add(c)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_empty_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, _x int")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns
    df = spark.createDataFrame([(2, "a b c d e", 1), (1, "A b c d e", 2), (1, "A b c d e", 2), (9, "other words stand here", 0), (None, None, 3), (None, "", 4)], "doc_id long, text string, fp int")
    assert sorted((str(r["doc_id"]), r["fp"]) for r in simhash.keep_one(df).select("doc_id", "fp").collect())[:2] == [("1", 2), ("9", 0)]
    assert simhash.keep_one(df).count() == 3


def test_dense_bucket_is_quick():
    import time

    rng = np.random.default_rng(3)
    codes = set()
    while len(codes) < 20_000:
        x = 0x123456789ABCDEF
        for b in rng.integers(0, 64, 4):
            x ^= 1 << int(b)
        codes.add(x)
    start = time.perf_counter()
    src, dst = simhash.forest(np.array(sorted(codes), np.uint64), 4)
    assert len(src) == len(codes) - 1 and time.perf_counter() - start < 10


def test_internal_names_as_input_columns(spark):
    names = ["_row", "row", "doc", "fp", "first", "id", "root", "node", "n"]
    d = spark.createDataFrame([(1, "a b c d e", *names), (2, "a b c d e", *names), (3, "something else is here", *names)], ["doc_id", "text", *names])
    left = simhash.keep_one(d)
    assert left.columns == d.columns and sorted((r["doc_id"], *r[2:]) for r in left.collect()) == [(i, *names) for i in (1, 3)]


def plain_groups(texts, size=5, similarity=0.8):
    """Smallest place of each text's group, by all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    of = {}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        first = of.setdefault(frozenset(s), i)
        if first != i:
            parent[root(i)] = root(first)
            continue
        for j in set(of.values()) - {i}:
            both = len(s & sets[j])
            if s and both >= similarity * (len(s) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def similar_texts():
    """Groups of near copies of several sizes and edits, texts made of one common passage, and odd ones."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    out = []
    for group in range(12):
        base = [word() for _ in range(r.choice([6, 40, 120]))]
        for _ in range([2, 3, 60][group % 3]):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    passage = " ".join(word() for _ in range(60))
    out += [f"{' '.join(word() for _ in range(n))} {passage}" for n in range(2, 40)]
    return out + [None, "", "  ", "one", "One", "one two", "x " * 20_000, "x " * 20_000]


def test_keep_one_against_all_pairs(spark):
    texts = similar_texts()
    want = {i for i, root in enumerate(plain_groups(texts)) if i == root}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for hot in (1000, 8):
        got = {r["doc_id"] for r in simhash.keep_one(d, hot_posting=hot).collect()}
        assert got == want


def test_reordered_copies_among_texts_of_shared_passages(spark):
    # every shingle but those over the passages' seams stands in a quarter of the texts
    rng = np.random.default_rng(7)
    passages = [" ".join(f"p{i}w{int(x)}" for x in rng.integers(0, 5000, 60)) for i in range(40)]
    picks = [rng.permutation(40)[:10] for _ in range(400)]
    texts = [" ".join(passages[j] for j in p) for p in picks] + [" ".join(passages[j] for j in rng.permutation(p)) for p in picks[:60]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.keep_one(d).collect()} == set(range(400))


def test_components_by_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (400, 2))]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    want = [sorted(map(tuple, simhash.components(edges, few).collect())) for few in (0, 10_000)]
    assert want[0] == want[1] and want[0]
    assert simhash.components(edges.limit(0)).count() == 0


def test_shingles_of_many_texts_are_those_of_each():
    texts = ["", " \t", "One", "one  TWO\nthree", "a b c d e", "a b c d e f a b c d e", "\0 b\0c ä\xa0ö d e f", "x " * 3000]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h, bounds = simhash._shingles(np.frombuffer(b"".join(raw), np.uint8), offsets, 5)
    seen = {}
    for i, t in enumerate(raw):
        words = t.lower().split()
        want = [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
        own = h[bounds[i] : bounds[i + 1]].tolist()
        assert len(own) == len(want)
        assert all(seen.setdefault(w, x) == x for w, x in zip(want, own))
        assert simhash._majorities(h, bounds)[i] == simhash.majority(h[bounds[i] : bounds[i + 1]])
    assert len(set(seen.values())) == len(seen)


def test_folded_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 31, 32, 33, 63, 64, 1000, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 10], rng.integers(0, 2**63, n // 5).astype(np.uint64)]))
        p, q = sorted((simhash._parity(a), simhash._parity(b)), key=len)
        while len(q) > len(p):
            q = q[: len(q) // 2] ^ q[len(q) // 2 :]
        assert int(np.bitwise_count((p ^ q).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_no_link_in_crowded_postings_hangs_on_bands(spark, monkeypatch):
    # bands in which no two texts meet: what pivots leave is compared pair by pair
    def alone(size):
        import pyarrow as pa

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(0)], names=["same", "h"])

        return run

    monkeypatch.setattr(simhash, "_bands", alone)
    monkeypatch.setattr(simhash, "CROWD_BLOCK", 40)  # several blocks a posting
    rng = np.random.default_rng(7)
    passages = [" ".join(f"p{i}w{int(x)}" for x in rng.integers(0, 5000, 60)) for i in range(40)]
    picks = [rng.permutation(40)[: 9 + k % 3] for k in range(400)]
    texts = [" ".join(passages[j] for j in p) for p in picks] + [" ".join(passages[j] for j in rng.permutation(p)) for p in picks[:60]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.keep_one(d).collect()} == set(range(400))


def test_crowded_postings_take_few_rounds(spark, monkeypatch):
    # chains of edits: members of one posting are linked to their neighbours only, so each pivot links few
    rounds, verified = [], simhash._verified

    def counted(*args):
        rounds.append(1)
        return verified(*args)

    monkeypatch.setattr(simhash, "_verified", counted)
    rng = np.random.default_rng(11)
    words = [f"w{int(x)}" for x in rng.integers(0, 10**6, 200)]
    texts = []
    for i in range(240):
        words[int(rng.integers(40, 200))] = f"e{i}"
        if i % 3 == 0:
            texts.append(" ".join(words))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in simhash.keep_one(d).collect()}
    assert got == {i for i, root in enumerate(plain_groups(texts)) if i == root}
    assert len(rounds) <= 4


def test_postings_give_pairs_that_sizes_and_places_allow():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted({(int(h), int(n), int(n * p), i) for i, (h, n, p) in enumerate(zip(rng.integers(-40, 40, 900), rng.integers(5, 60, 900), rng.random(900) * 0.2))})
    rows += [(99, 20, 0, 5000 + i) for i in range(50)]  # a large posting over several batches
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 33])], names=["h", "n", "q", "same"]) for lo in range(0, len(rows), 33)]
    got = [r for b in simhash._met(0.8, 32)(iter(batches)) for r in b.to_pylist()]
    want = set()
    for h, n, q, a in rows[:-50]:
        for g, m, p, b in rows[:-50]:
            if h == g and a < b and min(n, m) >= 0.8 * max(n, m) and min(n - q, m - p) >= 0.8 / 1.8 * (n + m) - 1e-6:
                want.add((a, b))
    assert {(r["same"], r["other"]) for r in got if r["other"] is not None} == want and want
    assert [r["same"] for r in got if r["other"] is None] == [5000 + i for i in range(50)]
