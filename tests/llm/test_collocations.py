import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from stratalens.llm import collocations
from stratalens.llm.queries import ORACLES, op13_collocations


def brute(rows, min_count=30, covered=80, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3, 4):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    most = Counter()
    for (lang, ws), a in candidates.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                most[lang, ws[i : i + m]] = max(most[lang, ws[i : i + m]], a)
    out = []
    for lang in n:
        kept = []
        for (own, ws), a in candidates.items():
            if own == lang and not (most[lang, ws] and 100 * most[lang, ws] >= covered * a):
                score, k = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
                kept.append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
        kept.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(kept[:top])]
    return sorted(out)


def corpus(seed=3, n=300):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["É", "ß", "(x)", "\x00\x01", "naïve"]
    fixed = ["new york city hall", "a b a b a b", "the end of the", "x  y\tz", "Zz zz ZZ zz zz"]
    rows = []
    for i in range(n):
        words = [vocabulary[int(x) % 30] for x in r.zipf(1.6, int(r.integers(0, 60)))]
        words += fixed[int(r.integers(0, len(fixed)))].split(" ") * int(r.integers(0, 3))
        text = "".join(w + (", " if r.random() < 0.05 else "\n" if r.random() < 0.03 else " ") for w in words)
        rows.append((text, [None, "en", "de", "en"][i % 4]))
    return rows + [(None, "en"), ("", "en"), (" .,\t", "de"), ("New York! City hall", None), ("long tail of the " * 20_000, "xx"), (rows[0][0], "en")]


@pytest.mark.parametrize("options", [{}, {"min_count": 3, "block_words": 500}, {"min_count": 2, "block_words": 300, "names_broadcast": 0}, {"min_count": 5, "names_broadcast": 60, "block_words": 2000}, {"covered": 101, "top": 7}])
def test_against_brute_force(spark, options):
    rows = corpus()
    d = spark.createDataFrame([(*r, "p", 1) for r in rows], "text string, lang string, phrase string, id int").repartition(4)
    got = collocations.mine(d, **options)
    own = {k: v for k, v in options.items() if k in ("min_count", "covered", "top")}
    assert sorted(map(tuple, got.collect())) == brute(rows, **own)


def test_names_of_several_broadcasts_are_not_joined(spark, monkeypatch):
    rows = corpus(seed=5, n=100)
    d = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(collocations, "_code_words", None)
    monkeypatch.setattr(collocations, "_code_pairs", None)
    got = collocations.mine(d, min_count=3, block_words=4000, names_broadcast=200)
    assert sorted(map(tuple, got.collect())) == brute(rows, min_count=3)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    whole = collocations.C.word_hashes
    words = "a b twentyfourcharactersword1 d e a b twentyfourcharactersword2 d e"
    low = np.frombuffer(words.encode(), np.uint8)
    for mask in (0, 3):  # within a chunk, and between chunks
        monkeypatch.setattr(collocations.C, "word_hashes", lambda *a: whole(*a) & np.uint64(mask))  # noqa: B023
        chunks = [collocations._Chunk(low, np.array([0, len(low)]), np.full(1, i)) for i in (0, 1, 0)]
        row = collocations._block(1, chunks, ["en", "de"])
        langs, found = collocations._words_of(row)
        got = [(langs[int(c)].as_py(), found[int(c)].as_py()) for c in np.frombuffer(row["codes"], np.int32)]
        assert got == [(lang, w) for lang in ("en", "de", "en") for w in words.split()]
        assert len(set(zip(langs.to_pylist(), found.to_pylist()))) == len(found)


def test_large_counts_are_exact(spark):
    big = 3 * 10**18
    names = spark.createDataFrame([(7, 1, 2, big)], "id long, left long, right long, a long")
    under = spark.createDataFrame([("en", 1, i, None, None, big + i, w, w, big + i, big + i, None, None) for i, w in ((1, "x"), (2, "y"))], "lang string, level int, id long, left long, right long, a long, phrase string, last string, f_first long, f_last long, f_left long, f_right long")
    row = collocations._level(names, under, 2).first()
    assert row["cuts"]["score"] == 2_000_000 * big // (2 * big + 3) == 999_999


def test_empty_tables(spark):
    d = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine(d).collect() == []
    d = spark.createDataFrame([("a b", "en")] * 3, "text string, lang string")
    assert collocations.mine(d).collect() == []
    assert [tuple(r) for r in collocations.mine(d, min_count=2).collect()] == [("en", 1, "a b", 3, 3, 3, 6, 1_000_000)]


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = op13_collocations(spark, sf_dir)
    want = con.execute(ORACLES["op13_collocations"])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
