import hashlib
import re

import pytest

from stratalens.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench, n=10):
    windows = {}
    for i, t in bench:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).update(() if i is None else [str(i)])
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, items = set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    items |= ids
        out.append((d, len(w), len(hit), sorted(items)))
    return out


def key(x):
    return (str(x[0]), x[1:])


PASSAGE = "The quick brown fox jumps over the lazy dog near Ünïcode river banks today"
DOCS = [
    (1, "start " + PASSAGE + " end"),
    (2, PASSAGE.upper().replace("ÜNÏCODE", "Ünïcode").replace(" ", " -- ")),
    (3, None),
    (4, ""),
    (5, "nothing here"),
    (5, "nothing here"),
    (None, "x short item y short item"),
    (7, "The quick brown fox jumps over the lazy"),
    (8, "dog near " * 2000 + PASSAGE),
    (9, "!!! ... \n\t"),
]
BENCH = [(0, PASSAGE), (10, PASSAGE + " more"), (2, "short item"), (3, None), (4, "?!"), (None, "nothing here"), (2, "short item")]


@pytest.mark.parametrize("max_words", [10**6, 0])
@pytest.mark.parametrize("docs,bench", [(DOCS, BENCH), ([], BENCH), (DOCS, [])])
def test_against_brute_force(spark, docs, bench, max_words):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    if not bench and max_words == 0:
        max_words = -1
    got = dc.decontaminate(d, b, max_words=max_words)
    got = [(r["doc_id"], r["dc_n_words"], r["dc_n_hit"], r["dc_items"]) for r in got.collect()]
    want = brute(docs, bench)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_removal_and_clashing_names(spark):
    d = spark.createDataFrame([(*x, 1) for x in DOCS], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    left = dc.remove_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [3, 4, 7, 9]
    spans = {r["doc_id"]: r["text"] for r in dc.remove_contaminated(d, b, mode="spans").collect()}
    assert spans[1] == "start  end" and spans[3] is None and len(spans) == len({x[0] for x in DOCS})
    via_join = dc.decontaminate(d, b, with_clean_text=True, max_words=0)
    assert {r["doc_id"]: r["dc_clean_text"] for r in via_join.collect()}[1] == "start  end"


def test_neighbouring_short_items_are_no_long_window(spark):
    item = "alpha beta gamma delta epsilon zeta"
    d = spark.createDataFrame([(1, "x " * 40 + item + " " + item), (2, item + " " + item)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in dc.remove_contaminated(d, b).collect()] == [1]
    for most in (10**6, 0):
        got = {r["doc_id"]: (r["dc_n_hit"], r["dc_longest"], [list(x) for x in r["dc_spans"]]) for r in dc.decontaminate(d, b, max_words=most).collect()}
        assert got == {1: (12, 6, [[40, 51]]), 2: (12, 6, [[0, 11]])}


def test_internal_names_as_input_columns(spark):
    names = ["_row", "doc", "at", "n", "phrase", "item", "marked", "spans", "n_words", "longest", "clean_text", "_dc_spans"]
    d = spark.createDataFrame([(1, PASSAGE, *names), (2, "clean", *names)], ["doc_id", "text", *names])
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    for mode, ids in (("documents", [2]), ("spans", [1, 2])):
        left = dc.remove_contaminated(d, b, mode=mode)
        assert left.columns == d.columns
        assert sorted((r["doc_id"], *r[2:]) for r in left.collect()) == [(i, *names) for i in ids]
    for most in (10**6, 0):
        got = dc.decontaminate(d, b, max_words=most)
        assert [c for c in got.columns if not c.startswith("dc_")] == [c for c in d.columns if c != "text"]
        assert sorted(tuple(r[c] for c in names) for r in got.collect()) == [tuple(names)] * 2


def test_query_on_table(spark, sf_dir):
    from stratalens.llm.queries import op1_decontamination

    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # brute force by positions of each text's own windows
    windows = {}
    for i, t in bench:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(" ".join(w[k : k + 10]), set()).add(str(i))
    want = {}
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, items = set(), set()
        for k in range(len(w)):
            ids = windows.get(" ".join(w[k : k + 10])) if k + 10 <= len(w) else None
            if ids:
                hit |= set(range(k, k + 10))
                items |= ids
        want[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    got = {r["doc_id"]: tuple(r)[1:] for r in op1_decontamination(spark, sf_dir).collect()}
    assert got == want and any(x[4] for x in want.values())
