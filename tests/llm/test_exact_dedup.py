import hashlib
import re

import duckdb
import pytest

from stratalens.llm import exact_dedup
from stratalens.llm.queries import ORACLES, op11_exact_dedup


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        t = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(t, []).append((-len(text or ""), doc_id is None, doc_id, i))
    out = []
    for t, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0, m[3]))
        out += [(m[2], keep[2], len(members), m is keep, hashlib.sha256(t.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r"),
    (4, "ab"),
    (5, "a b"),
    (6, "a b"),
    (7, "Ab"),
    (8, "a  b"),
    (9, "b  a"),
    (11, "a  b"),
    (None, "x y"),
    (12, "xy "),
    (13, "\U0001f600 é"),
    (14, "\U0001f600é "),
    (15, "w " * 200_000),
    (16, "w" * 200_000),
    (17, "twice"),
    (17, "twice"),
    (None, None),
] + [(100 + i, "hot" + " " * (i % 7)) for i in range(90)] + [(1000 + i, f"alone {i}") for i in range(90)]


@pytest.mark.parametrize("options", [{}, {"filter_bits": 256}, {"bits_per_row": 1, "hashes": 1}, {"hot": 2}, {"hot": 10**6, "filter_bits": 1 << 10}])
def test_against_brute_force(spark, options):
    d = spark.createDataFrame([(*r, "x", 1, b"s") for r in ROWS], "doc_id long, text string, keep_id string, n int, sha binary").repartition(5)
    got = exact_dedup.assign(d, **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_drop_duplicates_keeps_all_columns(spark):
    d = spark.createDataFrame([(*r, i, b"s", "d") for i, r in enumerate(ROWS)], "doc_id long, text string, row int, sha binary, doc string").repartition(5)
    got = exact_dedup.drop_duplicates(d, filter_bits=1 << 9)
    assert got.columns == d.columns
    kept = sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] is not None)
    # a null id never stays beside another one here
    assert [i for i, _ in kept] == sorted({x[1] for x in brute(ROWS)})
    assert all(ROWS[r["row"]] == (r["doc_id"], r["text"]) for r in got.collect())


def test_empty_table_and_string_ids(spark):
    d = spark.createDataFrame([], "doc_id string, text string")
    assert exact_dedup.assign(d).collect() == [] and exact_dedup.drop_duplicates(d).collect() == []
    d = spark.createDataFrame([("b", "t"), ("a", " t"), ("c", "t ")], "key string, body string")
    assert {(r[0], r[1], r[3]) for r in exact_dedup.assign(d, id="key", text="body").collect()} == {("a", "a", True), ("b", "a", False), ("c", "a", False)}


def test_only_possible_repeats_are_grouped(spark):
    d = spark.createDataFrame([(i, f"t {i if i % 10 else 0}") for i in range(3000)], "doc_id long, text string")
    repeats = exact_dedup.Repeats(d, "doc_id", "text", 16, 2, 1 << 29)
    unique, again = repeats.split(repeats.rows)
    assert unique.count() + again.count() == 3000
    assert 300 <= again.count() < 300 + 2700 * 0.05


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = op11_exact_dedup(spark, sf_dir)
    want = con.execute(ORACLES["op11_exact_dedup"])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
