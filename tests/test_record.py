"""A kept run: what is judged, what is withdrawn, and what stays, over several runs."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import rules as R
from stratalens.operators.incremental import Record
from stratalens.streaming import generations as St

SCHEMA = "path string, language string, text string, mtime long, gone boolean"
RULES = [r for r in R.TEXT_RULES if r.id == "no-trailing-whitespace"]


@pytest.fixture
def judge():
    """Judges by one rule, and counts what it is given."""
    seen = []

    def run(sources):
        seen.extend(r["path"] for r in sources.select("path").collect())
        return R.judge(sources, RULES)

    run.seen = seen
    return run


def tree(spark, rows):
    return spark.createDataFrame([(*r, None, None)[:5] for r in rows], SCHEMA)


def found(df):
    return sorted((r["path"], r["line_no"]) for r in df.collect())


@pytest.mark.parametrize("stamp", [None, "mtime"])
def test_runs(spark, tmp_path, judge, stamp):
    record = Record(spark, f"file://{tmp_path}/record", buckets=4)
    first = [(f"f{i}", "rust", "x \ny", 1) for i in range(20)] + [("null", "rust", None, 1), ("plain", "rust", "x", 1)]
    assert record.update(tree(spark, first), judge, 0, whole=True, stamp=stamp) == {"judged": 22, "withdrawn": 0}
    assert found(record.findings()) == sorted((f"f{i}", 1) for i in range(20))
    judge.seen.clear()
    # unchanged: nothing is judged or written
    assert record.update(tree(spark, first), judge, 1, whole=True, stamp=stamp) == {"judged": 0, "withdrawn": 0}
    assert judge.seen == [] and not (tmp_path / "record" / "batch=1").exists()
    # one edit, one deletion, one new source
    second = [("f0", "rust", "x\ny \nz ", 2)] + first[2:] + [("new", "rust", " \t", 1)]
    assert record.update(tree(spark, second), judge, 2, whole=True, stamp=stamp) == {"judged": 2, "withdrawn": 1}
    assert sorted(judge.seen) == ["f0", "new"]
    want = sorted([("f0", 2), ("f0", 3), ("new", 1)] + [(f"f{i}", 1) for i in range(2, 20)])
    assert found(record.findings()) == want
    got = sorted((r["change"], r["path"], r["line_no"]) for r in record.changes(2).collect())
    assert got == [("added", "f0", 2), ("added", "f0", 3), ("added", "new", 1), ("withdrawn", "f0", 1), ("withdrawn", "f1", 1)]
    # the same run again replaces itself; older states stay readable
    assert record.update(tree(spark, second), judge, 2, whole=True, stamp=stamp) == {"judged": 2, "withdrawn": 1}
    assert found(record.findings()) == want and len(found(record.findings(2))) == 20
    # a source that comes back as it was is judged again, for its row says that it is gone
    assert record.update(tree(spark, [first[1]]), judge, 3, stamp=stamp) == {"judged": 1, "withdrawn": 0}
    record.compact(3)
    assert found(record.findings()) == sorted([*want, ("f1", 1)])
    assert record.update(tree(spark, []), judge, 4, whole=True, stamp=stamp) == {"judged": 0, "withdrawn": 23}
    assert found(record.findings()) == []


def test_a_run_over_some_sources_leaves_the_others(spark, tmp_path, judge):
    record = Record(spark, f"file://{tmp_path}/record", buckets=4)
    assert found(record.findings()) == []
    record.update(tree(spark, [("a", "rust", "x ", None), ("b", "rust", "y ", None)]), judge, 0)
    rows = [("a", "rust", None, None, True), ("unknown", "rust", None, None, True), ("c", "rust", "z ", None), ("c", "rust", "a ", None)]
    assert record.update(tree(spark, rows), judge, 1, deleted="gone") == {"judged": 1, "withdrawn": 1}
    assert found(record.findings()) == [("b", 1), ("c", 1)]


def test_a_changed_stamp_alone_is_kept_without_judging(spark, tmp_path, judge):
    record = Record(spark, f"file://{tmp_path}/record")
    record.update(tree(spark, [("a", "rust", "x ", 1)]), judge, 0, stamp="mtime")
    judge.seen.clear()
    assert record.update(tree(spark, [("a", "rust", "x ", 2)]), judge, 1, stamp="mtime") == {"judged": 0, "withdrawn": 0}
    assert judge.seen == [] and record.rows().first()["stamp"] == "2" and found(record.findings()) == [("a", 1)]


def test_stream(spark, tmp_path, judge):
    source, root = str(tmp_path / "in"), f"file://{tmp_path}/record"
    batches = [[("a", "rust", "x "), ("b", "rust", "y ")], [("a", "rust", "x ")], [("b", "rust", "y"), ("a", "rust", None, None, True)]]
    judged = []
    for rows in batches:
        tree(spark, rows).coalesce(1).write.mode("append").parquet(source)
        judge.seen.clear()
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        St.resident_judge(stream, judge, root, str(tmp_path / "cp"), deleted="gone").awaitTermination(120)
        judged.append(sorted(judge.seen))
    assert judged == [["a", "b"], [], ["b"]]
    record = Record(spark, root)
    assert found(record.findings()) == [] and found(record.findings(2)) == [("a", 1), ("b", 1)]
    assert record.rows().filter(F.col("digest").isNotNull()).count() == 1


def test_texts_are_shuffled_once_a_run(spark, tmp_path):
    plans = []

    def judge(sources):
        plans.append(sources._jdf.queryExecution().optimizedPlan().toString())
        return R.judge(sources, RULES)

    record = Record(spark, f"file://{tmp_path}/record", buckets=4)
    assert record.update(tree(spark, [("a", "rust", "x ", 1), ("a", "rust", "y", 1)]), judge, 0, whole=True) == {"judged": 1, "withdrawn": 0}
    assert found(record.findings()) == []
    assert "Aggregate" not in plans[0] and "Join" not in plans[0]
