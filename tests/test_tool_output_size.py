"""A run over many files is read in linear time."""

import time

from pyspark.sql import functions as F

from stratalens.sources import tool_output as O


def run_of(spark, files, unchecked=0):
    """A run of one module: each file is checked, but for the last ones, and has a value."""
    i = F.col("id")
    name = F.concat(F.lit('"file":"/r/'), i.cast("string"), F.lit('.go"'))
    checked = F.when(i < files - unchecked, F.concat(F.lit('{"kind":"checked",'), name, F.lit("}")))
    value = F.concat(F.lit('{"kind":"value",'), name, F.lit(',"line":1,"column":2,"is_error":true,"type":"error"}'))
    lines = spark.range(files).select(F.concat_ws("\n", checked, value).alias("line"))
    said = lines.agg(F.array_join(F.collect_list("line"), "\n").alias("stdout"))
    return said.select(F.lit("m").alias("module"), F.lit("/r").alias("root"), F.lit("exited").alias("outcome"), F.lit(0).alias("code"), "stdout", F.lit("").alias("stderr"))


def test_go_types_over_many_files(spark):
    start = time.perf_counter()
    found, files, failures = O.go_types(run_of(spark, 20_000))
    assert (found.count(), files.count(), failures.count()) == (20_000, 20_000, 0)
    assert time.perf_counter() - start < 60


def test_go_types_with_one_value_in_a_file_that_is_not_checked(spark):
    found, files, failures = O.go_types(run_of(spark, 2_000, unchecked=1))
    assert (found.count(), files.count()) == (0, 0)
    assert [tuple(r) for r in failures.collect()] == [("m", "unreadable")]
