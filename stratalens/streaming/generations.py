"""Fact and change streams: every micro-batch is one generation.

Structured Streaming gives exactly-once batches by their number; a batch that is run again
after a failure replaces its own generation's files, so results do not double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import facts as V
from ..operators.incremental import Record


def ingest(stream: DataFrame, table: str, checkpoint: str, keys: list[str], *, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream of facts (keys..., generation, ...) to Parquet at ``table``.

    Versions older than what the table knows of their key are refused: they go to
    ``table``_refused with the batch that brought them.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates([*keys, "generation"])
        known = _read(spark, table, batch, number)
        late = V.backdated(known, batch, keys)
        fresh = batch.join(late.select(*keys, "generation"), [*keys, "generation"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")
        late.write.mode("overwrite").parquet(f"{table}_refused/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _read(spark, table: str, like: DataFrame, number: int) -> DataFrame:
    """The table without the batch that is being written, empty if there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return like.limit(0)
    got = spark.read.schema(T.StructType([*like.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(table)
    return got.filter(F.col("batch") != number).drop("batch")


def apply_change_sets(stream: DataFrame, snapshots: str, checkpoint: str) -> StreamingQuery:
    """Applies change sets (path, digest) batch by batch; each writes its generation's snapshot."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        previous = [g for g in _generations(spark, snapshots) if g < number]
        current = spark.read.schema("path string, digest string").parquet(f"{snapshots}/generation={max(previous)}") if previous else batch.select("path", "digest").limit(0)
        effects = V.apply_changes(current, V.require_changes(batch))
        effects.filter("digest is not null").select("path", "digest").write.mode("overwrite").parquet(f"{snapshots}/generation={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _generations(spark, root: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))


def judge_stream(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Judges every batch of sources and writes its findings and how many sources it read."""

    def one(batch: DataFrame, number: int) -> None:
        found = judge(batch)
        found.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        batch.agg(F.count("*").alias("sources")).write.mode("overwrite").parquet(f"{sink}_cost/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resident_judge(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, *, stamp: str | None = None, deleted: str | None = None) -> StreamingQuery:
    """Keeps the findings of a tree current under a stream of its sources (path, language, text).

    Each batch is a run of the ``Record`` at ``root``: sources whose content is known are not judged
    again, edited ones are judged alone, deleted ones lose their findings. A batch that is run
    again after a failure sees only the runs before it and replaces its own.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            Record(batch.sparkSession, root).update(batch, judge, number, stamp=stamp, deleted=deleted)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
