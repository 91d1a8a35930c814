"""Re-judging a source tree: only what changed is judged, the rest is reused.

The record of a run is two tables: (path, digest) of every source, and its findings. Digests
are content hashes, so a source that moved away and back costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from .graph import settle


def digests(sources: DataFrame) -> DataFrame:
    return sources.select("path", X.content_hash(F.concat_ws("\x1f", "language", "text")).alias("digest"))


def stale(sources: DataFrame, recorded: DataFrame) -> DataFrame:
    """Sources that are new or whose content differs from the record."""
    now = sources.withColumn("digest", X.content_hash(F.concat_ws("\x1f", "language", "text")))
    return now.join(recorded.select("path", "digest"), ["path", "digest"], "left_anti").drop("digest")


def recheck(sources: DataFrame, recorded: DataFrame, findings: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings of the tree as it is: recorded ones of unchanged sources, fresh ones of others."""
    unchanged = digests(sources).join(recorded.select("path", "digest"), ["path", "digest"], "left_semi").select("path")
    return findings.join(unchanged, "path", "left_semi").unionByName(judge(stale(sources, recorded)))


def cost(sources: DataFrame, recorded: DataFrame) -> DataFrame:
    """How many sources a recheck reads and how many it judges anew."""
    total = sources.agg(F.count("*").alias("sources"))
    return total.crossJoin(stale(sources, recorded).agg(F.count("*").alias("materialisations")))


class Record:
    """A kept run over a source tree: what was judged, and what was found, of every source.

    The record is a table of (path, digest, stamp, findings), to which each run adds the rows of the
    sources that changed, under its number; a path's last row counts, and one without a digest says
    that the source is gone. Rows lie in ``buckets`` of the path, so a run over a few sources reads
    their buckets only. A run that finds nothing changed judges nothing and writes nothing. A run
    that is done again under its number replaces what it wrote, so results do not double.

    ``stamp`` names a column that differs whenever the content does, such as a file's length and
    time of change: sources with the stamp of the record are then not hashed, and only changed ones
    are read. Without it every given text is hashed, and only changed ones are judged.

    Defined cases: null texts are judged as they are, with a digest of their own; of several rows
    of a path in one run the one with the largest text counts; withdrawing an unknown path does
    nothing; an empty tree given as whole withdraws all.
    """

    FINDING = "struct<rule:string,line_no:bigint>"

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _schema(self) -> str:
        return f"path string, digest string, stamp string, findings array<{self.FINDING}>, batch long, bucket int"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _folders(self) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def rows(self, before: int | None = None) -> DataFrame:
        """The last row of each path, among runs before a number."""
        if not any(n.startswith("batch=") for n in self._folders()):
            return self.spark.createDataFrame([], self._schema()).drop("batch")
        found = self.spark.read.schema(self._schema()).option("basePath", self.root).parquet(self.root)
        if before is not None:
            found = found.filter(F.col("batch") < before)
        last = F.max_by(F.struct("digest", "stamp", "findings"), "batch").alias("r")
        return found.groupBy("bucket", "path").agg(last).select("path", "r.digest", "r.stamp", "r.findings", "bucket")

    def findings(self, before: int | None = None) -> DataFrame:
        """(rule, path, line_no) of the tree as it is."""
        return self.rows(before).filter("digest is not null").select("path", F.explode("findings").alias("f")).select("f.rule", "path", "f.line_no")

    def update(self, sources: DataFrame, judge: Callable[[DataFrame], DataFrame], batch: int, *, whole: bool = False, stamp: str | None = None, deleted: str | None = None) -> dict[str, int]:
        """Judges what changed among ``sources`` (path, language, text) and keeps it as run ``batch``.

        ``whole`` says that sources not given are gone; rows whose column ``deleted`` is true say so
        themselves. Returns how many sources were judged and withdrawn.
        """
        given = sources.withColumn("stamp", F.col(stamp).cast("string") if stamp else F.lit(None).cast("string")).withColumn("gone", F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False))
        known = self.rows(batch).filter("digest is not null")
        if not whole:
            own = [r[0] for r in given.select(self._bucket().alias("b")).distinct().collect()]
            known = known.filter(F.col("bucket").isin(own))
        there = given.filter(~F.col("gone"))
        if stamp:
            there = there.join(known.select("path", "stamp"), ["path", "stamp"], "left_anti")
        there = there.withColumn("digest", X.content_hash(F.concat_ws("\x1f", "language", F.coalesce("text", F.lit("\x00")))))
        one = there.groupBy("path").agg(F.max(F.struct("text", "language", "digest", "stamp")).alias("s")).select("path", "s.*")
        seen = known.select("path", F.col("digest").alias("was"), F.col("findings").alias("had"))
        met = one.join(seen, "path", "left")
        # written once: the count, the judging and the record would each shuffle and hash all texts again
        changed = settle(met.filter("was is null or was <> digest").select("path", "language", "text", "digest", "stamp"))
        gone = known.select("path").join(given.filter("gone").select("path").distinct(), "path", "left_semi")
        if whole:
            gone = known.select("path").join(given.filter(~F.col("gone")).select("path").distinct(), "path", "left_anti")
        counts = changed.select(F.lit("judged").alias("k")).unionAll(gone.select(F.lit("withdrawn"))).groupBy("k").count().collect()
        n = {"judged": 0, "withdrawn": 0} | {r["k"]: r["count"] for r in counts}
        parts = []
        if n["judged"]:
            found = judge(changed.select("path", "language", "text")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rule", "line_no").cast(self.FINDING))).alias("findings"))
            fresh = changed.select("path", "digest", "stamp").join(found, "path", "left")
            parts.append(fresh.withColumn("findings", F.coalesce("findings", F.array().cast(f"array<{self.FINDING}>"))))
        if stamp:
            parts.append(met.filter("was = digest").select("path", "digest", "stamp", F.col("had").alias("findings")))
        if n["withdrawn"]:
            parts.append(gone.select("path", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("stamp"), F.array().cast(f"array<{self.FINDING}>").alias("findings")))
        if n["judged"] or n["withdrawn"] or (stamp and not met.filter("was = digest").isEmpty()):
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/batch={batch}")
        return n

    def changes(self, batch: int) -> DataFrame:
        """(change, rule, path, line_no): what run ``batch`` added to and withdrew from the findings."""
        touched = self.spark.read.schema(self._schema()).option("basePath", self.root).parquet(self.root).filter(F.col("batch") == batch).select("path")
        after = self.findings(batch + 1).join(touched, "path", "left_semi")
        before = self.findings(batch).join(touched, "path", "left_semi")
        key = ["rule", "path", "line_no"]
        added = after.join(before, key, "left_anti").select(F.lit("added").alias("change"), *key)
        return added.unionByName(before.join(after, key, "left_anti").select(F.lit("withdrawn").alias("change"), *key))

    def compact(self, batch: int) -> None:
        """Keeps one row a path of the runs up to ``batch``, then removes those runs."""
        kept = self.rows(batch + 1).filter("digest is not null")
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/_compacted")
        jvm = self.spark.sparkContext._jvm
        at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for name in self._folders():
            if name.startswith("batch=") and int(name[6:]) <= batch:
                fs.delete(at(name), True)
        fs.rename(at("_compacted"), at(f"batch={batch}"))
