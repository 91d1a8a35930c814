"""A session with the settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Adaptive execution coalesces and splits shuffle partitions at run time, so the number set
# here is an upper bound for small inputs; clusters set it to two or three tasks a core.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "20g", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("stratalens").config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over all cores, if the input's splits would leave half of them idle.

    A small table in one file is one task otherwise. Tables of a cluster's size have more
    splits than cores and are left as they are: no shuffle is added to them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


# What one task takes of texts that are cut into rows of tokens or lines, and of such rows.
TASK_CHARS, TASK_ROWS = 2_000_000, 500_000


def path_tasks(df: DataFrame, text: str | None = None) -> int:
    """How many tasks the rows need by the characters of ``text``, or else by their number."""
    n, most = (df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0, TASK_CHARS) if text else (df.count(), TASK_ROWS)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n > most else 1
    return max(least, n // most + 1)


def by_path(df: DataFrame, text: str | None = None) -> DataFrame:
    """The rows dealt by path, so few to a task that all windows over them stand in memory.

    Rows of tokens or lines are many times their compressed size, and each window sorts them; so the
    number of tasks follows the input, counted first, and adaptive execution does not merge them.
    """
    return df.repartition(path_tasks(df, text), "path")
