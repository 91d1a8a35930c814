"""Writes into the store's relations: inserts if absent, upserts, placeholders.

Each returns the table as it is after the write, as a plan; a table format with MERGE can
take the same joins. Keys compare null-safe where they may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.filters import Refused


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table has not; of rows with one key, one."""
    same = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    fresh = rows.dropDuplicates(keys).alias("r").join(table.select(*keys).alias("t"), same, "left_anti")
    return table.unionByName(fresh)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of equal key; others stay."""
    same = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    kept = table.alias("t").join(rows.select(*keys).alias("r"), same, "left_anti")
    return kept.unionByName(rows.dropDuplicates(keys))


def upsert_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """A real node replaces a placeholder (kind null) and never another real node."""
    both = nodes.withColumn("_at", F.lit(0)).unionByName(rows.withColumn("_at", F.lit(1)))
    by = W.partitionBy("node_id").orderBy(F.col("kind").isNull(), "_at")
    return both.withColumn("_rn", F.row_number().over(by)).filter("_rn = 1").drop("_rn", "_at")


def require_constrained(types: DataFrame) -> DataFrame:
    """Refuses relation types without domain, range and a positive cardinality, if stated."""
    bad = types.filter((F.size("domain_kinds") <= 0) | (F.size("range_kinds") <= 0) | (F.col("max_per_node") <= 0))
    if not bad.isEmpty():
        raise Refused("a relation type without constraints")
    return types


def pair_inverses(types: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sets inverse_of both ways for (name, inverse) pairs."""
    both = pairs.select("name", F.col("inverse").alias("pair")).union(pairs.select(F.col("inverse").alias("name"), F.col("name").alias("pair")))
    return types.join(both, "name", "left").withColumn("inverse_of", F.coalesce("pair", "inverse_of")).drop("pair").select(*types.columns)


def append_history(history: DataFrame, events: DataFrame) -> DataFrame:
    """New events (node_id, event, recorded_at) chained to each node's last one.

    A node's own events are few; its chain is folded inside one row, so hashes can depend on
    the ones before.
    """
    last = history.groupBy("node_id").agg(F.max(F.struct("ordinal", "event_hash")).alias("l"))
    own = events.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("recorded_at", "event"))).alias("es")).join(last, "node_id", "left")
    row = "struct<ordinal:bigint,event:string,recorded_at:string,previous_event_hash:string,event_hash:string>"
    start = F.struct(F.coalesce("l.ordinal", F.lit(0)).cast("bigint").alias("n"), F.coalesce("l.event_hash", F.lit("")).alias("h"), F.array().cast(f"array<{row}>").alias("rows"))

    def step(s, e):
        h = F.sha2(F.concat_ws("\x1f", s["h"], e["event"], e["recorded_at"]), 256)
        one = F.struct((s["n"] + 1).alias("ordinal"), e["event"].alias("event"), e["recorded_at"].alias("recorded_at"), s["h"].alias("previous_event_hash"), h.alias("event_hash")).cast(row)
        return F.struct((s["n"] + 1).cast("bigint").alias("n"), h.alias("h"), F.concat(s["rows"], F.array(one)).alias("rows"))

    made = own.select("node_id", F.explode(F.aggregate("es", start, step, lambda s: s["rows"])).alias("r")).select("node_id", "r.*")
    return history.unionByName(made.select(*history.columns))


def broken_chains(history: DataFrame) -> DataFrame:
    """Events whose previous hash is not the hash of the event before."""
    by = W.partitionBy("node_id").orderBy("ordinal")
    before = F.coalesce(F.lag("event_hash").over(by), F.lit(""))
    return history.withColumn("before", before).filter(~F.col("previous_event_hash").eqNullSafe(F.col("before"))).select("node_id", "ordinal")
