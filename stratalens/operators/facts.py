"""Facts as versioned rows: materialising, lookups by generation, invalidation, change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..functions.ordered import GRANULARITY, rank
from .filters import Refused
from .graph import reach


def latest(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key, by one partially aggregated pass."""
    rest = [c for c in facts.columns if c not in keys and c != "generation"]
    out = facts.groupBy(*keys).agg(F.max(F.struct("generation", *rest)).alias("v"))
    return out.select(*keys, "v.generation", *[F.col(f"v.{c}") for c in rest])


def current_at(facts: DataFrame, keys: list[str], generation: int) -> DataFrame:
    """The version of each key that was visible at a generation."""
    return latest(facts.filter(F.col("generation") <= generation), keys)


def with_history(facts: DataFrame, keys: list[str], kept: int = 1) -> DataFrame:
    """The newest version and ``kept`` ones before it."""
    by = W.partitionBy(*keys).orderBy(F.desc("generation"))
    return facts.withColumn("age", F.row_number().over(by) - 1).filter(F.col("age") <= kept)


def backdated(facts: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """Arriving versions older than what is known already; they are refused."""
    known = facts.groupBy(*keys).agg(F.max("generation").alias("known"))
    return arriving.join(known, keys).filter("generation < known").drop("known")


def materialise(facts: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """Known and arriving versions together, refused ones left out, equal versions once."""
    fresh = arriving.join(backdated(facts, arriving, keys).select(*keys, "generation"), [*keys, "generation"], "left_anti")
    return facts.unionByName(fresh).dropDuplicates([*keys, "generation"])


def unchanged(arriving: DataFrame, facts: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Arriving rows whose newest known version has the same content: not written again."""
    known = latest(facts, keys).select(*keys, F.col(digest).alias("known"))
    return arriving.join(known, keys).filter(F.col(digest).eqNullSafe(F.col("known"))).drop("known")


def caused(facts: DataFrame, **cause) -> DataFrame:
    """Facts whose key names the cause: a value, or a list of them, for each key column."""
    for k, v in cause.items():
        facts = facts.filter(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return facts


def invalidated(nodes: DataFrame, depends: DataFrame, roots: DataFrame, already: DataFrame | None = None) -> DataFrame:
    """Each node with whether the change of ``roots`` reaches it along reverse dependencies."""
    reverse = depends.select(F.col("needs").alias("src"), F.col("node").alias("dst"))
    hit = reach(roots, reverse, already).withColumn("hit", F.lit(True))
    return nodes.select("node").distinct().join(hit, "node", "left").select("node", F.when(F.col("hit"), "invalidated").otherwise("retained").alias("state"))


def broadened(facts: DataFrame, requested: str, column: str = "incremental") -> DataFrame:
    """Facts whose provider can only refresh more coarsely than was asked."""
    return facts.filter(rank(column, GRANULARITY) < F.lit(GRANULARITY.index(requested)))


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """What a change set (path, digest, null to remove) does to a snapshot (path, digest)."""
    a = current.select("path", F.col("digest").alias("was"), F.lit(True).alias("there"))
    b = changes.select("path", F.col("digest").alias("now"), F.lit(True).alias("named"))
    out = a.join(b, "path", "full_outer")
    effect = F.when(F.col("named").isNull(), "kept").when(F.col("now").isNull() & F.col("there").isNull(), "already-absent").when(F.col("now").isNull(), "removed").when(F.col("there").isNull(), "added").when(F.col("was") == F.col("now"), "redundant").otherwise("modified")
    return out.select("path", effect.alias("effect"), F.when(F.col("named"), F.col("now")).otherwise(F.col("was")).alias("digest"))


def advances(effects: DataFrame) -> DataFrame:
    """Whether a generation advances: only if something is altered."""
    return effects.agg(F.coalesce(F.bool_or(F.col("effect").isin("added", "modified", "removed")), F.lit(False)).alias("advances"))


def require_changes(changes: DataFrame) -> DataFrame:
    """Refuses an empty change set and one that names a path twice."""
    if changes.isEmpty():
        raise Refused("the change set is empty")
    twice = changes.groupBy(X.normal_path("path").alias("p")).count().filter("count > 1")
    if not twice.isEmpty():
        raise Refused("the change set names a path twice")
    return changes


def snapshot_digest(snapshot: DataFrame) -> DataFrame:
    """One digest of a snapshot's (path, digest) rows, whatever their order or partitions.

    Row digests fall into 4096 buckets by their first three hexadecimal digits, each bucket
    digests its sorted row digests, and the last digest is over the buckets' ones: no task
    sorts or gathers the whole snapshot.
    """
    row = snapshot.select(X.framed_digest("path", "digest").alias("d"))
    by = row.groupBy(F.substring("d", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d"))
    return by.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: F.concat(x["b"], F.lit(":"), x["d"])), "\n"), 256).alias("digest"))


def freshness(recorded: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Of each projection: absent, stale-inputs, edited, diverged or fresh.

    recorded: (id, inputs, output) stamps; inputs and outputs: (id, digest) as they are now.
    """
    a = inputs.select("id", F.col("digest").alias("inputs_now"))
    b = outputs.select("id", F.col("digest").alias("output_now"))
    out = recorded.join(a, "id", "left").join(b, "id", "left")
    moved = ~F.col("inputs").eqNullSafe(F.col("inputs_now"))
    edited = ~F.col("output").eqNullSafe(F.col("output_now"))
    state: Column = F.when(F.col("output_now").isNull(), "absent").when(moved & edited, "diverged").when(moved, "stale-inputs").when(edited, "edited").otherwise("fresh")
    return out.select("id", state.alias("state"))


def current_values(values: DataFrame) -> DataFrame:
    """The newest value of every field of every submission."""
    return values.groupBy("submission", "field").agg(F.max_by("value", "ordinal").alias("value"), F.max("ordinal").alias("ordinal"))
