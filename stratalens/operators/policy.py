"""Declared policies: limits by scope, layered resolution, goals, dependency direction, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# Defaults of the limits a repository may declare; no value means undeclared.
LIMIT_DEFAULTS = {
    ("file-size-review-lines", None): 500,
    ("file-size-hard-lines", None): 1500,
    ("file-size-hard-lines", "go"): 1000,
    ("parameter-count-max", None): 4,
    ("nesting-depth-max", None): 3,
}


def scoped_limits(subjects: DataFrame, limits: DataFrame, key: str, language: str = "lang") -> DataFrame:
    """The limit of each subject: its language's row, else the repository's, else null (undeclared)."""
    own = limits.filter(F.col("key") == key)
    by_language = own.filter("language is not null").select(F.col("language").alias(language), F.col("value").alias("own_limit"))
    overall = own.filter("language is null").agg(F.max("value").alias("repo_limit"))
    out = subjects.join(by_language, language, "left").crossJoin(F.broadcast(overall))
    return out.withColumn("limit", F.coalesce("own_limit", "repo_limit")).drop("own_limit", "repo_limit")


def effective(layers: DataFrame) -> DataFrame:
    """Entries (layer, position, key, value) merged: the highest layer wins, in first-declared order."""
    by = W.partitionBy("key").orderBy(F.desc("layer"), "position")
    first = W.partitionBy("key")
    out = layers.withColumn("rn", F.row_number().over(by)).withColumn("declared_at", F.min(F.struct("layer", "position")).over(first))
    return out.filter("rn = 1").select("key", "value", "layer", F.col("declared_at.layer").alias("first_layer"), F.col("declared_at.position").alias("first_position"))


def displaced(layers: DataFrame) -> DataFrame:
    """Contributions that a higher layer supersedes."""
    top = layers.groupBy("key").agg(F.max("layer").alias("top"))
    return layers.join(top, "key").filter("layer < top").select("key", "layer", "value")


def contradictions(layers: DataFrame) -> DataFrame:
    """Keys for which one layer states different values."""
    return layers.groupBy("layer", "key").agg(F.countDistinct("value").alias("values")).filter("values > 1")


def absent_layers(known: DataFrame, layers: DataFrame) -> DataFrame:
    return known.join(layers.select("layer").distinct(), "layer", "left_anti")


def goal_coverage(goals: DataFrame, parts: DataFrame, ceiling: int) -> DataFrame:
    """Parts that serve each declared goal: orphaned with none, smeared over the ceiling."""
    served = parts.select("part", F.explode("serves").alias("goal")).groupBy("goal").agg(F.countDistinct("part").alias("servers"))
    out = goals.join(served, "goal", "left").withColumn("servers", F.coalesce("servers", F.lit(0).cast("long")))
    return out.select("goal", "servers", F.when(F.col("servers") == 0, "orphaned").when(F.col("servers") > ceiling, "smeared").otherwise("served").alias("standing"))


def goal_mismatches(goals: DataFrame, parts: DataFrame) -> DataFrame:
    """Goals that parts serve and nobody declared, and parts that serve nothing."""
    serves = parts.select("part", F.explode("serves").alias("goal"))
    undeclared = serves.join(goals, "goal", "left_anti").select(F.col("part").alias("name"), F.lit("undeclared-goal").alias("problem"))
    idle = parts.filter(F.size("serves") == 0).select(F.col("part").alias("name"), F.lit("serves-nothing").alias("problem"))
    return undeclared.unionByName(idle).distinct()


def admissible(edges: DataFrame, placement: DataFrame, permits: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Each dependency edge (package, target, kind) with its verdict under the architecture.

    placement: package -> component; permits: (from_component, to_component); exceptions:
    (package, target). Edges for development only are not judged, nor are edges inside one
    component or out of the placed packages.
    """
    a = placement.select("package", F.col("component").alias("from_component"))
    b = placement.select(F.col("package").alias("target"), F.col("component").alias("to_component"))
    ok = permits.select("from_component", "to_component", F.lit(True).alias("permitted"))
    excused = exceptions.select("package", "target", F.lit(True).alias("excepted"))
    out = edges.join(a, "package", "left").join(b, "target", "left").join(ok, ["from_component", "to_component"], "left").join(excused, ["package", "target"], "left")
    verdict = F.when(F.col("kind") == "dev", "not-judged").when(F.col("from_component").isNull() | F.col("to_component").isNull(), "unplaced").when(F.col("from_component") == F.col("to_component"), "inside").when(F.col("permitted"), "permitted").when(F.col("excepted"), "excepted").otherwise("violation")
    return out.select("package", "target", "kind", verdict.alias("verdict"))


def unplaced(packages: DataFrame, placement: DataFrame) -> DataFrame:
    return packages.join(placement, "package", "left_anti")


def write_authority(edges: DataFrame, doors: DataFrame) -> DataFrame:
    """Packages that depend on an authority without being one of its declared doors."""
    guarded = doors.select(F.col("authority").alias("target")).distinct()
    named = doors.select(F.col("authority").alias("target"), F.col("door").alias("package"))
    return edges.join(guarded, "target", "left_semi").join(named, ["target", "package"], "left_anti").select("package", "target")


def trace_problems(trace: DataFrame, sites: DataFrame, gaps: DataFrame, records: DataFrame) -> DataFrame:
    """Stale entries of a requirement trace (entry, assessment, site, gap, record)."""
    partial = trace.filter((F.col("assessment") == "partial") & F.col("gap").isNull()).select("entry", F.lit("partial-without-gap").alias("problem"))
    diverged = trace.filter((F.col("assessment") == "diverged") & F.col("record").isNull()).select("entry", F.lit("divergence-without-record").alias("problem"))
    lost = lambda c, known, what: trace.filter(F.col(c).isNotNull()).join(known, c, "left_anti").select("entry", F.lit(what).alias("problem"))
    return partial.unionByName(diverged).unionByName(lost("site", sites, "unresolved-site")).unionByName(lost("gap", gaps, "unresolved-gap")).unionByName(lost("record", records, "unresolved-record"))


def plan_conflicts(access: DataFrame) -> DataFrame:
    """Pairs of plans that touch one subject of a tier, one of them writing.

    access: (plan, tier, subject, mode). Reads of one subject are many and never pair with
    each other: writers join with all touches of the subject.
    """
    touch = access.groupBy("plan", "tier", "subject").agg(F.bool_or(F.col("mode") == "write").alias("writes"))
    w = touch.filter("writes").select("tier", "subject", F.col("plan").alias("writer"))
    other = touch.select("tier", "subject", F.col("plan").alias("other"), F.col("writes").alias("other_writes"))
    pairs = w.join(other, ["tier", "subject"]).filter("writer <> other")
    out = pairs.select(F.least("writer", "other").alias("src"), F.greatest("writer", "other").alias("dst"), "tier", "subject", "other_writes")
    return out.groupBy("src", "dst", "tier", "subject").agg(F.when(F.bool_or("other_writes"), "write-write").otherwise("read-write").alias("conflict"))


def converged(trail: DataFrame) -> DataFrame:
    """Rounds whose state signature an earlier round had already."""
    first = trail.groupBy("signature").agg(F.min("round").alias("first_round"))
    return trail.join(first, "signature").filter("first_round < round").select("round", "first_round")


def correspondence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Structs (name, counterpart, fields) against the struct they name: fields only one side has."""
    other = right.select(F.col("name").alias("counterpart"), F.col("fields").alias("other_fields"))
    out = left.filter("counterpart is not null").join(other, "counterpart", "left")
    none = F.array().cast("array<string>")
    missing = F.sort_array(F.array_except("fields", F.coalesce("other_fields", none)))
    extra = F.sort_array(F.array_except(F.coalesce("other_fields", none), "fields"))
    verdict = F.when(F.col("other_fields").isNull(), "unresolved").when((F.size(missing) == 0) & (F.size(extra) == 0), "corresponds").otherwise("differs")
    return out.select("name", "counterpart", missing.alias("missing"), extra.alias("extra"), verdict.alias("verdict"))
