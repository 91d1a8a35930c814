"""Findings reduced through policies: partition, allowances, phases, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..functions.ordered import EVALUATED, can_fail, is_coverage_debt
from .filters import evidence_floor


def with_identity(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"occurrence": X.occurrence_id("rule", "subject", "summary", "locations"), "line": X.lineage_id("rule", "subject", "summary")})


def first_entries(policy: DataFrame, keys: list[str]) -> DataFrame:
    """The first declared entry (least entry_no) of each key."""
    by = W.partitionBy(*keys).orderBy("entry_no")
    return policy.withColumn("rn", F.row_number().over(by)).filter("rn = 1").drop("rn")


def partition(findings: DataFrame, *, floor: str, calibrated: DataFrame, suppressions: DataFrame, baseline: DataFrame, now, history: DataFrame | None = None) -> DataFrame:
    """Every finding that can fail a build, with the one bucket it falls into.

    calibrated: (entry_no, rule); suppressions: (entry_no, rule, subject, expires);
    baseline: (entry_no, rule, subject, allowance, null for any number); history:
    (line, continuity). Buckets in order: below-floor, calibrated, suppressed while active,
    baselined or exceeded by the whole group of a rule and subject, recreated (a tolerated
    finding whose lineage was gone before), blocking. Policies are declared by hand and
    small; Spark broadcasts them by their size. Groups are counted by a map-side aggregate,
    so a hot subject is not gathered in one task.
    """
    base = findings.filter(can_fail())
    cal = first_entries(calibrated, ["rule"]).select("rule", F.lit(True).alias("is_calibrated"))
    active = first_entries(suppressions.filter(F.col("expires").isNull() | (F.col("expires") > F.lit(now))), ["rule", "subject"]).select("rule", "subject", F.lit(True).alias("is_suppressed"))
    debt = first_entries(baseline, ["rule", "subject"]).select("rule", "subject", "allowance", F.lit(True).alias("is_baselined"))
    out = base.join(cal, "rule", "left").join(active, ["rule", "subject"], "left").join(debt, ["rule", "subject"], "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    first = F.when(~evidence_floor("evidence", floor), "below-floor").when(on("is_calibrated"), "calibrated").when(on("is_suppressed"), "suppressed").when(on("is_baselined"), "tolerated").otherwise("blocking")
    out = out.withColumn("bucket", first)
    counts = out.filter("bucket = 'tolerated'").groupBy("rule", "subject").agg(F.count("*").alias("observed"))
    out = out.join(counts, ["rule", "subject"], "left")
    exceeded = F.col("allowance").isNotNull() & (F.col("observed") > F.col("allowance"))
    out = out.withColumn("bucket", F.when(F.col("bucket") != "tolerated", F.col("bucket")).when(exceeded, "baseline-exceeded").otherwise("baselined"))
    if history is not None:
        out = out.join(history.select("line", "continuity"), "line", "left").withColumn("bucket", F.when((F.col("bucket") == "baselined") & (F.col("continuity") == "recreated"), "recreated").otherwise(F.col("bucket"))).drop("continuity")
    return out.drop("is_calibrated", "is_suppressed", "is_baselined", "allowance", "observed")


def baseline_populations(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Observed against allowed per rule and subject, with the excess."""
    debt = first_entries(baseline, ["rule", "subject"]).select("rule", "subject", "allowance")
    out = findings.join(debt, ["rule", "subject"]).groupBy("rule", "subject", "allowance").agg(F.count("*").alias("observed"))
    return out.withColumn("excess", excess("observed", "allowance"))


def excess(observed, allowed) -> Column:
    """max(observed - allowed, 0); nothing exceeds an unbounded allowance."""
    return F.when(X.col(allowed).isNull(), F.lit(0).cast("long")).otherwise(F.greatest(X.col(observed) - X.col(allowed), F.lit(0).cast("long")))


def unmatched_entries(policy: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    return policy.join(findings.select(*keys).distinct(), keys, "left_anti")


def phases(findings: DataFrame, declared: DataFrame, approvals: DataFrame) -> DataFrame:
    """Outcome of each phase (phase_no, phase, rules, most): passed, failed or skipped.

    A phase fails with more than ``most`` blocking findings unless approved; all phases after
    the first failure are skipped. The window runs over phases, a short declared list.
    """
    counted = declared.select("phase_no", F.explode("rules").alias("rule")).join(findings.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").groupBy("phase_no").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("blocking"))
    out = declared.join(counted, "phase_no", "left").join(approvals.select("phase", F.lit(True).alias("approved")), "phase", "left").withColumn("blocking", F.coalesce("blocking", F.lit(0).cast("long")))
    out = out.withColumn("exceeded", F.col("blocking") > F.col("most")).withColumn("failed", F.col("exceeded") & ~F.coalesce("approved", F.lit(False)))
    earlier = W.orderBy("phase_no").rowsBetween(W.unboundedPreceding, -1)
    skipped = F.coalesce(F.max(F.col("failed").cast("int")).over(earlier), F.lit(0)) > 0
    out = out.withColumn("skipped", skipped)
    return out.select("phase_no", "phase", "blocking", F.when(F.col("skipped"), "skipped").when(F.col("failed"), "failed").otherwise("passed").alias("disposition"))


def phased_disposition(disposition: Column, findings: DataFrame, declared: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A failed run passes if every blocking finding belongs to a phase and no phase failed."""
    rules = declared.select(F.explode("rules").alias("rule")).distinct().withColumn("phased", F.lit(True))
    every = findings.join(rules, "rule", "left").agg(F.coalesce(F.bool_and(F.coalesce("phased", F.lit(False))), F.lit(True)).alias("every"))
    none = outcomes.agg(F.coalesce(~F.bool_or(F.col("disposition") == "failed"), F.lit(True)).alias("none"), F.count("*").alias("n"))
    return every.crossJoin(none).select(F.when((disposition == "failed") & (F.col("n") > 0) & F.col("every") & F.col("none"), "passed").otherwise(disposition).alias("disposition"))


def run_disposition(partitioned: DataFrame) -> DataFrame:
    """Failed if any finding blocks or exceeds its baseline."""
    bad = F.col("bucket").isin("blocking", "baseline-exceeded", "recreated")
    return partitioned.agg(F.when(F.coalesce(F.bool_or(bad), F.lit(False)), "failed").otherwise("passed").alias("disposition"))


def claim(findings: DataFrame) -> DataFrame:
    """Incomplete if any rule could not be judged."""
    return findings.agg(F.when(F.coalesce(F.bool_or(is_coverage_debt()), F.lit(False)), "incomplete").otherwise("complete").alias("claim"))


def coverage(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count_if(F.col("applicability").isin(EVALUATED)).alias("evaluated"), F.count_if(is_coverage_debt()).alias("debt"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, removed and changed occurrences of two runs (occurrence, bucket, reason)."""
    a = before.select("occurrence", F.col("bucket").alias("bucket_before"), F.col("reason").alias("reason_before"), F.lit(True).alias("in_before"))
    b = after.select("occurrence", F.col("bucket").alias("bucket_after"), F.col("reason").alias("reason_after"), F.lit(True).alias("in_after"))
    out = a.join(b, "occurrence", "full_outer")
    differs = ~F.col("bucket_before").eqNullSafe(F.col("bucket_after")) | ~F.col("reason_before").eqNullSafe(F.col("reason_after"))
    change = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(differs, "changed")
    return out.withColumn("change", change).filter("change is not null").select("occurrence", "change", "bucket_before", "bucket_after")


def added(before: DataFrame, after: DataFrame, key: str = "occurrence") -> DataFrame:
    return after.join(before, key, "left_anti")


def removed(before: DataFrame, after: DataFrame, key: str = "occurrence") -> DataFrame:
    return before.join(after, key, "left_anti")


def collisions(findings: DataFrame) -> DataFrame:
    """Later findings whose occurrence id an earlier one has already."""
    by = W.partitionBy("occurrence").orderBy("path", "doc_id")
    return findings.withColumn("rn", F.row_number().over(by)).filter("rn > 1").select("occurrence", "path", "rn")


def continuity(observations: DataFrame, states: DataFrame) -> DataFrame:
    """Of each lineage (line, state), what a scope's record of states 1..n establishes.

    exact: seen in all of two or more states; recreated: a gap inside its span, or missing
    from the last states after being seen; none otherwise.
    """
    n = states.agg(F.max("state").alias("recorded"))
    tally = observations.select("line", "state").distinct().groupBy("line").agg(F.min("state").alias("first"), F.max("state").alias("last"), F.count("*").alias("seen"))
    out = tally.crossJoin(F.broadcast(n))
    gap = (F.col("seen") < F.col("last") - F.col("first") + 1) | (F.col("last") < F.col("recorded"))
    verdict = F.when(gap, "recreated").when((F.col("seen") == F.col("recorded")) & (F.col("recorded") > 1), "exact").otherwise("none")
    return out.select("line", verdict.alias("continuity"))


def explain(partitioned: DataFrame, occurrence: str) -> DataFrame:
    return partitioned.filter(F.col("occurrence") == occurrence)


def reading_order(df: DataFrame) -> DataFrame:
    return df.orderBy("rule", "subject", "locations")
