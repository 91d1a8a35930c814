"""Submissions: required fields, cited submissions, acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .facts import current_values


def citations(cited: DataFrame, submissions: DataFrame, kind: str) -> DataFrame:
    """Each citation (id, cites): resolved, or why it is not, the first reason of the ladder."""
    known = submissions.select(F.col("node_id").alias("cites"), F.col("kind").alias("cited_kind"), "state")
    out = cited.join(known, "cites", "left")
    verdict = F.when(F.col("cited_kind").isNull(), "unknown").when(F.col("cited_kind") != kind, "wrong-kind").when(F.col("state") != "accepted", "not-accepted").otherwise("resolved")
    return out.select("id", "cites", verdict.alias("verdict"))


def validate(submissions: DataFrame, values: DataFrame, required: DataFrame, gaps: DataFrame) -> DataFrame:
    """(submission, problem, detail): missing fields, too few alternatives, open gaps when accepted.

    required: (kind, field, least) with how many values a field needs.
    """
    counted = values.filter("value is not null and value <> ''").groupBy("submission", "field").agg(F.count("*").alias("n"))
    need = submissions.join(required, "kind").select(F.col("node_id").alias("submission"), "field", "least")
    short = need.join(counted, ["submission", "field"], "left").filter(F.coalesce("n", F.lit(0)) < F.col("least"))
    missing = short.select("submission", F.when(F.col("n").isNull(), "missing-field").otherwise("too-few-values").alias("problem"), F.col("field").alias("detail"))
    accepted = submissions.filter("state = 'accepted'").select(F.col("node_id").alias("submission"))
    open_gaps = gaps.filter("closed_by is null").join(accepted, "submission", "left_semi").select("submission", F.lit("open-gap").alias("problem"), F.col("description").alias("detail"))
    origins = values.filter(~F.col("origin").isin("human", "agent", "derived")).select("submission", F.lit("unknown-origin").alias("problem"), F.col("field").alias("detail"))
    return missing.unionByName(open_gaps).unionByName(origins)


__all__ = ["citations", "current_values", "validate"]
