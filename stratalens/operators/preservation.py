"""Templates, dispositions and the preservation rules, with a runner for registered rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..functions.ordered import PRESERVED


def templates(blocks: DataFrame, *, shared_by: int = X.SHARED_BY, floor: int = X.TEMPLATE_FLOOR) -> DataFrame:
    """Bodies that stand in ``shared_by`` or more prose blocks, with how many documents have them."""
    long = blocks.filter((F.col("kind") == "prose") & (F.length("normalized") >= floor))
    return long.groupBy("normalized_hash").agg(F.count("*").alias("sections"), F.countDistinct("path", "revision").alias("documents"), F.min("normalized").alias("sample")).filter(F.col("sections") >= shared_by)


def undeclared_excess(found: DataFrame, declarations: DataFrame) -> DataFrame:
    """Templates that occur more often than their declarations allow."""
    declared = declarations.groupBy("normalized_hash").agg(F.sum("multiplicity").cast("long").alias("declared"))
    out = found.join(declared, "normalized_hash", "left").withColumn("declared", F.coalesce("declared", F.lit(0).cast("long")))
    return out.withColumn("excess", F.col("sections") - F.col("declared")).filter("excess > 0")


def repetition_index(blocks: DataFrame, key: str = "normalized_hash") -> DataFrame:
    return blocks.groupBy(key).agg(F.count("*").alias("sections"), F.countDistinct("path", "revision").alias("documents"))


def stub_documents(blocks: DataFrame, fillers: DataFrame) -> DataFrame:
    """Documents of which every block that is long enough is a template."""
    filler = fillers.select("normalized_hash").distinct().withColumn("is_filler", F.lit(1))
    keyed = blocks.filter(X.is_template_length("normalized")).join(filler, "normalized_hash", "left")
    counted = keyed.groupBy("path", "revision").agg(F.count("*").alias("keyed"), F.count("is_filler").alias("filler"))
    return counted.filter("keyed = filler")


def undisposed(blocks: DataFrame, lineage: DataFrame, omissions: DataFrame) -> DataFrame:
    """Blocks with neither a disposition nor an omission."""
    key = ["path", "revision", "ordinal"]
    of = lambda df: df.filter("block_ordinal is not null").select("path", "revision", F.col("block_ordinal").alias("ordinal"))
    return blocks.join(of(lineage), key, "left_anti").join(of(omissions), key, "left_anti")


def only_from_commentary(lineage: DataFrame, commentary: DataFrame) -> DataFrame:
    """Statements that come from commentary blocks and from no other block."""
    key = ["path", "revision", "block_ordinal"]
    traced = lineage.filter("target_statement is not null and block_ordinal is not null")
    marked = commentary.select("path", "revision", F.col("ordinal").alias("block_ordinal")).distinct()
    inside = traced.join(marked, key, "left_semi").select("target_statement").distinct()
    outside = traced.join(marked, key, "left_anti").select("target_statement").distinct()
    return inside.join(outside, "target_statement", "left_anti")


def unjustified_changes(statements: DataFrame, history: DataFrame) -> DataFrame:
    changed = history.filter("event = 'content_changed'").select("node_id")
    return statements.filter("supersedes_hash is not null").join(changed, "node_id", "left_anti").select("statement_id")


def untraced_statements(statements: DataFrame, lineage: DataFrame) -> DataFrame:
    kept = lineage.filter(F.col("block_ordinal").isNotNull() & F.col("disposition").isin(PRESERVED)).select(F.col("target_statement").alias("statement_id"))
    return statements.join(kept, "statement_id", "left_anti").select("statement_id")


# ---- rules -------------------------------------------------------------------------------

# Rule: (description, function of a store -> (rows checked, offending rows (subject, detail))).
Rule = tuple[str, Callable]


def outcome(rule: str, checked: DataFrame, offending: DataFrame) -> DataFrame:
    """One row: how many rows were checked, how many offend, and the status that follows."""
    n = checked.agg(F.count("*").alias("checked"))
    bad = offending.agg(F.count("*").alias("offending"))
    status = F.when(F.col("offending") > 0, "violated").otherwise("satisfied")
    return n.crossJoin(bad).select(F.lit(rule).alias("rule"), "checked", "offending", status.alias("status"), ((F.col("checked") == 0) & (F.col("offending") == 0)).alias("vacuous"))


def run_rules(rules: dict[str, Callable[[], tuple[DataFrame, DataFrame]]]) -> DataFrame:
    """Outcomes of registered rules; each is one distributed plan of two counts."""
    out = None
    for name in sorted(rules):
        row = outcome(name, *rules[name]())
        out = row if out is None else out.unionByName(row)
    return out


def validation_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count("*").alias("rules"), F.sum("checked").alias("checked"), F.sum("offending").alias("offending"), F.count_if(F.col("status") == "violated").alias("violated"), F.count_if("vacuous").alias("vacuous"))


def reconcile(declared: DataFrame, registered: DataFrame, key: str = "rule") -> DataFrame:
    """Rules that only one of the two lists has."""
    a = declared.join(registered, key, "left_anti").select(key, F.lit("unregistered").alias("problem"))
    b = registered.join(declared, key, "left_anti").select(key, F.lit("undeclared").alias("problem"))
    return a.unionByName(b)


def ruleset_hash(rules: DataFrame, key: str = "rule") -> DataFrame:
    """sha256 over the sorted distinct ids; the ids of a rule set are few by their nature."""
    return rules.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(key)), "\n"), 256).alias("ruleset"))
