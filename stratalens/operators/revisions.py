"""Differences between revisions: appeared, disappeared, changed, reappeared, relocated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as X
from .graph import settle
from .mentions import mentions


def parse_labels(names: DataFrame, column: str = "name") -> DataFrame:
    """Version labels such as v1.12 as numbers, in order; other names are left out."""
    shape = r"v([0-9]+)\.([0-9]+)"
    out = names.withColumn("major", F.regexp_extract(column, shape, 1)).filter("major <> ''")
    return out.select(column, F.col("major").cast("int").alias("major"), F.regexp_extract(column, shape, 2).cast("int").alias("minor"))


def label_gaps(labels: DataFrame) -> DataFrame:
    """Minor numbers that a major version's sequence skips."""
    spans = labels.groupBy("major").agg(F.min("minor").alias("lo"), F.max("minor").alias("hi"))
    full = spans.select("major", F.explode(F.sequence("lo", "hi")).alias("minor"))
    return full.join(labels, ["major", "minor"], "left_anti")


def walk(revisions: DataFrame) -> DataFrame:
    """What happens to each path at each revision (path, rev_no, hash).

    Arrivals look back along the path's own history, departures look forward to the next
    revision that exists; no pair of revisions is joined.
    """
    numbers = revisions.select("rev_no").distinct()
    order = W.orderBy("rev_no")  # one row per revision of the corpus
    steps = numbers.select("rev_no", F.lag("rev_no").over(order).alias("previous"), F.lead("rev_no").over(order).alias("next"))
    by = W.partitionBy("path").orderBy("rev_no")
    seen = revisions.select("path", "rev_no", "hash", F.lag("rev_no").over(by).alias("was"), F.lag("hash").over(by).alias("was_hash"), F.lead("rev_no").over(by).alias("will")).join(steps, "rev_no")
    arrival = F.when(F.col("previous").isNull(), None).when(F.col("was").isNull(), "appeared").when(F.col("was") < F.col("previous"), "reappeared").when(F.col("hash") != F.col("was_hash"), "changed")
    came = seen.select("path", "rev_no", arrival.alias("event")).filter("event is not null")
    gone = seen.filter("next is not null and not (will <=> next)").select("path", F.col("next").alias("rev_no"), F.lit("disappeared").alias("event"))
    return came.unionByName(gone)


def pair_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents (path, hash) of two revisions compared by path."""
    a = before.select("path", F.col("hash").alias("before"))
    b = after.select("path", F.col("hash").alias("after"))
    event = F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "disappeared").when(F.col("before") != F.col("after"), "changed").otherwise("kept")
    return a.join(b, "path", "full_outer").select("path", event.alias("event"))


def relocations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Appeared documents whose content stood under paths that disappeared, all of them listed."""
    appeared = after.join(before, "path", "left_anti").select(F.col("path").alias("to_path"), "hash")
    gone = before.join(after, "path", "left_anti").select(F.col("path").alias("from_path"), "hash")
    sources = gone.groupBy("hash").agg(F.sort_array(F.collect_set("from_path")).alias("from_paths"))
    return appeared.join(sources, "hash").select("to_path", "from_paths", "hash")


def kind_census(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Per revision: documents, fence lines, code and prose blocks, pipe lines, documents with tables."""
    pipe = X.is_pipe_line("line")
    by_line = lines.groupBy("revision").agg(F.countDistinct("path").alias("documents"), F.count_if(F.col("line").startswith("```")).alias("fence_lines"), F.count_if(pipe).alias("pipe_lines"), F.countDistinct(F.when(pipe, F.col("path"))).alias("table_documents"))
    by_block = blocks.groupBy("revision").agg(F.count_if(F.col("kind") == "code").alias("code_blocks"), F.count_if(F.col("kind") == "prose").alias("prose_blocks"), F.count_if(F.col("kind") == "heading").alias("headings"))
    return by_line.join(by_block, "revision", "left")


def reconcile_identifiers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each old identifier (id, text): preserved, reworded or absent in the new texts."""
    a = old.select("id", X.normalised_hash("text").alias("was"))
    b = new.select("id", X.normalised_hash("text").alias("now"), F.lit(True).alias("there"))
    return a.join(b, "id", "left").select("id", F.when(F.col("there").isNull(), "absent").when(F.col("was") == F.col("now"), "preserved").otherwise("reworded").alias("fate"))


def manifest_check(blocks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Recomputed block hashes against recorded ones (path, ordinal, hash)."""
    a = blocks.select("path", "ordinal", F.col("content_hash").alias("found"))
    b = manifest.select("path", "ordinal", F.col("hash").alias("recorded"))
    verdict = F.when(F.col("found").isNull(), "missing").when(F.col("recorded").isNull(), "unrecorded").when(F.col("found") == F.col("recorded"), "equal").otherwise("different")
    return a.join(b, ["path", "ordinal"], "full_outer").select("path", "ordinal", verdict.alias("verdict"))


def member_fates(members: DataFrame, positions: DataFrame, documents: DataFrame) -> DataFrame:
    """Fate of each member (id, name, family): preserved, hollowed, mentioned or gone.

    positions: (name, kind, shared_with, document) where kind is row, narrative, template or
    none. A member that stands nowhere is looked for in the documents' texts.
    """
    order = F.when(F.col("kind").isin("row", "narrative"), 0).otherwise(1)
    best = positions.groupBy("name").agg(F.min(order).alias("best"))
    placed = members.join(best, "name", "left")
    met = mentions(placed.filter("best is null").select("name"), documents, settle)
    found = met.select("name").distinct().withColumn("seen", F.lit(True))
    fate = F.when(F.col("best") == 0, "preserved").when(F.col("best") == 1, "hollowed").when(F.col("seen"), "mentioned").otherwise("gone")
    return placed.join(found, "name", "left").select("id", "name", "family", fate.alias("fate"))


def fate_tally(fates: DataFrame) -> DataFrame:
    kinds = ["preserved", "hollowed", "mentioned", "gone"]
    return fates.groupBy("family").agg(*[F.count_if(F.col("fate") == k).alias(k) for k in kinds])
