"""Readers over the store's relations: joins with counts, polymorphic lineage, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X


def documents_with_counts(documents: DataFrame, blobs: DataFrame, headings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each document with its size and how many headings and blocks it has, zero if none."""
    key = ["path", "revision"]
    n_headings = headings.groupBy(*key).agg(F.count("*").alias("headings"))
    n_blocks = blocks.groupBy(*key).agg(F.count("*").alias("blocks"))
    out = documents.join(blobs, "sha256").join(n_headings, key, "left").join(n_blocks, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*key, "sha256", "byte_length", zero("headings"), zero("blocks"))


def nodes_view(nodes: DataFrame, suites: DataFrame) -> DataFrame:
    """Live nodes with their suite's title, empty where there is none."""
    live = nodes.filter("deleted_at is null")
    named = suites.select("suite_id", F.col("title").alias("suite"))
    return live.join(named, "suite_id", "left").select("node_id", "kind", "authority", "title", F.coalesce("suite", F.lit("")).alias("suite"))


def relations_view(relations: DataFrame, nodes: DataFrame, types: DataFrame, suites: DataFrame) -> DataFrame:
    """Edges with both ends' titles, the declared inverse, and the source's suite."""
    a = nodes.select(F.col("node_id").alias("from_node"), F.col("title").alias("from_title"), "suite_id")
    b = nodes.select(F.col("node_id").alias("to_node"), F.col("title").alias("to_title"))
    kinds = types.select(F.col("name").alias("type"), "inverse_of")
    named = suites.select("suite_id", F.col("title").alias("suite"))
    out = relations.join(kinds, "type").join(a, "from_node").join(b, "to_node").join(named, "suite_id", "left")
    return out.select("from_node", "from_title", "type", "to_node", "to_title", F.coalesce("inverse_of", F.lit("")).alias("inverse"), F.coalesce("suite", F.lit("")).alias("suite"))


def lineage_view(lineage: DataFrame, blocks: DataFrame, nodes: DataFrame, statements: DataFrame) -> DataFrame:
    """Every lineage row with its source, resolved to a block, a row of it or a heading, and target."""
    text = blocks.select("path", "revision", F.col("ordinal").alias("block_ordinal"), F.col("content_hash").alias("source_hash"))
    titles = nodes.select(F.col("node_id").alias("target_node"), F.col("title").alias("node_title"))
    texts = statements.select(F.col("statement_id").alias("target_statement"), F.col("canonical_hash").alias("statement_hash"))
    out = lineage.join(text, ["path", "revision", "block_ordinal"], "left").join(titles, "target_node", "left").join(texts, "target_statement", "left")
    source = X.cited_source("path", "block_ordinal", "row_ordinal", "heading")
    return out.select(source.alias("source"), "disposition", F.coalesce("target_node", "target_statement", F.lit("")).alias("target"), F.coalesce("node_title", "statement_hash", F.lit("")).alias("target_text"), F.coalesce("source_hash", F.lit("")).alias("source_hash"))


def omissions_view(omissions: DataFrame, blocks: DataFrame) -> DataFrame:
    text = blocks.select("path", "revision", F.col("ordinal").alias("block_ordinal"), "kind", F.col("content_hash"))
    out = omissions.join(text, ["path", "revision", "block_ordinal"], "left")
    return out.select(X.cited_source("path", "block_ordinal", F.lit(None).cast("long"), "heading").alias("source"), "reason", "justification", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("content_hash", F.lit("")).alias("content_hash"))


def neighbourhood(relations: DataFrame, nodes: DataFrame, subject: str) -> DataFrame:
    """Live nodes one edge from the subject, either way, without itself.

    Two directed scans with pushed-down filters, not a join on an OR condition.
    """
    out = relations.filter(F.col("from_node") == subject).select(F.col("to_node").alias("node_id"))
    back = relations.filter(F.col("to_node") == subject).select(F.col("from_node").alias("node_id"))
    near = out.union(back).filter(F.col("node_id") != subject).distinct()
    return nodes.filter("deleted_at is null").join(near, "node_id", "left_semi")


def documents_behind(lineage: DataFrame, documents: DataFrame, node: str) -> DataFrame:
    keys = lineage.filter(F.col("target_node") == node).select("path", "revision")
    return documents.join(keys, ["path", "revision"], "left_semi").select("path", "revision").distinct()


def family_edges(relations: DataFrame) -> DataFrame:
    """Edges between families of identifiers; edges within one family are dropped."""
    out = relations.select(X.family_key("from_node").alias("from_family"), X.family_key("to_node").alias("to_family"))
    return out.filter("from_family <> to_family").groupBy("from_family", "to_family").agg(F.count("*").alias("edges"))


def with_inverse_edges(relations: DataFrame, types: DataFrame) -> DataFrame:
    """Edges and the edges that their types' declared inverses add."""
    inverse = types.filter("inverse_of is not null").select(F.col("name").alias("type"), "inverse_of")
    back = relations.join(inverse, "type").select(F.col("to_node").alias("from_node"), F.col("inverse_of").alias("type"), F.col("from_node").alias("to_node"))
    return relations.select("from_node", "type", "to_node").union(back).distinct()


def edge_violations(relations: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Edges whose ends are of a kind the type does not allow; ends outside the store are exempt."""
    a = nodes.select(F.col("node_id").alias("from_node"), F.col("kind").alias("from_kind"))
    b = nodes.select(F.col("node_id").alias("to_node"), F.col("kind").alias("to_kind"))
    t = types.select(F.col("name").alias("type"), "domain_kinds", "range_kinds")
    out = relations.join(t, "type").join(a, "from_node", "left").join(b, "to_node", "left")
    bad_domain = F.col("from_kind").isNotNull() & ~F.array_contains("domain_kinds", F.col("from_kind"))
    bad_range = F.col("to_kind").isNotNull() & ~F.array_contains("range_kinds", F.col("to_kind"))
    return out.filter(bad_domain | bad_range).select("from_node", "type", "to_node", F.when(bad_domain, "domain").otherwise("range").alias("side"))


def cardinality_violations(relations: DataFrame, types: DataFrame) -> DataFrame:
    most = types.filter("max_per_node is not null").select(F.col("name").alias("type"), "max_per_node")
    counted = relations.groupBy("from_node", "type").agg(F.count("*").alias("edges"))
    return counted.join(most, "type").filter("edges > max_per_node").select("from_node", "type", "edges", "max_per_node")


def inverse_mismatches(types: DataFrame) -> DataFrame:
    """Types whose inverse does not name them back."""
    other = types.select(F.col("name").alias("inverse_of"), F.col("inverse_of").alias("back"))
    return types.filter("inverse_of is not null").join(other, "inverse_of", "left").filter(~F.col("back").eqNullSafe(F.col("name"))).select("name", "inverse_of")
