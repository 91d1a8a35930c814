"""Markdown documents as typed blocks, and the rows of their tables.

A short document is folded line by line inside one row, by Spark's own higher-order functions, so
nothing is shuffled. A fold copies the blocks that it has with every line, so a document of more
than ``FOLDED_LINES`` lines goes by windows over its lines instead, in time that its sort takes:
what state a line is in follows from counts of the lines before it. Both give the same blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X

FOLDED_LINES = 200
WINDOWED_LEVELS = 12  # headings nested deeper are looked up one by one
BLOCK = "struct<kind:string,heading_path:array<string>,lines:array<string>>"
STATE = f"struct<blocks:array<{BLOCK}>,open:array<string>,fence:boolean,path:array<string>>"


def _flush(s: Column) -> Column:
    one = F.array(F.struct(F.lit("prose").alias("kind"), s["path"].alias("heading_path"), s["open"].alias("lines")))
    return F.when(F.size(s["open"]) > 0, F.concat(s["blocks"], one)).otherwise(s["blocks"])


def _state(blocks: Column, lines: Column, fence: Column, path: Column) -> Column:
    return F.struct(blocks.alias("blocks"), lines.alias("open"), fence.alias("fence"), path.alias("path")).cast(STATE)


def _step(s: Column, line: Column) -> Column:
    none, no, yes = F.array().cast("array<string>"), F.lit(False), F.lit(True)
    fenced = F.concat(s["open"], F.array(line))
    code = F.concat(s["blocks"], F.array(F.struct(F.lit("code").alias("kind"), s["path"].alias("heading_path"), fenced.alias("lines"))))
    depth = X.heading_depth(line)
    path = F.concat(F.slice(s["path"], F.lit(1), F.least(F.greatest(depth - 1, F.lit(0)), F.size(s["path"]))), F.array(X.heading_title(line)))
    heading = F.concat(_flush(s), F.array(F.struct(F.lit("heading").alias("kind"), path.alias("heading_path"), F.array(line).alias("lines"))))
    ticks = line.startswith("```")
    return (
        F.when(s["fence"] & ticks, _state(code, none, no, s["path"]))
        .when(s["fence"], _state(s["blocks"], fenced, yes, s["path"]))
        .when(line.startswith("#"), _state(heading, none, no, path))
        .when(ticks, _state(_flush(s), F.array(line), yes, s["path"]))
        .when(X.trim_space(line) == "", _state(_flush(s), none, no, s["path"]))
        .otherwise(_state(s["blocks"], fenced, no, s["path"]))
    )


def _finish(s: Column) -> Column:
    rest = F.array(F.struct(F.when(s["fence"], "code").otherwise("prose").alias("kind"), s["path"].alias("heading_path"), s["open"].alias("lines")))
    return F.when(F.size(s["open"]) > 0, F.concat(s["blocks"], rest)).otherwise(s["blocks"])


def body_lines(text: Column) -> Column:
    """Lines without trailing returns, after front matter."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r+$", ""))
    first = X.trim_space(F.regexp_replace(F.get(lines, F.lit(0)), "^﻿", "")) == "---"
    tail = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), X.trim_space)
    close = F.array_position(tail, "---")
    return F.when(first & (close > 0), F.slice(lines, (close + 2).cast("int"), F.size(lines))).otherwise(lines)


def segment(documents: DataFrame, *, text: str = "text", keys: tuple[str, ...] = ("path", "revision"), folded_lines: int | None = None) -> DataFrame:
    """Blocks in order: headings, fenced code, and paragraphs between blank lines.

    Null and empty texts have no blocks.
    """
    most = FOLDED_LINES if folded_lines is None else folded_lines
    given = documents.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    found = _folded(given.filter(n_lines <= most), keys).unionByName(_scanned(given.filter(n_lines > most), keys))
    return found.select(*keys, "ordinal", "kind", "heading_path", "text", X.content_hash("text").alias("content_hash"), X.normalised_hash("text").alias("normalized_hash"))


def _folded(documents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    none = F.array().cast("array<string>")
    start = _state(F.array().cast(f"array<{BLOCK}>"), none, F.lit(False), none)
    out = documents.select(*keys, F.posexplode(F.aggregate(body_lines(F.col("text")), start, _step, _finish)).alias("p", "b"))
    return out.select(*keys, (F.col("p") + 1).cast("long").alias("ordinal"), F.col("b.kind").alias("kind"), F.col("b.heading_path").alias("heading_path"), F.array_join("b.lines", "\n").alias("text"))


def _scanned(documents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    own = [f"k{i}" for i in range(len(keys))]
    dealt = documents.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.monotonically_increasing_id().alias("doc"), "text").repartition("doc")
    lines = dealt.select(*own, "doc", F.posexplode(body_lines(F.col("text"))).alias("p", "line"))
    by = W.partitionBy("doc").orderBy("p")
    ticks, heads = F.col("line").startswith("```"), F.col("line").startswith("#")
    fenced = F.coalesce(F.sum(ticks.cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    lines = lines.withColumn("fenced", fenced)
    kind = F.when(F.col("fenced") | ticks, "code").when(heads, "heading").when(X.trim_space("line") == "", "blank").otherwise("prose")
    lines = lines.withColumn("kind", kind)
    starts = (ticks & ~F.col("fenced")) | (F.col("kind") == "heading") | ((F.col("kind") == "prose") & ~F.coalesce(F.lag("kind").over(by) == "prose", F.lit(False)))
    lines = lines.withColumn("ordinal", F.sum(starts.cast("long")).over(by)).filter("kind <> 'blank'")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n")
    blocks = lines.groupBy("doc", "ordinal").agg(*[F.first(o).alias(o) for o in own], F.first("kind").alias("kind"), texts.alias("text"))
    # The i-th heading has a path of min(its depth, one more than before) titles: the least of what
    # each heading up to it allows. Its entry at a level is the last title of that length.
    is_head = F.col("kind") == "heading"
    so_far = W.partitionBy("doc", "is_head").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.withColumn("is_head", is_head).withColumn("title", X.heading_title("text")).withColumn("i", F.row_number().over(W.partitionBy("doc", "is_head").orderBy("ordinal")))
    blocks = blocks.withColumn("size", F.when(is_head, F.col("i") + F.least(F.lit(0), F.min(F.greatest(X.heading_depth("text"), F.lit(1)) - F.col("i")).over(so_far))))
    at = [F.last(F.when(F.col("size") == level, F.col("title")), ignorenulls=True).over(so_far) for level in range(1, WINDOWED_LEVELS + 1)]
    blocks = blocks.withColumn("upper", F.when(is_head, F.array(*at)))
    blocks = blocks.withColumn("deep", F.collect_list(F.when(F.col("size") > WINDOWED_LEVELS, F.struct("size", "title"))).over(so_far))
    lower = F.transform(F.sequence(F.lit(WINDOWED_LEVELS + 1), F.col("size")), lambda level: F.element_at(F.filter("deep", lambda x: x["size"] == level), -1)["title"])
    path = F.when(is_head, F.concat(F.slice("upper", F.lit(1), F.least(F.col("size"), F.lit(WINDOWED_LEVELS))), F.when(F.col("size") > WINDOWED_LEVELS, lower).otherwise(F.array().cast("array<string>"))))
    last = F.last(F.col("path"), ignorenulls=True).over(W.partitionBy("doc").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0))
    blocks = blocks.withColumn("path", path).withColumn("heading_path", F.coalesce(last, F.array().cast("array<string>")))
    return blocks.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], "ordinal", "kind", "heading_path", "text")


def headings(blocks: DataFrame) -> DataFrame:
    own = blocks.filter("kind = 'heading'")
    return own.select("path", "revision", "ordinal", X.heading_title("text").alias("title"), X.heading_depth("text").alias("depth"))


def table_rows(blocks: DataFrame, keys: tuple[str, ...] = ("path", "revision", "ordinal")) -> DataFrame:
    """Rows of the tables in blocks that are not code, with ordinals, cells and kinds.

    A table starts where a pipe line follows a line that is none; rows before a table's first
    separator are its header.
    """
    lines = blocks.filter("kind <> 'code'").select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    own = [f"k{i}" for i in range(len(keys))]
    by = W.partitionBy(*own).orderBy("line_no")
    lines = lines.withColumn("pipe", X.is_pipe_line("line"))
    starts = F.col("pipe") & ~F.coalesce(F.lag("pipe").over(by), F.lit(False))
    lines = lines.withColumn("table_ordinal", F.sum(starts.cast("long")).over(by)).filter("pipe")
    lines = lines.withColumn("row_ordinal", F.row_number().over(by).cast("long")).withColumn("cells", X.split_cells("line"))
    lines = lines.withColumn("sep", X.is_separator("cells"))
    table = W.partitionBy(*own, "table_ordinal")
    first = F.min(F.when(F.col("sep"), F.col("row_ordinal"))).over(table)
    kind = F.when(F.col("row_ordinal") < first, "header").when(F.col("sep"), "separator").otherwise("content")
    return lines.select(*[F.col(f"k{i}").alias(k if k != "ordinal" else "block_ordinal") for i, k in enumerate(keys)], F.col("row_ordinal").alias("ordinal"), "table_ordinal", kind.alias("kind"), "cells", F.col("line").alias("text"))


def table_defects(rows: DataFrame, keys: tuple[str, ...] = ("path", "revision", "block_ordinal")) -> DataFrame:
    """Tables without a separator, or with more than one."""
    out = rows.groupBy(*keys, "table_ordinal").agg(F.count("*").alias("rows"), F.count_if(F.col("kind") == "separator").alias("separators"))
    return out.filter("separators <> 1").withColumn("defect", F.when(F.col("separators") == 0, "no-separator").otherwise("many-separators"))


def row_census(rows: DataFrame, scope: Column | None = None) -> DataFrame:
    """Rows by kind, over everything or within a scope."""
    own = rows if scope is None else rows.filter(scope)
    return own.agg(F.count("*").alias("lines"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("header", "content", "separator")])


def inline_statements(documents: DataFrame, text: str = "text") -> DataFrame:
    """Every {#ID} statement of a document: the id, and the text up to the line's end."""
    shape = r"\{#([A-Z][A-Z0-9-]*)\}[ \t]*([^\n]*)"
    ids, texts = F.regexp_extract_all(text, F.lit(shape), F.lit(1)), F.regexp_extract_all(text, F.lit(shape), F.lit(2))
    pairs = F.arrays_zip(ids.alias("id"), texts.alias("statement"))
    return documents.select("path", F.explode(pairs).alias("s")).select("path", F.col("s.id").alias("statement_id"), X.trim_space("s.statement").alias("statement"))


def records(documents: DataFrame, text: str = "text") -> DataFrame:
    """Front matter fields and body of a record; ``refused`` where its two identities differ."""
    front = F.regexp_extract(text, r"(?s)^﻿?---\r?\n(.*?)\r?\n---", 1)
    named = lambda k: F.nullif(X.trim_space(F.regexp_extract(front, rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    title = F.regexp_extract(text, r"(?m)^# +([A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-[0-9]+)", 1)
    tags = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(named("tags"), F.lit("")), r"[\[\]]", ""), ","), X.trim_space), lambda x: x != "")
    out = documents.select("path", named("id").alias("record_id"), named("status").alias("status"), named("version").alias("version"), tags.alias("tags"), F.nullif(title, F.lit("")).alias("title_id"), X.skip_front_matter(text).alias("body"))
    return out.withColumn("refused", F.col("record_id").isNotNull() & F.col("title_id").isNotNull() & (F.col("record_id") != F.col("title_id")))
