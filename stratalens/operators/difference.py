"""Differences between two versions of a document: blocks, fields, statements, relations."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as X
from .graph import settle


def _claim(table: pa.Table) -> pa.Table:
    """Blocks of one normal form in one document, claimed in the order of the later version.

    Each later block takes the earliest free one of its own text, else the earliest free one of the
    form, which may be what a later block would have taken as its own.
    """
    rows = sorted(zip(table.column("ordinal").to_pylist(), table.column("later").to_pylist(), table.column("h").to_pylist()))
    before, free, own = [(o, h) for o, later, h in rows if not later], {}, 0
    for i, (_, h) in enumerate(before):
        free.setdefault(h, deque()).append(i)
    taken, out = [False] * len(before), []
    for to, later, h in rows:
        if not later:
            continue
        same = free.get(h, ())
        while same and taken[same[0]]:
            same.popleft()
        while own < len(before) and taken[own]:
            own += 1
        if same:
            i, change = same[0], "same" if before[same[0]][0] == to else "moved"
        elif own < len(before):
            i, change = own, "reflowed"
        else:
            continue
        taken[i] = True
        out.append((before[i][0], to, change))
    n = len(out)
    kept = [table.column(c).take(pa.array([0] * n, pa.int64())) for c in table.column_names if c.startswith("key_")]
    columns = [pa.array([r[k] for r in out], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
    return pa.table([*kept, *columns], names=[*[c for c in table.column_names if c.startswith("key_")], "a_ordinal", "b_ordinal", "change"])


def block_diff(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Each block of two versions: same, moved, reflowed, reworded, removed or added.

    Later blocks claim earlier ones in their order: the earliest free one of equal text, else the
    earliest free one of equal normal form; what is left pairs by ordinal. Only blocks of one normal
    form in one document compete. Where they are all of one text, their occurrences pair by an
    equi-join; forms of several texts are claimed one by one, each by itself.
    """
    key = list(keys)
    a = before.select(*key, F.col("ordinal").cast("long").alias("ordinal"), F.col("content_hash").alias("h"), F.col("normalized_hash").alias("nh"))
    b = after.select(*key, F.col("ordinal").cast("long").alias("ordinal"), F.col("content_hash").alias("h"), F.col("normalized_hash").alias("nh"))
    both = settle(a.withColumn("later", F.lit(False)).unionByName(b.withColumn("later", F.lit(True))))  # each side's texts are read once
    shape = both.groupBy(*key, "nh").agg((F.min("h") != F.max("h")).alias("mixed"))
    both = both.join(shape, [*key, "nh"])
    plain = both.filter("not mixed").withColumn("rn", F.row_number().over(W.partitionBy(*key, "nh", "later").orderBy("ordinal")))
    side = lambda later, name: plain.filter(F.col("later") == later).select(*key, "nh", "rn", F.col("ordinal").alias(name))
    exact = side(False, "a_ordinal").join(side(True, "b_ordinal"), [*key, "nh", "rn"])
    exact = exact.select(*key, "a_ordinal", "b_ordinal", F.when(F.col("a_ordinal") == F.col("b_ordinal"), "same").otherwise("moved").alias("change"))
    named = both.filter("mixed").select(*[F.col(k).alias(f"key_{k}") for k in key], "nh", "ordinal", "later", "h")
    schema = ", ".join([*[f"`key_{k}` {before.schema[k].dataType.simpleString()}" for k in key], "a_ordinal long, b_ordinal long, change string"])
    claimed = named.groupBy(*[f"key_{k}" for k in key], "nh").applyInArrow(_claim, schema).select(*[F.col(f"key_{k}").alias(k) for k in key], "a_ordinal", "b_ordinal", "change")
    held = settle(exact.unionByName(claimed))
    left = lambda later, name: both.filter(F.col("later") == later).select(*key, F.col("ordinal").alias(name)).join(held.select(*key, name), [*key, name], "left_anti")
    gone = left(False, "a_ordinal").select(*key, F.col("a_ordinal").alias("ordinal"), F.lit(True).alias("was"))
    new = left(True, "b_ordinal").select(*key, F.col("b_ordinal").alias("ordinal"), F.lit(True).alias("now"))
    rest = gone.join(new, [*key, "ordinal"], "full_outer")
    at = lambda there, name: F.when(F.col(there), F.col("ordinal")).alias(name)
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("reworded")
    return held.unionByName(rest.select(*key, at("was", "a_ordinal"), at("now", "b_ordinal"), change.alias("change")))


def field_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields whose values differ, null-safe, one row each."""
    a = before.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    b = after.select(key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("was"), F.col(f"b_{f}").alias("now")) for f in fields])
    out = a.join(b, key).select(key, F.explode(pairs).alias("x")).select(key, "x.field", "x.was", "x.now")
    return out.filter(~F.col("was").eqNullSafe(F.col("now")))


def relation_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    key = ["from_node", "type", "to_node"]
    gone = before.select(*key).distinct().join(after, key, "left_anti").withColumn("change", F.lit("removed"))
    new = after.select(*key).distinct().join(before, key, "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new)


def locate_statements(statements: DataFrame, blocks: DataFrame) -> DataFrame:
    """held, moved, gone or unlocatable, from where each statement's text stood and stands.

    statements: (statement_id, path, ordinal, text). The text is looked for as a block of its
    own, by the hash of its normal form; no containment scan of all pairs.
    """
    s = statements.withColumn("nh", X.normalised_hash("text"))
    # the text's own place first, then whether it stands anywhere: a repeated text's places never meet
    own = blocks.select("path", "ordinal", F.col("normalized_hash").alias("nh")).distinct().withColumn("home", F.lit(True))
    known = blocks.select(F.col("normalized_hash").alias("nh")).distinct().withColumn("known", F.lit(True))
    out = s.join(own, ["path", "ordinal", "nh"], "left").join(known, "nh", "left")
    verdict = F.when(F.coalesce(X.normalise("text"), F.lit("")) == "", "unlocatable").when(F.col("known").isNull(), "gone").when(F.col("home"), "held").otherwise("moved")
    return out.select("statement_id", verdict.alias("location"))
