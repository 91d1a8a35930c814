"""License scan: base phrases, and an exact set-similarity join of text blocks and templates.

A text block is a sentence or line of a document, or a window of words of a sentence that is
wrapped over lines or holds an abbreviation such as "v. 2.0". A block meets a template if it
holds at least ``threshold`` of the template's distinct words. The windows of a wrapped
sentence overlap, so that every run of twice as many words as the longest template has stands
in one of them whole. The join is exact, by DataFrame operations alone:

* Template words are ordered by their document frequency over the whole table, rarest
  first (ties by word). Of a template with n words, of which m must be met, the n - m + 1
  first ones are its prefix: a block that meets it holds a prefix word (prefix filter).
* A document without any prefix word is done after one pass over its words; only others are
  cut into blocks. A block joins the index of prefix words (word, place, template).
* Length filter: a block of fewer than m distinct words is out. Positional filter: at the
  match of block place i and template place j, at most 1 + min(rest of the block's template
  words, rest of the template) words more can be met; fewer than m is out.
* What is left is verified by the size of the intersection.

The index is built from ``TEMPLATES``, a parameter; the word frequencies of the templates'
words are the only rows that reach the driver. Up to ``LITERAL_WORDS`` template words stand as
literals in the plan, and the tables made from them are broadcast. Beyond that (a whole license
list, say) words are joined with tables, broadcast or shuffled as Spark measures them, with the
same results. Nothing is grouped by a key that data can make hot: matches are grouped by
document row.

Defined cases: null text is empty; an empty text has no words, no labels and score 0; a
base phrase gives score 1 (its words all stand there); repeated rows are rows of their own;
extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from . import common as C

# Fixed phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "released into the public domain under cc0 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
]
LITERAL_WORDS = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Sentence ends before white space, and line feeds.
BLOCK_END = r"[.!?][\x09-\x0D\x20]+|\n"
# Where a wrapped sentence ends: a sentence end that is no abbreviation's, or a blank line. Each is
# one or more block ends too, so the pieces' blocks are those of the text.
WRAP_END = r"(?:(?<!\b(?:v|ver|vers|no|inc|ltd|co|corp))\.|[!?])[\x09-\x0D\x20]+|\n[\x09\x0B-\x0D\x20]*\n"


def needed(size: int, threshold: float) -> int:
    """Words that a block must share with a template of ``size`` words."""
    return max(1, math.ceil(round(threshold * size, 9)))


def _lower(column):
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def _words(column):
    return F.regexp_extract_all(column, F.lit(WORD), F.lit(0))


def scan(docs: DataFrame, *, id: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = 0.9, literal_words: int = LITERAL_WORDS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    sets = [(label, sorted(set(t.split()))) for label, t in templates]
    spark = docs.sparkSession
    vocabulary = sorted({w for _, ws in sets for w in ws})
    literal = len(vocabulary) <= literal_words
    lowered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id}`").alias("doc_id"), _lower(F.col(f"`{text}`")).alias("t"))

    # global order of the templates' words: document frequency over the whole table
    vocabulary_column = F.array(*[F.lit(w) for w in vocabulary if literal]).cast("array<string>")
    frequency = dict.fromkeys(vocabulary, 0)
    if vocabulary:
        if literal:
            seen = lowered.select(F.explode(F.array_intersect(_words(F.col("t")), vocabulary_column)).alias("w"))
        else:
            seen = lowered.select(F.explode(F.array_distinct(_words(F.col("t")))).alias("w")).join(spark.createDataFrame([(w,) for w in vocabulary], "w string"), "w")
        frequency |= {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency[w], w)))}

    index, members = [], []
    for k, (label, ws) in enumerate(sets):
        own = sorted(ws, key=order.get)
        m = needed(len(own), threshold)
        members.append((k, label, own, len(own), m))
        index += [(w, j, k, len(own), m) for j, w in enumerate(own[: len(own) - m + 1])]
    prefix_words = sorted({x[0] for x in index})

    # one pass over all texts: base phrases, and the blocks of documents with a prefix word
    joined = F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" "))
    base_regex = "(?:" + "|".join(p.rsplit(" ", 1)[0] for p in BASE) + ")"
    spot = f" {base_regex}(?= license )"
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    has = F.array_contains("ws", "license")
    pass_one = lowered.withColumn("ws", _words(F.col("t"))).withColumn("j", F.when(has, joined))
    prefix_column = F.array(*[F.lit(w) for w in prefix_words if literal]).cast("array<string>")
    pass_one = pass_one.select(
        "_row",
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.coalesce(F.regexp_count("j", F.lit(spot)), F.lit(0)).cast("long").alias("n_base"),
        F.when(F.regexp_like("j", F.lit(spot)), spaces(F.regexp_extract("j", f"(?s)^(.*?){spot}", 1))).alias("first_word"),
        F.when(F.regexp_like("j", F.lit(spot)), spaces(F.regexp_extract("j", f"(?s)^(.*){spot}", 1))).alias("last_word"),
        F.coalesce(F.filter(F.array(*[F.when(F.contains("j", F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]), lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("base"),
        F.when(F.arrays_overlap("ws", prefix_column) if literal else F.size("ws") > 0, F.split("t", WRAP_END)).alias("pieces"),
    )
    rows = C.write_table(pass_one)

    span = 2 * max([len(t.split()) for _, t in templates], default=1)
    met = _join(spark, rows, span, vocabulary_column if literal else None, index, members, order)
    per_row = met.groupBy("_row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    out = rows.drop("pieces").join(per_row, "_row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def _blocks(span: int):
    """Words of each block of ``pieces``: its lines and sentences, then windows of wrapped pieces."""
    lines = F.flatten(F.transform("pieces", lambda p: F.transform(F.split(p, BLOCK_END), _words)))
    wrapped = F.transform(F.filter("pieces", lambda p: F.regexp_like(p, F.lit(BLOCK_END))), _words)
    starts = lambda ws: F.sequence(F.lit(1), F.greatest(F.size(ws) - span, F.lit(1)), F.lit(span))
    return F.concat(lines, F.flatten(F.transform(wrapped, lambda ws: F.transform(starts(ws), lambda i: F.slice(ws, i, 2 * span)))))


def _join(spark, rows: DataFrame, span: int, vocabulary_column, index, members, order) -> DataFrame:
    """(_row, label, containment) of every block and template that meet."""
    index_df = spark.createDataFrame(index, "w string, j int, template int, size int, m int")
    member_df = spark.createDataFrame(members, "template int, label string, own array<string>, size int, m int")
    small = F.broadcast if vocabulary_column is not None else lambda df: df
    blocks = rows.filter(F.col("pieces").isNotNull()).select("_row", F.posexplode(_blocks(span)).alias("block", "b"))
    blocks = blocks.select("_row", "block", F.array_distinct("b").alias("ws"))
    # the block's template words, in the global order; its other words only count for its length
    blocks = blocks.withColumn("n", F.size("ws"))
    if vocabulary_column is not None:
        rank = F.create_map(*[F.lit(x) for w, i in order.items() for x in (w, i)]) if order else F.create_map().cast("map<string,int>")
        known = F.array_sort(F.transform(F.array_intersect("ws", vocabulary_column), lambda w: F.struct(rank[w].alias("o"), w.alias("w"))))
        blocks = blocks.select("_row", "block", "n", known.alias("own")).filter(F.size("own") > 0)
    else:
        ranks = spark.createDataFrame([(w, i) for w, i in order.items()], "w string, o int")
        words = blocks.select("_row", "block", "n", F.explode("ws").alias("w")).join(ranks, "w")
        blocks = words.groupBy("_row", "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("o", "w"))).alias("own"))
    tokens = blocks.select("*", F.posexplode("own").alias("i", "x")).select("_row", "block", "n", "own", "i", F.col("x.w").alias("w"))
    candidates = tokens.join(small(index_df), "w")
    candidates = candidates.filter(F.col("n") >= F.col("m"))
    rest = F.least(F.size("own") - F.col("i") - 1, F.col("size") - F.col("j") - 1)
    # places before the first common word hold none, so the first match decides for the pair
    first = F.struct("i", "j", "size", "m", rest.alias("rest"))
    pairs = candidates.groupBy("_row", "block", "template").agg(F.min(first).alias("f"), F.first("own").alias("own"))
    pairs = pairs.filter(1 + F.col("f.rest") >= F.col("f.m"))
    verified = pairs.join(small(member_df.withColumnRenamed("own", "words")), "template")
    shared = F.size(F.array_intersect(F.transform("own", lambda x: x["w"]), F.col("words")))
    return verified.withColumn("shared", shared).filter(F.col("shared") >= F.col("m")).select("_row", "label", (F.col("shared") / F.col("size")).alias("containment"))


def oracle(templates=TEMPLATES, threshold: float = 0.9) -> str:
    """DuckDB SQL of ``scan``, block by block without any filter.

    Its expressions cannot look back, so the point of an abbreviation is marked before pieces are cut.
    """
    span = 2 * max([len(t.split()) for _, t in templates], default=1)
    mark = r"\b(v|ver|vers|no|inc|ltd|co|corp)\."
    cut = r"[.!?][\x09-\x0D\x20]+|\n[\x09\x0B-\x0D\x20]*\n"
    values = ", ".join(f"('{label}', {sorted(set(t.split()))}, {needed(len(set(t.split())), threshold)})" for label, t in templates)
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    words = lambda c: f"regexp_extract_all({c}, '{WORD}')"
    places = " ".join(f"WHEN {' AND '.join(f'ws[i + {k}] = {chr(39)}{w}{chr(39)}' for k, w in enumerate(p.split()))} THEN '{label}'" for p, label in BASE.items())
    return f"""
WITH templates(label, tw, m) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {lower} AS t FROM documents),
w AS (SELECT rid, {words("t")} AS ws FROM d),
spots AS (SELECT rid, i, CASE {places} END AS label FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE list_contains(ws, 'license'))),
base AS (SELECT rid, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS found FROM spots WHERE label IS NOT NULL GROUP BY rid),
pieces AS (SELECT rid, unnest(regexp_split_to_array(regexp_replace(t, '{mark}', '\\1' || chr(1), 'g'), '{cut}')) AS p FROM d),
wrapped AS (SELECT rid, {words("p")} AS ws FROM pieces WHERE regexp_matches(p, '[.!?\x01][\x09-\x0D\x20]+|\n')),
blocks AS (SELECT rid, list_distinct({words("b")}) AS bw FROM (SELECT rid, unnest(regexp_split_to_array(t, '{BLOCK_END}')) AS b FROM d)
  UNION ALL SELECT rid, list_distinct(ws[i:i + {2 * span - 1}]) FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - {span}, 1) + 1, {span})) AS i FROM wrapped)),
met AS (SELECT rid, label, len(list_intersect(bw, tw)) / len(tw) AS c FROM blocks, templates WHERE len(list_intersect(bw, tw)) >= m),
own AS (SELECT rid, list(DISTINCT label) AS found, max(c) AS c FROM met GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.found, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.found, []), coalesce(own.found, [])))), ',') AS labels,
  CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM d JOIN w USING (rid) LEFT JOIN base USING (rid) LEFT JOIN own USING (rid)
"""
