"""The queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, collocations, common, decontaminate as dc, exact_dedup, html_extract, langid, lbl, lexical, licenses, packing, simhash, token_counts, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _spread(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return common.spread(_read(spark, sf_dir, table).select(*columns), columns[0])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents", "doc_id", "text")
    found = dc.decontaminate(docs, _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("dc_n_words").alias("n_words"),
        F.col("dc_n_hit").alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"),
        (F.col("dc_n_hit") > 0).alias("contaminated"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_spread(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_spread(spark, sf_dir, "documents", "doc_id", "text"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_spread(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents", "doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = ann.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))
    return found.select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_bpe_50k():
    """The packing encoder; runs where it is called, so each worker reads its own files."""
    import public_tokenizers

    return packing.byte_bpe(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_spread(spark, sf_dir, "documents", "doc_id", "text"), byte_bpe_50k)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("word_bpe_49k.json"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.lm_scores(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs, ~langid.held_out())
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(_spread(spark, sf_dir, "documents", "doc_id", "text"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_spread(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_spread(spark, sf_dir, "documents", "text", "lang"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_license_scan": op3_license_scan,
    "op4_html_extraction": op4_html_extraction,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scores": op8_lm_scores,
    "op9_language_id": op9_language_id,
    "op10_nearest": op10_nearest,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

# A SHA-1 in hexadecimal as 32 letters of base32: its bits in groups of five.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(0, 5), lambda k: substr(bits, (5 * i + k + 1)::INT, 1)::INT), lambda a, b: 2 * a + b), 1)), '')"""
_BITS = "array_to_string(list_transform(string_split(sha1(payload), ''), lambda c: substr(right('000' || bin(instr('0123456789abcdef', c) - 1), 4), 1, 4)), '')"

# What the main text of the given pages is: every one marks it by an article element, which the
# query itself does not rely on alone.
_BLOCK = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;', chr(39), 'g'), '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"""

ORACLES = {
    "op4_html_extraction": f"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS bs FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(bs, lambda b: {_BLOCK}), lambda x: x <> ''), chr(10)) AS text FROM a)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
""",
    "op2_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, payload, {_BITS} AS bits,
  max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM d
""",
    "op3_license_scan": licenses.oracle(),
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_collocations": collocations.ORACLE,
    "op1_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("text")} AS ws FROM documents),
bw AS (SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, unnest(CASE
    WHEN len(ws) >= 10 THEN list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM bw),
lens AS (SELECT DISTINCT len(string_split(g, ' ')) AS n FROM iw),
spot AS (SELECT rid, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens),
dw AS (SELECT spot.rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM spot JOIN d ON d.rid = spot.rid),
hit AS (SELECT rid, i, n, item_id FROM dw JOIN iw USING (g)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
""",
}
