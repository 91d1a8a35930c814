"""Columns of the input that are named like an operator's own pass through, or are not read."""

import pytest

from stratalens.llm import collocations, exact_dedup, html_extract, langid, lexical, queries, token_counts

NAMES = ["_html", "_text", "_row", "row", "doc", "0", "1", "id", "n", "sha", "keep", "slice", "text_", "url", "lang_", "score_", "part", "block", "words", "shard", "leaf", "item", "terms", "rank_"]


@pytest.fixture(scope="module")
def docs(spark):
    text = [("alpha beta gamma delta " * 20, "en"), ("eins zwei drei vier " * 20, "de")] * 20
    rows = [(i, t, lang, *[f"{c}{i}" for c in NAMES]) for i, (t, lang) in enumerate(text)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in NAMES))


def passed(df):
    return all(r[c] == f"{c}{r['doc_id']}" for r in df.collect() for c in NAMES)


def test_columns_pass_through(docs):
    assert passed(html_extract.main_text(docs.withColumnRenamed("text", "html")))
    assert passed(token_counts.count_tokens(docs, queries.tokenizer_path("word_bpe_49k.json")))
    model = langid.fit(docs, ~langid.held_out())
    assert passed(langid.predict(docs, model)) and passed(langid.keep_known(docs)) and passed(exact_dedup.drop_duplicates(docs))


def test_columns_are_not_read(docs, spark):
    plain = docs.select("doc_id", "text", "lang")
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    for run in (exact_dedup.assign, lambda d: lexical.search(d, items), lambda d: collocations.mine(d, min_count=5)):
        assert sorted(map(tuple, run(docs).collect())) == sorted(map(tuple, run(plain).collect()))
