import random

import public_tokenizers as P
from tokenizers import Tokenizer

from stratalens.llm import token_counts as tc

PATH = str(P.path("word_bpe_49k.json"))


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def samples():
    r = random.Random(2)
    alphabet = "abcdefghi ABC .,!? 'sÉéßüĀİΣςσ\x1c\x1d\x85\xa0 ​　中文字한국어١٢３½ⅷ́é🙂\U00010400\n\t0123"
    out = ["", None, "plain text", "<|startoftext|>x<|endoftext|>", "<|endoftext|", "don't we're I'LL IT'S", "  \n ", "a" * 600, "ab" * 5000, "!" * 700, "naïve café " * 50, "ΟΔΟΣ ΣΑΣ", "ſ K Å ﬁ"]
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(600)]
    out += ["x" + chr(c) + "y" + chr(c) for c in [*range(1, 0x530), *range(0x2000, 0x2100), *range(0x1E00, 0x1F00)]]
    return out


def test_counts_equal_the_library():
    texts = samples()
    assert tc.Counter(PATH).counts(texts) == library(texts)


def test_bounded_table(monkeypatch):
    monkeypatch.setattr(tc, "KEPT", 50)
    texts = samples()[:200]
    assert tc.Counter(PATH).counts(texts) == library(texts)


def test_long_and_ragged_merges_agree():
    c, r = tc.Counter(PATH), random.Random(4)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 80))).encode() for _ in range(300)]
    assert c.merge_counts(words).tolist() == [c.merge_long(w) for w in words]


def test_query(spark, sf_dir):
    from stratalens.llm.queries import op7_token_counts

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r[0], len(r[1].encode()), n, n > 2048) for r, n in zip(rows, library([r[1] for r in rows])))
    assert sorted(map(tuple, op7_token_counts(spark, sf_dir).collect())) == want


def test_empty_and_clashing(spark):
    d = spark.createDataFrame([], "n_tokens int, text string, doc_id long")
    assert tc.count_tokens(d, PATH).count() == 0
    d = spark.createDataFrame([(1, None, None), (1, None, None)], "n_tokens int, text string, doc_id long")
    assert [tuple(r) for r in tc.count_tokens(d, PATH).collect()] == [(None, 0, 0, False)] * 2
