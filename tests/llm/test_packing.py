import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from stratalens.llm import packing
from stratalens.llm.queries import byte_bpe_50k


def library(texts):
    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(pieces, tokens, capacity=1024):
    """tokens: ids by document. Every id in one piece; sequences gapless; little padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(tokens)
    for d, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(tokens[d])
            ids = np.array(tokens[d][at : at + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(ids.tobytes())
            at += p["length"]
        assert at == len(tokens[d])
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("seed", range(5))
def test_plan(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 5, 100, 700, 1023, 1024, 1025, 5000, r.randint(1, 900)]) for _ in range(r.randint(1, 300))]
    pieces = packing.plan(lengths, 1024)
    rows = [{"doc_id": d, "start": s, "length": n, "sequence_id": q, "offset": o, "doc_tokens": lengths[d], "ids_crc32": zlib.crc32(np.arange(s, s + n).astype("<u4").tobytes())} for d, s, n, q, o in pieces]
    assert check(rows, {d: list(range(n)) for d, n in enumerate(lengths)}) < 1024


def test_costs_are_balanced():
    lengths = [600, 300, 300, 100] * 20
    pieces = packing.plan(lengths, 1024)
    cost = defaultdict(float)
    for d, _, n, q, _ in pieces:
        cost[q] += packing.cost(n, 1.0, 1 / 1024)
    assert max(cost.values()) < 1.5 * (sum(cost.values()) / len(cost))


def test_query(spark, sf_dir):
    from stratalens.llm.queries import op6_packing

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    tokens = dict(zip((r[0] for r in rows), library([r[1] for r in rows])))
    pieces = [r.asDict() for r in op6_packing(spark, sf_dir).collect()]
    assert check(pieces, tokens) < 1024 * 8


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "a<|endoftext|>b"), (4, "x" * 50_000), (5, " " * 3000 + "y"), (6, "é中🙂 " * 2000), (7, "tail")]
    d = spark.createDataFrame([(i, t, i) for i, t in texts], "doc_id long, text string, start int").repartition(2)
    tokens = dict(zip((i for i, _ in texts), library([t for _, t in texts])))
    pieces = packing.pack(d, byte_bpe_50k, window_tokens=3000, with_ids=True).collect()
    check([r.asDict() for r in pieces], tokens)
    for p in pieces:
        assert p["ids"] == tokens[p["doc_id"]][p["start"] : p["start"] + p["length"]]
    assert packing.pack(d.limit(0), byte_bpe_50k).count() == 0
    twice = spark.createDataFrame([(None, "same"), (None, "same")], "doc_id long, text string")
    assert packing.pack(twice, byte_bpe_50k).count() == 2
