import corpus_pipeline
from tests.llm.test_decontaminate import WORD, lower
from tests.llm.test_packing import check, library
from tests.llm.test_simhash import plain_groups

from stratalens.llm import langid


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"] for r in langid.predict(docs, langid.fit(docs, ~langid.held_out())).filter("lang_pred <> 'und' and not ambiguous").collect()}
    ids = sorted(known)
    first = {d for i, (d, group) in enumerate(zip(ids, plain_groups([rows[d] for d in ids]))) if i == group}
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = WORD.findall(lower(r["text"]))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    clean = set()
    for d in first:
        w = WORD.findall(lower(rows[d]))
        if not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)):
            clean.add(d)
    tokens = dict(zip(sorted(clean), library([rows[d] for d in sorted(clean)])))
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert clean and len(first) < len(known) and len(clean) < len(first)
    check(pieces, tokens)


def test_stages_keep_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "12 34", None, None, 5), (-3, "word " * 30_000, "en", None, None), (-3, "word " * 30_000, "en", None, None)], docs.schema)
    left = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf_dir)
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and None not in ids and not {-1, -2} & set(ids)
