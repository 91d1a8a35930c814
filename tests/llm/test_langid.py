import random
import zlib

from stratalens.llm import langid


def test_query_accuracy(spark):
    from stratalens.llm.queries import op9_language_id

    sf = "/root/testdata/sf0.01"
    lang = {r[0]: (r[1], r[2]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = op9_language_id(spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in held)
    assert right / len(held) > 0.97


def test_odd_rows(spark):
    rows = [(i, w * 20, l) for i, (w, l) in enumerate([("the of and ", "en"), ("der die und ", "de"), ("le la une ", "fr")] * 10)]
    rows += [(900, None, "en"), (901, "123 !!", "de"), (902, "½ Ⅷ ² ٣", None), (None, "the of and", "en"), (903, "the of and the", None), (903, "the of and the", None)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    model = langid.fit(d, ~langid.held_out())
    got = langid.predict(d, model).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i in (900, 901, 902):
        assert by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0
    assert [r["lang_pred"] for r in by[903] + by[None]] == ["en"] * 3
    kept = langid.keep_known(d)
    assert kept.columns == d.columns and kept.count() == len(rows) - 3
    nothing = langid.fit(d.limit(0), ~langid.held_out())
    assert {r["lang_pred"] for r in langid.predict(d, nothing).collect()} == {"und"}
    one = langid.fit(d.filter("lang = 'fr'"), ~langid.held_out())
    assert {r["lang_pred"] for r in langid.predict(d, one).collect()} == {"und", "fr"}


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n


def test_every_label_is_learned(spark):
    r, rows = random.Random(3), []
    for k in range(80):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 6))) for _ in range(12)]
        rows += [(1000 * k + i, " ".join(r.choice(words) for _ in range(60)), f"l{k:02}") for i in range(14 if k < 70 else 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(d, ~langid.held_out())
    assert model.languages == [f"l{k:02}" for k in range(80)]
    got = langid.predict(d, model).filter(langid.held_out()).collect()
    right = sum(x["lang_pred"] == x["lang"] for x in got) / len(got)
    rare = [x["lang_pred"] == x["lang"] for x in got if x["lang"] >= "l70"]
    print("held out, all and rare languages:", right, sum(rare) / len(rare))
    assert right > 0.9 and sum(rare) / len(rare) > 0.9
    few = langid.fit(d, ~langid.held_out(), per_language=1)
    assert few.languages == model.languages
