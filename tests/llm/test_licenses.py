import re

import duckdb
import pandas as pd
import pytest
import regex

from stratalens.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, templates=licenses.TEMPLATES, threshold=0.9):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    spots = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    found, best = set(), 0.0
    span = 2 * max([len(t.split()) for _, t in templates], default=1)
    blocks = [WORD.findall(block) for block in re.split(licenses.BLOCK_END, low)]
    for piece in regex.split(licenses.WRAP_END, low):
        if re.search(licenses.BLOCK_END, piece):
            own = WORD.findall(piece)
            blocks += [own[i : i + 2 * span] for i in range(0, max(len(own) - span, 1), span)]
    for have in map(set, blocks):
        for label, t in templates:
            t = set(t.split())
            if len(t & have) >= licenses.needed(len(t), threshold):
                found.add(label)
                best = max(best, len(t & have) / len(t))
    base = {label for _, label in spots}
    at = [i for i, _ in spots]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if at else best)


TEXTS = [
    None,
    "",
    "Released under the MIT License.",
    "mit license mit license MIT-LICENSE apache license",
    "Licensed under CC BY-NC 4.0.",
    "licensed under cc by 4.0",
    "Licensed under CC BY-NC 4.\n0.",
    "xx This work is licensed under the GNU General Public License, version 3. More",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation",
    "mit license éMIT license",
    "released the under license",
    "word " * 20000 + "general public license " + "x " * 20000,
    "LİCENSE mit licenſe Kelvin",
    "license",
]


@pytest.mark.parametrize("threshold,literal_words", [(0.9, 2000), (0.5, 2000), (0.2, 2000), (0.9, 0), (0.2, 0)])
def test_against_brute_force(spark, threshold, literal_words):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[2]), (3, TEXTS[3])]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string").repartition(3)
    got = sorted(map(tuple, licenses.scan(d, threshold=threshold, literal_words=literal_words).collect()), key=str)
    assert got == sorted([(i, *brute(t, threshold=threshold)) for i, t in rows], key=str)


def test_many_templates(spark):
    # a list of templates whose words no plan could hold as literals; a text that ties two of them
    many = [(f"l{i}", " ".join(f"w{i}x{j}" for j in range(12))) for i in range(400)] + [("twin", "one two three four"), ("other", "four three two one")]
    rows = [(i, f"Intro. {many[i][1]}. Outro") for i in range(0, 400, 40)] + [(1000, "one, two: three four"), (1001, "w1x1 w2x2 w3x3")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(d, templates=many).collect()}
    assert got == {i: f"l{i}" for i in range(0, 400, 40)} | {1000: "other,twin", 1001: ""}


def test_empty_table_and_templates(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(d).count() == 0
    d = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    assert licenses.scan(d, templates=[]).first()["labels"] == "mit"


def test_query_on_table(spark, sf_dir):
    from stratalens.llm.queries import op3_license_scan

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = op3_license_scan(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted((r[0], *brute(r[1])) for r in rows)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())


def test_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy"
    rows = [
        ("mit", mit),
        ("mit", " * " + mit.replace("\n", "\r\n * ").replace("charge, to", "charge,\r\n * to")),
        ("bsd", "Copyright Foo Inc. All rights reserved.\n\n" + bsd),
        ("bsd", "word " * 500 + "\n" + "word " * 93 + bsd + "\n" + "word " * 500),
        ("mpl", mpl),
        ("mpl", mpl.replace(" of the", "\nof the").replace("v. ", "v.\n")),
        ("", bsd.replace("\n", "\n\n")),
        ("", mpl.replace(" the Mozilla", " it. The Mozilla").replace("v. 2", "2")),
        ("", bsd.replace("\n", "\n" + "word " * 200)),
    ]
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(d).collect()}
    assert [got[i] for i in range(len(rows))] == [label for label, _ in rows]
    # the SQL of the query and the plain model say the same of them
    documents = pd.DataFrame([(i, t) for i, (_, t) in enumerate(rows)], columns=["doc_id", "text"])  # noqa: F841
    sql = {r[0]: r[6] for r in duckdb.sql(licenses.oracle()).fetchall()}
    assert sql == got == {i: brute(t)[5] for i, (_, t) in enumerate(rows)}
