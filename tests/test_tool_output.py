"""Streams of tools: what is measured of their shapes, and each shape that is refused."""

import json

import pytest
from pyspark.sql import functions as F

from stratalens.sources import tool_output as O

RUN = "module string, root string, outcome string, code int, stdout string, stderr string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


FOUND = {"example.com/probe": {"printf": [{"posn": "/repo/main.go:6:14", "end": "/repo/main.go:6:16", "message": 'Printf  format %d has arg "x" {of}\n wrong type'}], "assign": [{"posn": "/repo/./a:b/c.go:10:2", "message": "self", "suggested_fixes": [{"edits": [{"new": "}"}]}]}]}}
VET = [
    ("measured", "exited", 0, "{}\n" + json.dumps(FOUND, indent=1) + json.dumps(FOUND), None, [("vet::assign", "self", "a:b/c.go", 10), ("vet::printf", 'Printf format %d has arg "x" {of} wrong type', "main.go", 6)], None),
    ("clean", "exited", 0, "{}\n{}\n", "", [], None),
    ("silent", "exited", 0, None, None, [], None),
    ("broken", "exited", 1, "", "# broken\nmain.go:4:2: undefined: thing", [], "failed"),
    ("rootless", "exited", 2, "", "go: cannot find GOROOT directory", [], "unavailable"),
    ("absent", "absent", None, None, None, [], "unavailable"),
    ("endless", "unfinished", None, "{}", None, [], "did-not-finish"),
    ("litter", "exited", 0, '{"p": {}} oops', None, [], "unreadable"),
    ("cut", "exited", 0, '{"p": {"printf": [', None, [], "unreadable"),
    ("package", "exited", 0, '{"p": []}', None, [], "unreadable"),
    ("analyzer", "exited", 0, '{"p": {"printf": {"posn": "a:1:1", "message": "m"}}}', None, [], "unreadable"),
    ("nameless", "exited", 0, '{"p": {"printf": [{"posn": "a.go:1:1"}]}}', None, [], "unreadable"),
    ("placeless", "exited", 0, '{"p": {"printf": [{"posn": "a.go:1", "message": "m"}]}}', None, [], "unreadable"),
]


def test_go_vet(spark):
    d = spark.createDataFrame([(m, "/repo/", o, c, out, err) for m, o, c, out, err, _, _ in VET], RUN)
    found, failures = O.go_vet(d)
    assert rows(found) == sorted([(m, *x) for m, *_, want, _ in VET for x in want], key=str)
    assert rows(failures) == sorted((m, f) for m, *_, f in VET if f)
    windows = spark.createDataFrame([("w", "C:\\repo", "exited", 0, json.dumps({"p": {"a": [{"posn": "C:\\repo\\x\\y.go:3:1", "message": "m"}]}}), "")], RUN)
    assert rows(O.go_vet(windows)[0]) == [("w", "vet::a", "m", "x/y.go", 3)]


def _line(**fields):
    return json.dumps({"type": "diagnostic", "fields": fields})


SUMMARY = json.dumps({"type": "summary", "fields": {"bans": {"errors": 0}, "licenses": {}, "sources": {}}})
DENY = [
    ("found", "exited", "not json\n" + _line(code="duplicate", severity="warning", message="two  of it", graphs=[{"Krate": {"name": "serde"}}, {"Krate": {"name": "x"}}]) + "\n" + _line(code="rejected", severity="error", message="m", graphs=[]) + "\n" + _line(severity="warning", message="no code") + "\n" + _line(code="c", severity="help", message="m") + "\n" + SUMMARY, [("warning", "duplicate", "serde", "two  of it"), ("error", "rejected", None, "m")], None),
    ("clean", "exited", SUMMARY, [], None),
    ("unsummed", "exited", _line(code="c", severity="error", message="m"), [], "no-summary"),
    ("partial", "exited", json.dumps({"type": "summary", "fields": {"bans": {}}}), [], "unaccounted: licenses, sources"),
    ("silent", "exited", " \n", [], "silent"),
    ("endless", "unfinished", SUMMARY, [], "did-not-finish"),
    ("absent", "absent", None, [], "unavailable"),
]


def test_cargo_deny(spark):
    d = spark.createDataFrame([(m, None, o, 1, "", err) for m, o, err, _, _ in DENY], RUN)
    found, failures = O.cargo_deny(d)
    assert rows(found) == sorted([(m, *x) for m, _, _, want, _ in DENY for x in want], key=str)
    assert rows(failures) == sorted((m, f) for m, *_, f in DENY if f)


def test_go_types(spark):
    value = {"kind": "value", "file": "/r/a.go", "line": 3, "column": 2, "is_error": True, "type": "error"}
    checked, other = {"kind": "checked", "file": "/r/a.go"}, {"kind": "checked", "file": "/r/b.go"}
    failed = {"kind": "failed", "package": "p", "files": ["/r/c.go"], "reason": "x"}
    cases = {
        "good": ([value, checked, other, failed], None),
        "unchecked": ([value, other], "unreadable"),
        "kindless": ([checked, {"file": "x"}], "unreadable"),
        "typeless": ([checked, {k: v for k, v in value.items() if k != "type"}], "unreadable"),
        "reasonless": ([{"kind": "failed", "package": "p", "files": []}], "unreadable"),
        "empty": ([], None),
        "twice": ([checked], "unreadable"),
    }
    d = spark.createDataFrame([(m, "/r", "exited", 0, "\n".join(map(json.dumps, lines)) + (" {}" if m == "twice" else "") + "\n", "") for m, (lines, _) in cases.items()] + [("text", "/r", "exited", 0, "hello", "")], RUN)
    found, files, failures = O.go_types(d)
    assert rows(found) == [("good", "a.go", 3, 2, True, "error")]
    assert rows(files) == [("good", "a.go"), ("good", "b.go")]
    assert rows(failures) == sorted([(m, f) for m, (_, f) in cases.items() if f] + [("text", "unreadable")])


def test_unexplained_errors(spark):
    values = spark.createDataFrame([("a.go", n, e) for n, e in ((1, True), (2, True), (4, True), (5, True), (6, False), (9, True))], "file string, line long, is_error boolean")
    text = "_ = f()\n_ = g() // closed already\n// the caller knows\n_ = h()\n_ = i() //\n_ = s()\n"
    sources = spark.createDataFrame([("a.go", text)], "path string, text string")
    assert [r["line_no"] for r in O.unexplained_errors(values, sources).orderBy("line_no").collect()] == [1, 5, 9]


@pytest.mark.parametrize("payload,want,refused", [("clone-on-copy\tsrc/lib.rs:7:16\nnested-lock\ta b.rs:1:1\n", [("copy-clones", "src/lib.rs:7:16"), ("nested-locks", "a b.rs:1:1")], []), ("", [], []), (None, [], []), ("clone-on-copy\tx\nother\ty\n", [], ["other\ty"]), ("clone-on-copy x", [], ["clone-on-copy x"])])
def test_compiler_findings(spark, payload, want, refused):
    d = spark.createDataFrame([("s", payload)], "subject string, payload string")
    found, odd = O.compiler_findings(d)
    assert rows(found.select("rule", "location")) == want and [r["refused"] for r in odd.collect()] == refused


def test_streams_are_read_without_python(spark):
    d = spark.createDataFrame([("m", "/r", "exited", 0, "{}", "")], RUN).filter(F.col("module") != "")
    for df in (*O.go_vet(d), *O.cargo_deny(d), *O.go_types(d)):
        assert "Python" not in df._jdf.queryExecution().toString()
