"""Text rules: the eight that ``line_rules`` judges too are judged by their line as well."""

import pytest

from stratalens.operators import line_rules as L, rules as R

LINES = {
    "static-bounds-are-justified": "fn f<T: 'static>() {}",
    "lifetimes-follow-the-descriptive-naming-rule": "fn join<'a, 'input>(x: &'a str, y: &'input str) {",
    "sleep-based-synchronization": "    thread::sleep(d);",
    "zero-flake-policy": "#[retry(3)]",
    "prefer-macro-rules-over-procedural-macros": "#[proc_macro]",
    "boxed-closures-are-justified-and-off-hot-paths": "let b: Box<dyn Fn(u8)> = x;",
    "closure-bounds-are-minimal": "fn h(g: impl Fn(u8) + Send) {}",
    "named-fields-over-positional-variant-payloads": "    Line(Point, Point),",
}


def test_every_rule_of_line_rules_has_a_line():
    assert set(LINES) == set(L.RULES)


@pytest.mark.parametrize("language,found", [("rust", True), ("go", False)])
def test_rules_by_their_line(spark, language, found):
    d = spark.createDataFrame([(rule, language, "x\n" + line) for rule, line in LINES.items()], "path string, language string, text string")
    got = {(r["path"], r["rule"], r["line_no"]) for r in R.judge(d).collect() if r["path"] == r["rule"]}
    assert got == ({(rule, rule, 2) for rule in LINES} if found else set())
