"""Queries of the rules that look around a line.

A source is derived from each document: every line becomes a fragment of code that holds it in a
comment. What each fragment violates was counted by hand and stands beside it; the SQL adds up these
counts and reads no code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import line_rules as L
from .registry import query
from .store import store

_PAD = "let a = 1;\n" * 3
# (text, violations (line, rule, where)); where: rust, src (Rust sources that are no tests), go
# (Go tests), scope (Rust from the first test attribute on, and all of a test source)
FRAGMENTS = [
    (_PAD + "    thread::sleep(d);\n    time.Sleep(1)\n// @\n", [(4, "sleep-based-synchronization", "scope"), (5, "sleep-based-synchronization", "go")]),
    (_PAD + "#[retry(3)]\n#[test]\nfn it() {}\n// @\n#[retry]\nstruct Policy;\n", [(4, "zero-flake-policy", "rust")]),
    (_PAD + "fn f<T: 'static>() {}\n// said: @\n\nfn g<T: 'static>() {}\n", [(4, "static-bounds-are-justified", "rust")]),
    (_PAD + "fn join<'a, 'input>(x: &'a str) {}\nfn one<'a>(x: &'a str) {}\n// @\n", [(4, "lifetimes-follow-the-descriptive-naming-rule", "rust")]),
    (_PAD + "fn h(g: impl Fn(u8) + Send) {}\nlet b: Box<dyn Fn(u8)> = x;\n// why: @\nlet c: Rc<dyn FnOnce()> = x;\n", [(4, "closure-bounds-are-minimal", "src"), (5, "boxed-closures-are-justified-and-off-hot-paths", "src")]),
    (_PAD + "#[proc_macro]\nenum Line {\n    Two(Point, Map<K, V>),\n    One(Map<K, V>),\n    // tuple-variant: allow: @\n    Kept(u8, u8),\n}\n", [(4, "prefer-macro-rules-over-procedural-macros", "rust"), (6, "named-fields-over-positional-variant-payloads", "rust")]),
]
_TEST_FRAGMENT, _TEST_LINE = 1, 5
_VALUES = ", ".join(f"({k}, {line}, '{rule}', '{where}')" for k, f in enumerate(FRAGMENTS) for line, rule, where in f[1])
_SIZES = "[" + ", ".join(str(f[0].count("\n")) for f in FRAGMENTS) + "]"
_PATH = "CASE doc_id % 3 WHEN 0 THEN 'src/' || doc_id || '.rs' WHEN 1 THEN 'tests/' || doc_id || '.rs' ELSE doc_id || '_test.go' END"
CONTEXT_SQL = f"""
WITH placed AS (SELECT *, 1 + coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line
  FROM (SELECT doc_id, {_PATH} AS path, i, (doc_id * 5 + i) % {len(FRAGMENTS)} AS k, ({_SIZES})[((doc_id * 5 + i) % {len(FRAGMENTS)} + 1)::INT] AS size
    FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs))),
scope AS (SELECT doc_id, min(first_line + {_TEST_LINE - 1}) AS begins FROM placed WHERE k = {_TEST_FRAGMENT} GROUP BY 1),
found AS (SELECT doc_id, rule, path, first_line + line - 1 AS n, place FROM placed JOIN (VALUES {_VALUES}) f(k, line, rule, place) USING (k))
SELECT rule, path, n::BIGINT AS line_no FROM found LEFT JOIN scope USING (doc_id)
WHERE CASE place WHEN 'go' THEN doc_id % 3 = 2 WHEN 'rust' THEN doc_id % 3 <> 2 WHEN 'src' THEN doc_id % 3 = 0 ELSE doc_id % 3 = 1 OR doc_id % 3 = 0 AND n >= coalesce(begins, n + 1) END"""


def sources(spark, sf):
    d = F.col("doc_id")
    fragment = lambda i: F.get(F.array(*[F.lit(f[0]) for f in FRAGMENTS]), ((d * 5 + i + 1) % len(FRAGMENTS)).cast("int"))
    name = d.cast("string")
    path = F.when(d % 3 == 0, F.concat(F.lit("src/"), name, F.lit(".rs"))).when(d % 3 == 1, F.concat(F.lit("tests/"), name, F.lit(".rs"))).otherwise(F.concat(name, F.lit("_test.go")))
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.replace(fragment(i), F.lit("@"), x)), "")
    return store(spark, sf).docs.select(path.alias("path"), F.when(d % 3 == 2, "go").otherwise("rust").alias("language"), text.alias("text"))


@query("context_rule_findings", CONTEXT_SQL, covers=" ".join(L.RULES))
def context_rule_findings(spark, sf):
    return L.findings(sources(spark, sf))
