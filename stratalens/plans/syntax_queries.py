"""Queries of the Rust readings: items, complexity, unread arms, and sources that are broken.

A program is derived from each document: every line becomes a fragment of code that holds the
line in a comment or a raw string. What each fragment declares was counted by hand and stands
beside it; the SQL adds up these counts and reads no code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import token_tree as S
from .registry import query
from .store import store

# (text, items (line, kind, name, visibility, inputs, receiver), functions (line, name, complexity), arms (line, function, shape))
FRAGMENTS = [
    (
        '/* @ /* fn hidden() { */ " */\npub(crate) fn Read_Fact<K: Into<String>, V>(\n    facts: &mut Map<K, Vec<(V, u8)>>,\n    key: K,\n) -> Result<V, Box<dyn Error>> {\n    match facts.Require(key) {\n        Ok(fact) => Ok(fact),\n        Err(applicability) => { return; }\n    }\n}\n',
        [(2, "Function", "Read_Fact", "Restricted(crate)", 2, False)],
        [(2, "Read_Fact", 2)],
        [(8, "Read_Fact", "bare-return")],
    ),
    (
        'mod shapes {\n    pub struct Walker { steps: Vec<u8> }\n    impl Walker {\n        pub fn Step(&self, by: u8) -> u8 { if by > 1 && self.ok() { by } else { 0 } }\n        fn Log(&self) { print(r##"@ } fn no() {"##); }\n    }\n}\n',
        [(1, "Module", "shapes", "Private", None, None), (2, "Struct", "shapes::Walker", "Public", None, None), (3, "Implementation", "shapes::Walker", "NotApplicable", None, None), (4, "Function", "shapes::Walker::Step", "Public", 2, True), (5, "Function", "shapes::Walker::Log", "Private", 1, True)],
        [(4, "shapes::Walker::Step", 3), (5, "shapes::Walker::Log", 1)],
        [],
    ),
    (
        "use std::collections::{HashMap, BTreeSet as Ordered};\nconst LIMIT: usize = 4;\npub static mut TOTAL: [u8; 2] = [1, 2]; // @\n",
        [(1, "Use", "HashMap", "Private", None, None), (1, "Use", "Ordered", "Private", None, None), (2, "Constant", "LIMIT", "Private", None, None), (3, "Static", "TOTAL", "Public", None, None)],
        [],
        [],
    ),
    (
        "fn Poll(rows: &[Row]) -> Result<u8, u8> {\n    'outer: for row in rows {\n        match row.read() {\n            Err(applicability) if row.soft() => continue 'outer,\n            Err(other) => return Err(other),\n            Ok(x) if x > 1 || x == 0 => {}\n            _ => { let Some(y) = x else { break; }; y?; }\n        }\n    }\n    /* @ */\n    Ok(1)\n}\n",
        [(1, "Function", "Poll", "Private", 1, False)],
        [(1, "Poll", 10)],
        [(4, "Poll", "bare-continue")],
    ),
    (
        'pub trait Judged<T>: Sized where T: ?Sized {\n    const N: usize;\n    type Out;\n    fn Bare(&self, f: impl Fn(T, u8) -> bool);\n    fn Bodied(self: Box<Self>) { while let Some(x) = f() { fn Inner(a: u8, b: u8,) { if a {} } } }\n}\n// "@\n',
        [(1, "Trait", "Judged", "Public", None, None), (2, "Constant", "Judged::N", "NotApplicable", None, None), (3, "TypeAlias", "Judged::Out", "NotApplicable", None, None), (4, "Function", "Judged::Bare", "NotApplicable", 2, True), (5, "Function", "Judged::Bodied", "NotApplicable", 1, True), (5, "Function", "Judged::Inner", "Private", 2, False)],
        [(5, "Judged::Bodied", 2), (5, "Judged::Bodied::Inner", 2)],
        [],
    ),
    (
        "impl<'a, T: AsRef<[u8]>> fmt::Display for &'a Table<T> {\n    fn fmt(&self) -> Result<(), Error> {\n        match self.rows() { Err(applicability) => Ok::<(), Vec<u8>>(()), Ok(x) => { x.map(|y| y || !y) } }\n    }\n}\nextern \"C\" { pub fn puts(s: *const u8) -> i32; }\n/* @ */\n",
        [(1, "Implementation", "Table", "NotApplicable", None, None), (2, "Function", "Table::fmt", "Private", 1, True), (6, "ForeignModule", "C", "NotApplicable", None, None), (6, "Function", "puts", "Public", 1, False)],
        [(2, "impl::fmt", 3)],
        [(3, "fmt", "tail-ok")],
    ),
    (
        "macro_rules! make { ($x:ident) => { fn $x() { if a {} } } }\nmake!(generated);\n#[derive(Clone)]\npub enum Kind { A(u8), B { fnord: u8 } }\npub type Alias = fn(u8, u8) -> u8; // @\n",
        [(1, "MacroDefinition", "make", "NotApplicable", None, None), (2, "MacroDefinition", "make", "NotApplicable", None, None), (4, "Enum", "Kind", "Public", None, None), (5, "TypeAlias", "Alias", "Public", None, None)],
        [],
        [],
    ),
    (
        'pub(in a::b) async unsafe fn Quiet(source: &str, facts: &dyn Reader) {\n    let s = "} fn f( { \\" ";\n    let c = \'{\';\n    let r = match facts.get() { Ok(_) => 1, #[cold] Err(applicability) => {} };\n    log!("@ if && ||", match x { Err(applicability) => {} });\n}\n',
        [(1, "Function", "Quiet", "Restricted(in a::b)", 2, False)],
        [(1, "Quiet", 2)],
        [(4, "Quiet", "empty")],
    ),
]

_ITEMS = ", ".join(f"({k}, {n}, {line}, '{kind}', '{name}', '{visibility}', {'NULL' if inputs is None else inputs}, {'NULL' if receiver is None else receiver})" for k, f in enumerate(FRAGMENTS) for n, (line, kind, name, visibility, inputs, receiver) in enumerate(f[1]))
_FUNCTIONS = ", ".join(f"({k}, {line}, '{name}', {n})" for k, f in enumerate(FRAGMENTS) for line, name, n in f[2])
_ARMS = ", ".join(f"({k}, {line}, '{name}', '{shape}')" for k, f in enumerate(FRAGMENTS) for line, name, shape in f[3])
_LINES = "[" + ", ".join(str(f[0].count("\n")) for f in FRAGMENTS) + "]"
# where each fragment of a program starts; programs of one fragment have an open bracket at their end
PLACED_SQL = f"""
SELECT *, 1 + coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line, count(*) OVER (PARTITION BY doc_id) = 1 AS is_broken
FROM (SELECT doc_id, path, i, (doc_id * 7 + i) % {len(FRAGMENTS)} AS k, ({_LINES})[((doc_id * 7 + i) % {len(FRAGMENTS)} + 1)::INT] AS size
  FROM (SELECT doc_id, path, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs))"""


def programs(spark, sf):
    """(path, text): a Rust program for each document."""
    d = F.col("doc_id")
    fragment = lambda i: F.get(F.array(*[F.lit(f[0]) for f in FRAGMENTS]), ((d * 7 + i + 1) % len(FRAGMENTS)).cast("int"))
    lines = F.split("text", "\n")
    text = F.array_join(F.transform(lines, lambda x, i: F.replace(fragment(i), F.lit("@"), F.translate(x, '"*', "'+"))), "")
    return store(spark, sf).docs.select("path", F.concat(text, F.when(F.size(lines) == 1, "fn unclosed( {").otherwise("")).alias("text"))


@query("rust_items", f"SELECT path, (row_number() OVER (PARTITION BY doc_id ORDER BY i, n) - 1)::BIGINT AS ordinal, (first_line + line - 1)::BIGINT AS line, kind, qualified, visibility, inputs::BIGINT AS inputs, receiver FROM ({PLACED_SQL}) JOIN (VALUES {_ITEMS}) f(k, n, line, kind, qualified, visibility, inputs, receiver) USING (k) WHERE NOT is_broken", covers="18")
def rust_items(spark, sf):
    return S.source_items(programs(spark, sf)).drop("name")


@query("rust_complexity", f"SELECT path, function, (first_line + line - 1)::BIGINT AS line, complexity::BIGINT AS complexity FROM ({PLACED_SQL}) JOIN (VALUES {_FUNCTIONS}) f(k, line, function, complexity) USING (k) WHERE NOT is_broken", covers="27 cyclomatic-complexity")
def rust_complexity(spark, sf):
    return S.source_complexity(programs(spark, sf))


@query("unread_arms", f"SELECT path, function, (first_line + line - 1)::BIGINT AS line, 'applicability' AS binding, shape FROM ({PLACED_SQL}) JOIN (VALUES {_ARMS}) f(k, line, function, shape) USING (k) WHERE NOT is_broken", covers="28")
def unread_arms(spark, sf):
    return S.source_arms(programs(spark, sf))


@query("unread_findings", f"SELECT 'unread-reaches-finding' AS rule, path, site FROM (SELECT path, function || ': ' || shape AS site FROM ({PLACED_SQL}) JOIN (VALUES {_ARMS}) f(k, line, function, shape) USING (k) WHERE NOT is_broken UNION ALL SELECT path, 'unparseable' FROM ({PLACED_SQL}) WHERE is_broken)", covers="unread-reaches-finding")
def unread_findings(spark, sf):
    return S.unread_findings(programs(spark, sf))


@query("broken_sources", f"SELECT path, (first_line + size)::BIGINT AS line FROM ({PLACED_SQL}) WHERE is_broken", covers="18")
def broken_sources(spark, sf):
    return S.broken(programs(spark, sf))
