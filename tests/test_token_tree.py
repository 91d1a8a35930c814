"""Readings of Rust sources, each against what was counted by hand."""

import pytest

from stratalens.operators import token_tree as T


@pytest.fixture(scope="module")
def read(spark):
    """Rows of an operator for each of a list of sources, by one job."""

    def run(operator, texts):
        d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
        out = {str(i): [] for i in range(len(texts))}
        for r in operator(d).collect():
            out[r["path"]].append(r)
        return [out[str(i)] for i in range(len(texts))]

    return run


ITEMS = [
    (
        "mod outer { pub mod inner { pub fn deep() {} } }\nstruct Top;\nimpl Top { fn method(&self) {} }\n",
        [("Module", "outer", "Private", None), ("Module", "outer::inner", "Public", None), ("Function", "outer::inner::deep", "Public", 0), ("Struct", "Top", "Private", None), ("Implementation", "Top", "NotApplicable", None), ("Function", "Top::method", "Private", 1)],
    ),
    (
        "pub fn exported() {}\nfn hidden() {}\npub(crate) fn within() {}\npub(in some::place) fn nested() {}\ntrait Contract { fn required(&self); const N: u8; type Out; }\n",
        [("Function", "exported", "Public", 0), ("Function", "hidden", "Private", 0), ("Function", "within", "Restricted(crate)", 0), ("Function", "nested", "Restricted(in some::place)", 0), ("Trait", "Contract", "Private", None), ("Function", "Contract::required", "NotApplicable", 1), ("Constant", "Contract::N", "NotApplicable", None), ("TypeAlias", "Contract::Out", "NotApplicable", None)],
    ),
    ("use std::collections::{HashMap, BTreeSet as Ordered};\npub use std::fmt::*;\nuse a::b as _;\n", [("Use", "HashMap", "Private", None), ("Use", "Ordered", "Private", None), ("Use", "*", "Public", None), ("Use", "_", "Private", None)]),
    (
        # signatures over lines, generics with commas, a function type, a default body, a trailing comma
        "pub(super) async unsafe fn long<\n    'a,\n    K: Into<String>,\n    const N: usize,\n>(\n    self: &'a mut Map<K, Vec<(u8, u8)>>,\n    f: impl Fn(u8, u8) -> bool,\n    pairs: [(K, K); N],\n) -> Result<(), Box<dyn Error>>\nwhere\n    K: Ord,\n{\n    let c = |a: u8, b: u8| a + b;\n    fn inner(x: u8) {}\n}\n",
        [("Function", "long", "Restricted(super)", 3), ("Function", "inner", "Private", 1)],
    ),
    (
        # code in strings, raw strings, characters and nested comments is not code
        'const S: &str = "fn a() { \\" } {";\nstatic R: &str = r#"fn b() { " }"#;\nstatic mut Q: char = \'{\';\n/* fn c() { /* fn d() { */ } */\n// fn e() {\nfn f<\'a>(x: &\'a str) { let y = \'\\\'\'; let z = b"}}"; }\n',
        [("Constant", "S", "Private", None), ("Static", "R", "Private", None), ("Static", "Q", "Private", None), ("Function", "f", "Private", 1)],
    ),
    (
        "impl<'a, T: AsRef<[u8]>, const N: usize> fmt::Display for &'a Wrapper<T, N> where T: Clone { fn one() {} }\nimpl<F> Run for F where F: for<'x> Fn(&'x u8) {}\nimpl Pair for (u8, u8) { const A: u8 = 1; }\nimpl dyn Any {}\nunsafe impl Send for a::b::C {}\nimpl X for [Elem; 3] {}\n",
        [("Implementation", "Wrapper", "NotApplicable", None), ("Function", "Wrapper::one", "Private", 0), ("Implementation", "F", "NotApplicable", None), ("Implementation", "_", "NotApplicable", None), ("Constant", "_::A", "Private", None), ("Implementation", "_", "NotApplicable", None), ("Implementation", "a::b::C", "NotApplicable", None), ("Implementation", "Elem", "NotApplicable", None)],
    ),
    (
        'extern crate serde;\nextern "C" { fn puts(s: *const u8) -> i32; pub static N: u8; }\nextern {}\nmacro_rules! make { ($x:ident) => { fn $x() {} } }\nmake!(generated);\nlazy::statik! { fn hidden() {} }\npub extern "C" fn call(f: fn(u8) -> u8) { println!("fn no() {{"); local!{}; }\nunion U { a: u8 }\nenum E { A(u8), B { fnord: u8 } }\ntype A = fn(u8);\n',
        [("ExternCrate", "serde", "Private", None), ("ForeignModule", "C", "NotApplicable", None), ("Function", "puts", "Private", 1), ("Static", "N", "Public", None), ("ForeignModule", "extern", "NotApplicable", None), ("MacroDefinition", "make", "NotApplicable", None), ("MacroDefinition", "make", "NotApplicable", None), ("MacroDefinition", "lazy::statik", "NotApplicable", None), ("Function", "call", "Public", 1), ("Union", "U", "Private", None), ("Enum", "E", "Private", None), ("TypeAlias", "A", "Private", None)],
    ),
    ("﻿#![allow(unused)]\n#[derive(Clone)]\npub struct After;\n", [("Struct", "After", "Public", None)]),
    ("", []),
    ("\n// nothing\n//! only a comment\n", []),
    (None, []),
    ("pub fn r#type(r#fn: u8) {}\n", [("Function", "type", "Public", 1)]),
]


def test_items(read):
    got = read(lambda d: T.items(T.tree(d)), [t for t, _ in ITEMS])
    for (text, want), rows in zip(ITEMS, got):
        rows.sort(key=lambda r: r["ordinal"])
        assert [(r["kind"], r["qualified"], r["visibility"], r["inputs"]) for r in rows] == want, text
        assert [r["ordinal"] for r in rows] == list(range(len(want)))
    assert [r["receiver"] for r in got[0] if r["kind"] == "Function"] == [False, True]


def test_unexpanded_regions(read):
    text = '#[derive(Clone, Debug)]\npub struct Held;\nfn body() { println!("one"); vec![1, inner!(2)]; if !(a) {} }\ngenerated_items!();\n#[cfg(test)]\nmod m {}\n'
    assert [[r["n"] for r in rows] for rows in read(lambda d: T.unexpanded(T.tree(d)), [text])] == [[4]]


BROKEN = [
    ("fn unclosed( {", 1),
    ("struct S { field: }", 1),
    ("this is not rust at all", 1),
    ("fn a() {}\nfn f() { let x = ; }", 2),
    ("fn a() {}\n}\n", 2),
    ("fn a() { [1, 2) }", 1),
    ("use super::*;\n\n﻿//! documentation\npub fn hidden() {}\n", 3),
    ('fn a() {\n  "open\n}', 2),
    ("fn a() {}\n/* open /* twice */\n", 2),
]


def test_broken_sources_have_no_facts(read):
    texts = [t for t, _ in BROKEN]
    assert [[r["line"] for r in rows] for rows in read(T.broken, texts)] == [[n] for _, n in BROKEN]
    assert not any(read(lambda d: T.items(T.tree(d)), texts))
    fine = [t for t, _ in ITEMS] + [t for t, _ in COMPLEXITY] + [t for t, _ in ARMS]
    assert not any(read(T.broken, fine))


COMPLEXITY = [
    ("fn One() { let x = 1; drop(x); }", {"One": 1}),
    ("fn F(a: bool) { if a {} }", {"F": 2}),
    ("fn F(a: bool) { if a {} else if !a {} else {} }", {"F": 3}),
    ("fn F(a: bool) { while a {} }", {"F": 2}),
    ("fn F(v: Vec<u8>) { for _ in v {} }", {"F": 2}),
    ("fn F(a: u8) { match a { 0 => {}, 1 => {}, _ => {} } }", {"F": 3}),
    ("fn F(a: u8) { match a { n if n > 3 => {}, _ => {} } }", {"F": 3}),
    ("fn F(a: u8) { match a {} }", {"F": 1}),
    ("fn F(a: u8) { match a { 0 => match b { 1 => {} 2 => {} _ => {} }, x if p(x) || q => {} _ => { match c { _ => 1 } } } }", {"F": 7}),
    ("fn F(a: bool, b: bool) -> bool { a && b || a }", {"F": 3}),
    ("fn F(a: &&u8) { let f = || 1; let g = &&a; h(|| 2, &&3); return &&4; }", {"F": 1}),
    ("fn F(a: Option<u8>) -> Option<u8> { let b = a?; g(b)?; c[0]?.d.await?; Some(b) }", {"F": 5}),
    ("fn F<T: ?Sized>(a: Box<dyn A + ?Sized>) { unsafe { x }?; }", {"F": 2}),
    ("fn F(a: Option<u8>) { let Some(_b) = a else { return; }; let c = if d { 1 } else { 2 }; }", {"F": 3}),
    ("fn F(a: bool) { loop { if a { break; } } }", {"F": 2}),
    ("fn F(v: Vec<u8>) { let _ = v.iter().filter(|x| if **x > 1 { true } else { false }); }", {"F": 2}),
    ("fn Outer(a: bool) { fn Inner(b: bool) { if b {} if b {} } if a {} }", {"Outer": 2, "Outer::Inner": 3}),
    ("mod shapes {\n    struct Walker;\n    impl Walker {\n        fn Step(&self) {}\n    }\n}\n", {"shapes::Walker::Step": 1}),
    ("impl a::b::C { fn D() {} }\nimpl E for &F { fn G() { impl H for I { fn J() { for x in y {} } } } }", {"C::D": 1, "impl::G": 1, "impl::G::I::J": 2}),
    ("trait Judged { fn Bare(&self) -> u8; fn Bodied(&self) { if a {} } }", {"Judged::Bodied": 2}),
    ("const LIMIT: u8 = if true { 1 } else { 2 };\nfn After() {}\n", {"After": 1}),
    ('fn F() { assert!(a && b); let s = "if a && b"; #[cfg(any(a, b))] if matches!(x, A if y) {} }', {"F": 2}),
    ("fn F(a: for<'a> fn(&'a u8)) { 'outer: for x in y { while let Some(z) = w { continue 'outer; } } }", {"F": 3}),
]


def test_complexity(read):
    got = read(lambda d: T.complexity(T.tree(d)), [t for t, _ in COMPLEXITY])
    for (text, want), rows in zip(COMPLEXITY, got):
        assert {r["function"]: r["complexity"] for r in rows} == want, text
    assert [r["line"] for r in got[17]] == [4]


def _arm(arm: str) -> str:
    return f"fn Read() -> Result<u8, u8> {{\n match f() {{\n Ok(x) => Ok(x),\n {arm}\n }}\n}}\n"


ARMS = [
    (_arm("Err(applicability) => {}"), ["empty"]),
    (_arm("Err(applicability) => continue,"), ["bare-continue"]),
    (_arm("Err(applicability) => { continue 'outer; }"), ["bare-continue"]),
    (_arm("Err(applicability) => return,"), ["bare-return"]),
    (_arm("Err(applicability) => { { return; } }"), ["bare-return"]),
    (_arm("Err(applicability) => Ok(none(1, [2])),"), ["tail-ok"]),
    (_arm("Err(applicability) if applicability.soft() => { Ok::<u8, Vec<u8>>(0) }"), ["tail-ok"]),
    (_arm("std::result::Result::Err(ref mut applicability) => self::Ok(()),"), ["tail-ok"]),
    (_arm("#[cold] Err(mut applicability) => { Ok(1); }"), ["tail-ok"]),
    ("fn a() { match f() { Err(applicability) => Ok::<(), Vec<u8>>(()), Ok(x) => {} } }", ["tail-ok"]),
    ("fn a() { match f() { Ok(x) => {} Err(applicability) => Ok::<A, B>(c) } }", ["tail-ok"]),
    ("fn a() { match f() { Ok(x) => g::<A, B>(), Err(applicability) => Ok::<A, B>(c), } }", ["tail-ok"]),
    (_arm('Err(applicability) => return Err(Unread(source, applicability, "why")),'), []),
    (_arm("Err(applicability) => Ok(1)?,"), []),
    (_arm("Err(applicability) => Ok(1).map(f),"), []),
    (_arm("Err(applicability) => { log(); continue; }"), []),
    (_arm("Err(applicability) => { {} }"), []),
    (_arm("Err(error) => {}"), []),
    (_arm("Err(applicability) | Fatal(applicability) => {}"), []),
    (_arm("Fatal(_) | Err(applicability) => {}"), []),
    (_arm("Some(Err(applicability)) => {}"), []),
    (_arm("(Err(applicability), _) => {}"), []),
    (_arm("Err(applicability, other) => {}"), []),
    ("fn a() { if let Err(applicability) = f() {} }", []),
    ("fn a() { m!(match f() { Err(applicability) => {} }); }", []),
    ('fn a() { let s = "Err(applicability) => {}"; } // Err(applicability) => {}', []),
    ("const A: u8 = match f() { Err(applicability) => {} };", []),
    ("impl A { fn b() { fn c() {} let d = |x| match x { Err(applicability) => {} Ok(_) => { match y { Err(applicability) => return, } } }; } }", ["empty", "bare-return"]),
]


def test_unread_arms(read):
    got = read(lambda d: T.unread_arms(T.tree(d)), [t for t, _ in ARMS])
    for (text, want), rows in zip(ARMS, got):
        assert sorted(r["shape"] for r in rows) == sorted(want), text
    assert {(r["function"], r["line"], r["binding"]) for r in got[0]} == {("Read", 4, "applicability")}
    assert {r["function"] for r in got[-1]} == {"b"}


def test_findings_name_arms_and_broken_sources(spark):
    rows = [("a", ARMS[0][0], 7), ("b", "fn f( {", 8), ("c", "fn g() {}", 9)]
    d = spark.createDataFrame(rows, "path string, text string, pos int")
    assert sorted(map(tuple, T.unread_findings(d).collect())) == [("unread-reaches-finding", "a", "Read: empty"), ("unread-reaches-finding", "b", "unparseable")]


def test_tokens_of_a_source_do_not_shuffle(spark):
    d = spark.createDataFrame([("a", "fn f() {}")], "path string, text string")
    plan = T.tree(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    # adaptive execution merges small compressed texts into tasks that hold all their tokens
    from pyspark.sql import functions as F

    from stratalens import session

    monkeypatch.setattr(session, "TASK_CHARS", 50)
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    d = spark.createDataFrame([(f"p{i}", "fn f() { if a { b(); } }") for i in range(40)], "path string, text string")
    for rows in (T.tokens(d), T.tree(d)):
        held = rows.groupBy(F.spark_partition_id()).agg(F.countDistinct("path").alias("n")).collect()
        assert len(held) > 8 and max(r["n"] for r in held) < 10
    assert session.by_path(T.tree(d)).rdd.getNumPartitions() == 40 * 14 // 10 + 1


# ---- sources read alone --------------------------------------------------------------------------


def test_sources_read_alone_give_the_facts_counted_by_hand(read):
    for (text, want), rows in zip(ITEMS, read(T.source_items, [t for t, _ in ITEMS])):
        assert [(r["kind"], r["qualified"], r["visibility"], r["inputs"]) for r in rows] == want, text
        assert [r["ordinal"] for r in rows] == list(range(len(want)))
    for (text, want), rows in zip(COMPLEXITY, read(T.source_complexity, [t for t, _ in COMPLEXITY])):
        assert {r["function"]: r["complexity"] for r in rows} == want, text
    for (text, want), rows in zip(ARMS, read(T.source_arms, [t for t, _ in ARMS])):
        assert sorted(r["shape"] for r in rows) == sorted(want), text
    texts = [t for t, _ in BROKEN]
    for facts in (T.source_items, T.source_complexity, T.source_arms):
        assert not any(read(facts, texts))


def test_sources_read_alone_agree_with_rows_of_tokens(spark):
    # damaged and joined sources, with letters, numbers and spaces that only some engines take for such
    import random
    import re

    rnd = random.Random(11)
    base = [t for t, _ in ITEMS + COMPLEXITY + ARMS if t]
    pieces = ["é", "²", "Ⅷ", "\u0085", "\U00020000x", "::", "=>", "pub(", "pub(in a::b)", 'r#"', '"#', "/*", "*/", "{", ")", "match", "b'x'", "use a::{b, c};", "﻿", "macro_rules! m"]
    texts = []
    for _ in range(300):
        parts = [x for b in rnd.choices(base, k=2) for x in re.findall(r"\s+|\w+|[^\s\w]", b)]
        for _ in range(rnd.randrange(3)):
            parts[rnd.randrange(len(parts))] = rnd.choice([*pieces, "", ""])
        texts.append("".join(parts))
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    t = T.tree(d).persist()
    for alone, rows in ((T.source_items(d), T.items(t)), (T.source_complexity(d), T.complexity(t)), (T.source_arms(d), T.unread_arms(t))):
        assert alone.schema.simpleString() == rows.schema.simpleString()
        assert sorted(map(repr, alone.collect())) == sorted(map(repr, rows.collect()))
    t.unpersist()


def test_the_readings_shuffle_nothing(spark):
    from stratalens.plans import QUERIES

    for name in ("rust_items", "rust_complexity", "unread_arms", "unread_findings", "broken_sources"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        # one exchange at most: the one that deals a small table over the cores
        assert plan.count("MapInArrow") == 1 and plan.count("Window") == 0 and plan.count("Exchange") <= 1, name


def test_a_function_is_on_the_line_of_its_name(read):
    text = "fn\nNamed(\n    f: fn(u8) -> u8,\n    g: fn(u8),\n) {}\n"
    for facts in (T.source_complexity, lambda d: T.complexity(T.tree(d))):
        assert [(r["function"], r["line"]) for r in read(facts, [text])[0]] == [("Named", 2)]
