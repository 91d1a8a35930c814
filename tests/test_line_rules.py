"""Rules that look around a line, each against what it says of small sources."""

import pytest

from stratalens.operators import line_rules as L

SLEEP, FLAKY, STATIC, LIFETIME, MACRO, MINIMAL, BOXED, NAMED = L.RULES
CASES = [
    ("tests/lock.rs", "thread::sleep(Duration::from_millis(50));\n", [(SLEEP, 1)]),
    ("src/latch.rs", "thread::sleep(a);\n#[cfg(test)]\nmod tests {\n #[test]\n fn opens() {\n tokio::time::sleep (b).await;\n }\n}\n", [(SLEEP, 6)]),
    ("src/limiter.rs", "thread::sleep(backoff);\n", []),
    ("tests/worker.rs", "worker_thread::sleep(backoff);\n// thread::sleep(x)\n", []),
    ("tests/allowed.rs", "thread::sleep(debounce); // flakiness: allow the window under test\nthread::sleep(x); // sleep: allow\n", [(SLEEP, 2)]),
    ("worker_test.go", "func TestReady(t *testing.T) {\n\ttime.Sleep(50 * time.Millisecond)\n}\n", [(SLEEP, 2)]),
    ("worker.go", "func Ready() {\n\ttime.Sleep(50)\n}\n", []),
    ("src/counter.rs", "#[cfg(test)]\nmod tests {\n #[retry(3)]\n\n #[test]\n fn it() {}\n}\n", [(FLAKY, 3)]),
    ("src/bare.rs", "#[flaky]\nfn it() {}\n#[retry = 3]\npub fn(x)\n#[ retry_test ]\nfn a() {}", [(FLAKY, 1), (FLAKY, 3), (FLAKY, 5)]),
    ("src/other.rs", "#[derive(Debug)]\nstruct Counter;\n#[retry]\nstruct Policy;\n#[retry(3)] // flakiness: allow\nfn it() {}\n#[retrying]\nfn b() {}\n", []),
    ("src/bound.rs", "a\nb\nc\nfn f<T: 'static>(x: T) {}\nwhere T: Clone, U: 'static\nlet s = \": 'static\";\nx: 'statical\n", [(STATIC, 4), (STATIC, 5)]),
    ("src/said.rs", "// why: the pool outlives it\na\nb\nfn f<T: 'static>() {}\nfn g<T: 'static>() {}\n// ===\nfn h<T: Send + 'static>() {}", [(STATIC, 5), (STATIC, 7)]),
    ("src/life.rs", "fn join<'a, 'input>(x: &'a str, y: &'input str) {}\nfn one<'a>(x: &'a str) {}\nfn both<'left, 'right>() {}\nlet x: &'a str = f::<'b>();\nfn c(x: &'static str, y: &'a str) { 'b' }\nstruct S<'a, 'b>;\n", [(LIFETIME, 1), (LIFETIME, 6)]),
    ("src/macros.rs", "#[proc_macro]\npub fn a() {}\n#[proc_macro_derive(A)]\n#[proc_macro_attribute]\n// needs the syntax tree\n#[ proc_macro ]\n", [(MACRO, 1)]),
    ("src/close.rs", "x\ny\nfn f(g: impl Fn(u8) + Send) {}\npub fn h(g: impl FnMut(u8)) {}\nlet b: Box<dyn Fn(u8) + Send> = x;\nArc < dyn FnOnce()>\nfn plain(g: impl Fn(u8)) {}\nMyFn(x) + Send\nSandbox<dyn Fn()>\n", [(BOXED, 5), (BOXED, 6), (MINIMAL, 3), (MINIMAL, 4)]),
    ("tests/close.rs", "fn f(g: impl Fn(u8) + Send) {}\n", []),
    ("src/told.rs", "// sent to the pool\n\n\nfn f(g: impl Fn(u8) + Send) {}\nfn f(g: impl Fn(u8) + Send) {}\n", [(MINIMAL, 5)]),
    (
        "src/shape.rs",
        "enum Line\n{\n    Two(Point, Point),\n    One(Point),\n    Map(HashMap<K, V>),\n    Pair(Vec<(u8, u8), A>, u8)\n    // tuple-variant: allow: the order is the wire's\n    #[serde]\n    Kept(u8, u8),\n    // tuple-variant: allow\n    Empty(u8, u8),\n    Same(u8, u8), // tuple-variant: allow\n    Named { a: u8,\n        Not(u8, u8),\n    },\n    Last(u8, u8)\n}\nfn f() {\n    Call(a, b)\n}\n",
        [(NAMED, 3), (NAMED, 11), (NAMED, 16)],
    ),
    ("src/flat.rs", "pub enum E { A(u8, u8) }\nB(u8, u8)\n}\nenum F {\n C(u8, u8),\n}\nD(u8, u8)\n", [(NAMED, 5)]),
    ("src/empty.rs", "", []),
    ("src/null.rs", None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(p, "go" if p.endswith(".go") else "rust", t, 1) for p, t, _ in CASES]
    d = spark.createDataFrame([*rows, ("a.py", "python", "thread::sleep(1)", 1)], "path string, language string, text string, line int")
    out = {}
    for r in L.findings(d).collect():
        out.setdefault(r["path"], []).append((r["rule"], r["line_no"]))
    return out


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_case(found, case):
    assert sorted(found.get(case[0], [])) == sorted(case[2])


def test_only_texts_shuffle(spark):
    d = spark.createDataFrame([("a.rs", "rust", "enum A {\n}")], "path string, language string, text string")
    plan = L.findings(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
