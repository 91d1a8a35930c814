"""Text rules that look around a line: explanations above it, test scope, enum bodies.

Lines are rows, dealt by path before they are split, so that they do not shuffle. What stands around
a line comes from windows over its file, each in the time of one sort: an explanation is a comment
in the three lines before, a test scope begins at the first test attribute, an enum's body is the
lines at its depth until the braces close again.

Defined cases: null texts have no lines; a last line feed ends no further line; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import path_tasks
from .rules import RUST_RETRY_ATTRIBUTES, RUST_SLEEP_CALLS, _any, code_of, masked

WINDOW_LINES = 3
GO_SLEEP_CALLS = ["time.Sleep"]
RULES = [
    "sleep-based-synchronization",
    "zero-flake-policy",
    "static-bounds-are-justified",
    "lifetimes-follow-the-descriptive-naming-rule",
    "prefer-macro-rules-over-procedural-macros",
    "closure-bounds-are-minimal",
    "boxed-closures-are-justified-and-off-hot-paths",
    "named-fields-over-positional-variant-payloads",
]
TEST_SOURCE = r"^(?:tests|examples)/|/tests?/|_tests?\.rs$|(?:^|/)tests\.rs$|(?:^|/)test_support\.rs$"
_EDGE = "(?<![A-Za-z0-9_])"
_CLOSURE = r"(?:Fn|FnMut|FnOnce)\("
_COMMENT = r"^(?:(?!//).)*//\s*"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(sources: DataFrame, tasks: int | None = None) -> DataFrame:
    """(path, language, line_no, line) of Rust and Go sources, in order."""
    dealt = sources.filter(F.col("language").isin("rust", "go")).select("path", "language", F.regexp_replace("text", "\n$", "").alias("text")).repartition(tasks or path_tasks(sources, "text"), "path")
    cut = dealt.select("path", "language", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return cut.select("path", "language", (F.col("p") + 1).cast("long").alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def _file():
    return W.partitionBy("path").orderBy("line_no")


def _before():
    return _file().rowsBetween(W.unboundedPreceding, -1)


def _enum_bodies(d: DataFrame, tasks: int) -> DataFrame:
    """Adds whether a line stands right inside an enum's braces.

    Braces are counted as they are written, but not on comment and attribute lines; the count never
    falls below zero. A header in the body of another enum opens nothing.
    """
    read = ~F.col("trimmed").rlike(r"^(?://|#\[)")
    count = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    opened, closed = F.when(read, count("{")).otherwise(0), F.when(read, count("}")).otherwise(0)
    so_far = _file().rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("opened", opened).withColumn("net", F.sum(opened - closed).over(so_far))
    d = d.withColumn("after", F.col("net") - F.least(F.lit(0), F.min("net").over(so_far)))
    d = d.withColumn("depth", F.coalesce(F.lag("after").over(_file()), F.lit(0)))
    ahead = W.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("brace", F.last(F.when(F.col("opened") > 0, F.struct("line_no", "depth")), ignorenulls=True).over(ahead))
    heads = d.filter(read & F.col("line").rlike(_EDGE + r"enum\s+[\p{L}\p{N}_]")).select("path", F.col("line_no").alias("head"), F.col("brace.line_no").alias("open_line"), F.col("brace.depth").alias("open_depth")).filter("open_line is not null")
    ends = heads.join(d.select("path", F.col("line_no").alias("n"), "after"), "path").filter("n >= open_line and after <= open_depth").groupBy("path", "head").agg(F.min("n").alias("end"))
    heads = heads.join(ends, ["path", "head"], "left").withColumn("end", F.coalesce("end", F.lit(1 << 40)))
    inner = F.max("end").over(W.partitionBy("path").orderBy("head").rowsBetween(W.unboundedPreceding, -1))
    heads = heads.withColumn("inner", F.coalesce(inner >= F.col("head"), F.lit(False))).filter("not inner")
    marked = d.join(heads.select("path", F.col("open_line").alias("line_no"), F.struct(F.col("open_line").alias("at"), "open_depth", "end").alias("opens")), ["path", "line_no"], "left").repartition(tasks, "path")
    last = F.last("opens", ignorenulls=True).over(_before())
    return marked.withColumn("body", last).withColumn("in_enum", F.coalesce((F.col("line_no") <= F.col("body.end")) & (F.col("depth") == F.col("body.open_depth") + 1), F.lit(False))).drop("opens", "body", "net", "opened", "brace")


def findings(sources: DataFrame) -> DataFrame:
    """(rule, path, line_no) of the rules that look around a line."""
    tasks = path_tasks(sources, "text")
    d = lines(sources, tasks)
    line, rust = F.col("line"), F.col("language") == "rust"
    d = d.withColumn("trimmed", _trim(line)).withColumn("code", code_of("line")).withColumn("masked", masked(code_of("line")))
    trimmed, code, bare = F.col("trimmed"), F.col("code"), F.col("masked")
    d = d.withColumn("explained", F.coalesce(F.max(line.rlike(r"^\s*//.*[0-9A-Za-z]")).over(_file().rowsBetween(-WINDOW_LINES, -1)), F.lit(False)))
    go_test = F.col("path").rlike(r"_test\.go$")
    test_source = F.col("path").rlike(TEST_SOURCE)
    starts = trimmed.startswith("#[cfg(test)]") | (trimmed == "#[test]")
    scope = F.coalesce(F.max(starts).over(_file().rowsBetween(W.unboundedPreceding, 0)), F.lit(False))
    d = d.withColumn("in_scope", test_source | go_test | scope)
    below = W.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, -1)
    passes = (trimmed == "") | trimmed.startswith("#[")
    d = d.withColumn("decorates", F.coalesce(F.last(F.when(~passes, trimmed.rlike(r"fn[ (]")), ignorenulls=True).over(below), F.lit(False)))
    marker = _COMMENT + "tuple-variant: allow"
    skipped = (trimmed == "") | trimmed.rlike(r"^(?://|/\*|\*|#\[)")
    above = F.last(F.when(line.rlike(marker) | ~skipped, line.rlike(marker + r"\s*:?\s*\S")), ignorenulls=True).over(_before())
    d = d.withColumn("named", line.rlike(marker) | F.coalesce(above, F.lit(False)))
    d = _enum_bodies(d, tasks)

    allowed = line.rlike(_COMMENT + "flakiness: allow")
    call = lambda names: code.rlike(_EDGE + _any(names) + r"\s*\(")
    sleeps = (rust & call(RUST_SLEEP_CALLS)) | (go_test & call(GO_SLEEP_CALLS))
    lifetimes = F.array_except(F.regexp_extract_all(bare, F.lit(r"'([A-Za-z_][A-Za-z0-9_]*+)(?!')"), F.lit(1)), F.array(F.lit("static"), F.lit("_")))
    boxed = code.rlike(rf"{_EDGE}(?:Box|Arc|Rc)\s*<\s*dyn\s*{_CLOSURE}")
    widened = code.rlike(r"\+\s*(?:Send|Sync|'static)(?![A-Za-z0-9_])") | (F.contains(code, F.lit("pub fn ")) & F.contains(code, F.lit(":")))
    closure = rust & ~test_source & ~F.col("explained") & code.rlike(_EDGE + _CLOSURE)
    payload = F.regexp_extract(trimmed, r"^[\p{L}\p{N}_]+\s*\(([^)]*)\)\s*,?$", 1)
    for _ in range(4):  # what stands in brackets separates no members
        payload = F.regexp_replace(payload, r"[<(\[][^<>()\[\]]*[>)\]]", "")
    tests = {
        "sleep-based-synchronization": sleeps & F.col("in_scope") & ~allowed,
        "zero-flake-policy": rust & trimmed.rlike(rf"^#\[\s*{_any(RUST_RETRY_ATTRIBUTES)}\s*(?:[(=].*)?\]$") & ~allowed & F.col("decorates"),
        "static-bounds-are-justified": rust & ~F.col("explained") & (bare.rlike(r"[:+]\s*'static(?![A-Za-z0-9_])") | (bare.rlike(r"\bwhere\b") & F.contains(bare, F.lit("'static")))),
        "lifetimes-follow-the-descriptive-naming-rule": rust & bare.rlike(r"\b(?:struct|enum|trait|impl|fn|type)\b") & (F.size(lifetimes) > 1) & F.exists(lifetimes, lambda x: x.rlike("^[a-z]$")),
        "prefer-macro-rules-over-procedural-macros": rust & ~F.col("explained") & code.rlike(r"#\[\s*proc_macro\s*\]"),
        "closure-bounds-are-minimal": closure & ~boxed & widened,
        "boxed-closures-are-justified-and-off-hot-paths": closure & boxed,
        "named-fields-over-positional-variant-payloads": rust & F.col("in_enum") & ~trimmed.rlike(r"^(?://|#\[)") & F.contains(payload, F.lit(",")) & ~F.col("named"),
    }
    hits = F.filter(F.array(*[F.when(tests[r], F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return d.select(F.explode(hits).alias("rule"), "path", "line_no")
