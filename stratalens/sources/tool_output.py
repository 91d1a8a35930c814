"""What analysis tools print, as diagnostics, and as failures where a run is no answer.

A run is a row (module, root, outcome, code, stdout, stderr) of a tool in one module; ``outcome`` is
exited, absent (could not be started) or unfinished (timed out or was ended). Streams are read by
JSON and string functions, in the task that holds the run. A run either answers, perhaps with nothing, or
has one failure; a changed shape of output is a failure, never an empty answer.

Defined cases: null streams are empty; repeated diagnostics count once; white space in messages
is one space; paths have forward slashes and are relative to the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _json_object(depth: int) -> str:
    inner = f"|{_json_object(depth - 1)}" if depth else ""
    return rf'\{{[^{{}}"]*+(?:(?:{_STRING}{inner})[^{{}}"]*+)*+\}}'


# A stream of objects, one after the other, each over as many lines as it likes.
JSON_OBJECT = _json_object(8)
VET = "map<string,map<string,array<struct<posn:string,message:string>>>>"
DENY_CHECKS = ["bans", "licenses", "sources"]
SEVERITIES = ["warning", "error"]


def _text(c) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _is_object(line: Column) -> Column:
    """Whether a line is one JSON object and nothing else, by its brackets."""
    return line.rlike(rf"^\s*{JSON_OBJECT}\s*$")


def _one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def _relative(path: Column, root: str = "root") -> Column:
    slashed = lambda c: F.array_join(F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "."), "/")
    own, base = slashed(path), F.concat(F.regexp_replace(slashed(_text(root)), "/+$", ""), F.lit("/"))
    return F.when(F.startswith(own, base), F.substr(own, F.length(base) + 1)).otherwise(own)


def _did_not_answer() -> Column:
    """The failure of a run that did not end with 0, else null."""
    said = F.contains(_text("stderr"), F.lit("cannot find GOROOT"))
    return F.when(F.col("outcome") == "absent", "unavailable").when(F.coalesce(F.col("outcome"), F.lit("")) != "exited", "did-not-finish").when(said & (F.col("code") != 0), "unavailable").when(F.coalesce(F.col("code") != 0, F.lit(True)), "failed")


def _split(read: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(diagnostics, failures) of runs (module, failure, found)."""
    found = read.filter("failure is null").select("module", F.explode("found").alias("d")).select("module", *[f"d.{c}" for c in columns]).distinct()
    return found, read.filter("failure is not null").select("module", "failure")


def go_vet(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((module, lint, message, file, line), (module, failure)) of runs of ``go vet -json``.

    The tool prints an object a package: package, analyzer, list of reports with a position and a
    message. Its exit code does not tell findings from none.
    """
    rest = F.regexp_replace(_text("stdout"), JSON_OBJECT, "")
    values = F.transform(F.regexp_extract_all(_text("stdout"), F.lit(JSON_OBJECT), F.lit(0)), lambda v: F.from_json(v, VET))
    # an analyzer without a list, or a package without an object, reads as null
    lists = F.flatten(F.transform("values", lambda v: F.flatten(F.transform(F.map_values(v), lambda a: F.map_entries(a)))))
    d = runs.select("module", "root", _did_not_answer().alias("failure"), (F.regexp_replace(rest, r"\s", "") != "").alias("litter"), values.alias("values"))
    d = d.withColumn("lists", lists)
    shape = r"^([\s\S]+):([0-9]{1,9}):([0-9]{1,9})$"
    reports = F.flatten(F.transform("lists", lambda e: F.transform(e["value"], lambda r: F.struct(F.concat(F.lit("vet::"), e["key"]).alias("lint"), _one_space(r["message"]).alias("message"), _relative(F.regexp_extract(r["posn"], shape, 1)).alias("file"), F.regexp_extract(r["posn"], shape, 2).try_cast("long").alias("line")))))
    d = d.withColumn("found", reports)
    unread = F.col("litter") | F.exists("values", lambda v: v.isNull()) | F.col("lists").isNull() | F.exists("lists", lambda e: e["value"].isNull()) | F.col("found").isNull() | F.exists("found", lambda r: r["message"].isNull() | r["line"].isNull())
    d = d.withColumn("failure", F.coalesce("failure", F.when(F.coalesce(unread, F.lit(True)), "unreadable")))
    return _split(d, ["lint", "message", "file", "line"])


def cargo_deny(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((module, severity, code, target, message), (module, failure)) of runs of ``cargo deny --format json``.

    The tool prints a JSON object a line to stderr; lines that are none are passed over. A run whose
    summary does not account for every check has not finished, whatever it found.
    """
    lines = F.filter(F.split(_text("stderr"), "\n"), _is_object)
    get = lambda x, path: F.get_json_object(x, path)
    of = lambda kind: F.filter("lines", lambda x: get(x, "$.type") == kind)
    summary = F.get(of("summary"), F.lit(0))
    missing = F.array_compact(F.array(*[F.when(get(summary, f"$.fields.{c}").isNull(), F.lit(c)) for c in DENY_CHECKS]))
    d = runs.withColumn("lines", lines)
    ended = F.when(F.col("outcome") == "absent", "unavailable").when(F.coalesce(F.col("outcome"), F.lit("")) != "exited", "did-not-finish").when(~_text("stderr").rlike(r"\S"), "silent")
    failure = ended.when(summary.isNull(), "no-summary").when(F.size(missing) > 0, F.concat(F.lit("unaccounted: "), F.array_join(missing, ", ")))
    found = F.filter(
        F.transform(of("diagnostic"), lambda x: F.struct(get(x, "$.fields.severity").alias("severity"), get(x, "$.fields.code").alias("code"), F.nullif(get(x, "$.fields.graphs[0].Krate.name"), F.lit("")).alias("target"), get(x, "$.fields.message").alias("message"))),
        lambda v: v["severity"].isin(SEVERITIES) & v["code"].isNotNull() & v["message"].isNotNull(),
    )
    return _split(d.select("module", failure.alias("failure"), found.alias("found")), ["severity", "code", "target", "message"])


def go_types(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((module, file, line, column, is_error, type), (module, file), (module, failure)) of a type checker's helper.

    It prints an object a line: a file that was checked, a value given to the blank identifier, or a
    package that failed. A checked file without values is an answer; a value in a file that is not
    checked is none.
    """
    lines = F.filter(F.split(_text("stdout"), "\n"), lambda x: x.rlike(r"\S"))
    shape = "kind string, file string, line long, column long, is_error boolean, type string, package string, reason string, files array<string>"
    d = runs.withColumn("said", F.transform(lines, lambda x: F.when(_is_object(x), F.from_json(x, shape))))
    of = lambda kind: F.filter("said", lambda v: v["kind"] == kind)
    checked = F.transform(of("checked"), lambda v: _relative(v["file"]))
    values = F.transform(of("value"), lambda v: F.struct(_relative(v["file"]).alias("file"), v["line"].alias("line"), v["column"].alias("column"), v["is_error"].alias("is_error"), v["type"].alias("type")))
    d = d.withColumn("checked", checked).withColumn("found", values)
    unread = F.exists("said", lambda v: v.isNull() | ~F.coalesce(v["kind"].isin("checked", "value", "failed"), F.lit(False)) | ((v["kind"] == "failed") & (v["package"].isNull() | v["files"].isNull() | v["reason"].isNull())))
    unread = unread | F.exists("checked", lambda f: f.isNull()) | F.exists("found", lambda v: v["file"].isNull() | v["line"].isNull() | v["column"].isNull() | v["is_error"].isNull() | v["type"].isNull())
    # by hash, once a run: a filter on the failure would look through all files for each value
    unread = unread | (F.size(F.array_except(F.transform("found", lambda v: v["file"]), "checked")) > 0)
    d = d.withColumn("failure", F.coalesce(_did_not_answer(), F.when(F.coalesce(unread, F.lit(True)), "unreadable")))
    found, failures = _split(d, ["file", "line", "column", "is_error", "type"])
    return found, d.filter("failure is null").select("module", F.explode("checked").alias("file")).distinct(), failures


COMPILER_TAGS = {"clone-on-copy": "copy-clones", "nested-lock": "nested-locks"}


def compiler_findings(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rule, subject, location), (subject, refused line)) of compiler facts (subject, payload).

    A payload is a line a finding: its tag, a tab, its place. A payload with any other line is
    refused whole; an empty one is clean.
    """
    lines = F.filter(F.split(F.regexp_replace(_text("payload"), "\n$", ""), "\n"), lambda x: x != "")
    tag = lambda x: F.substring_index(x, "\t", 1)
    known = lambda x: F.contains(x, F.lit("\t")) & tag(x).isin(list(COMPILER_TAGS))
    d = payloads.select("subject", lines.alias("lines")).withColumn("odd", F.get(F.filter("lines", lambda x: ~known(x)), F.lit(0)))
    rule = F.create_map(*[F.lit(x) for pair in COMPILER_TAGS.items() for x in pair])
    found = d.filter("odd is null").select("subject", F.explode("lines").alias("x"))
    found = found.select(rule[tag(F.col("x"))].alias("rule"), "subject", F.substr("x", F.instr("x", "\t") + 1).alias("location"))
    return found, d.filter("odd is not null").select("subject", F.col("odd").alias("refused"))


def unexplained_errors(values: DataFrame, sources: DataFrame) -> DataFrame:
    """(rule, path, line_no) of discarded errors (file, line, is_error) without a comment beside them.

    A comment at the end of the line, or one that is the line before, explains.
    """
    lines = sources.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "line_text")).select("file", (F.col("p") + 1).cast("long").alias("line"), "line_text")
    errors = values.filter("is_error").select("file", "line").distinct()
    here = errors.join(lines, ["file", "line"], "left").withColumnRenamed("line_text", "own")
    before = lines.select("file", (F.col("line") + 1).alias("line"), F.col("line_text").alias("above"))
    met = here.join(before, ["file", "line"], "left")
    explained = F.coalesce(F.col("own").rlike(r"//.*\w"), F.lit(False)) | F.coalesce(F.col("above").rlike(r"^\s*//.*\w"), F.lit(False))
    return met.filter(~explained).select(F.lit("a-discarded-error-is-explained").alias("rule"), F.col("file").alias("path"), F.col("line").alias("line_no"))
