"""Queries of the readers of tool output.

A run of each tool is derived from the documents of a source: what the tool would print about them,
in its own format, with the documents' own lines as messages. The SQL states the diagnostics from the
documents and reads no stream.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tool_output as O
from .registry import query
from .store import store

_FIRST = "regexp_replace(string_split(text, chr(10))[1], '[^\\x20-\\x7E]', '?', 'g')"
# how a source's run ends: by its number
_ENDS = "regexp_extract(source, '[0-9]+$')::BIGINT % 7"


def _docs(spark, sf):
    first = F.regexp_replace(F.get(F.split("text", "\n"), F.lit(0)), r"[^\x20-\x7E]", "?")
    end = F.regexp_extract("source", "[0-9]+$", 0).cast("long") % 7
    return store(spark, sf).docs.select("doc_id", "path", "source", first.alias("first"), end.alias("end"))


def _runs(lines, stream: str, other: str):
    """A run for each source: its lines in order, and how it ended."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "\n")
    runs = lines.groupBy(F.col("source").alias("module")).agg(text.alias("said"), F.first("end").alias("end"))
    outcome = F.when(F.col("end") == 1, "absent").when(F.col("end") == 2, "unfinished").otherwise("exited")
    cut = F.when((F.col("end") == 4) & F.lit(stream == "stdout"), F.concat("said", F.lit(' {"cut": '))).otherwise(F.col("said"))
    return runs.select("module", F.lit("/repo").alias("root"), outcome.alias("outcome"), F.when(F.col("end") == 3, 1).otherwise(0).alias("code"), cut.alias(stream), F.lit("").alias(other), "end")


def vet_runs(spark, sf):
    d = _docs(spark, sf)
    number = F.col("doc_id")
    report = F.array(F.struct(F.concat(F.lit("/repo/./"), "path", F.lit(":"), (number % 90 + 1).cast("string"), F.lit(":3")).alias("posn"), F.concat(F.lit("said  "), "first").alias("message"), F.array(F.struct(F.lit("}").alias("new"))).alias("suggested_fixes")))
    line = F.when(number % 3 == 0, "{}").otherwise(F.to_json(F.struct(F.create_map(F.concat(F.lit("example.com/"), "path"), F.create_map(F.when(number % 2 == 0, "printf").otherwise("assign"), report)).alias("m"))))
    # the object of the package alone, over several lines
    line = F.when(number % 3 == 0, line).otherwise(F.regexp_replace(F.regexp_replace(line, r'^\{"m":(.*)\}$', "$1"), r'^\{', "{\n\t"))
    return _runs(d.withColumn("line", line), "stdout", "stderr")


@query("vet_diagnostics", f"SELECT DISTINCT source AS module, CASE WHEN doc_id % 2 = 0 THEN 'vet::printf' ELSE 'vet::assign' END AS lint, trim(regexp_replace('said  ' || {_FIRST}, '\\s+', ' ', 'g')) AS message, path AS file, doc_id % 90 + 1 AS line FROM docs WHERE doc_id % 3 <> 0 AND {_ENDS} NOT IN (1, 2, 3, 4)", covers="25 lint-diagnostics")
def vet_diagnostics(spark, sf):
    return O.go_vet(vet_runs(spark, sf))[0]


@query("vet_failures", f"SELECT DISTINCT source AS module, CASE {_ENDS} WHEN 1 THEN 'unavailable' WHEN 2 THEN 'did-not-finish' WHEN 3 THEN 'failed' ELSE 'unreadable' END AS failure FROM docs WHERE {_ENDS} IN (1, 2, 3, 4)", covers="25")
def vet_failures(spark, sf):
    return O.go_vet(vet_runs(spark, sf))[1]


def deny_runs(spark, sf):
    d = _docs(spark, sf)
    number = F.col("doc_id")
    severity = F.get(F.array(*[F.lit(x) for x in ("warning", "error", "help")]), (number % 3).cast("int"))
    graphs = F.array(F.struct(F.struct(F.when(number % 4 == 0, "").otherwise(F.col("path")).alias("name")).alias("Krate")))
    fields = F.struct(F.when(number % 5 != 0, F.concat(F.lit("code-"), (number % 8).cast("string"))).alias("code"), severity.alias("severity"), F.col("first").alias("message"), graphs.alias("graphs"))
    line = F.to_json(F.struct(F.lit("diagnostic").alias("type"), fields.alias("fields")))
    runs = _runs(d.withColumn("line", line), "stderr", "stdout")
    summary = F.when(F.col("end") == 5, '{"type":"summary","fields":{"bans":{},"sources":{}}}').when(F.col("end") == 6, "not json").otherwise('{"type":"summary","fields":{"bans":{},"licenses":{},"sources":{}}}')
    return runs.withColumn("stderr", F.concat_ws("\n", "stderr", summary))


@query("deny_violations", f"SELECT DISTINCT source AS module, ['warning', 'error'][(doc_id % 3 + 1)::INT] AS severity, 'code-' || (doc_id % 8) AS code, CASE WHEN doc_id % 4 <> 0 THEN path END AS target, {_FIRST} AS message FROM docs WHERE doc_id % 3 < 2 AND doc_id % 5 <> 0 AND {_ENDS} NOT IN (1, 2, 5, 6)", covers="26 dependency-policy")
def deny_violations(spark, sf):
    return O.cargo_deny(deny_runs(spark, sf))[0]


@query("deny_failures", f"SELECT DISTINCT source AS module, CASE {_ENDS} WHEN 1 THEN 'unavailable' WHEN 2 THEN 'did-not-finish' WHEN 5 THEN 'unaccounted: licenses' ELSE 'no-summary' END AS failure FROM docs WHERE {_ENDS} IN (1, 2, 5, 6)", covers="26")
def deny_failures(spark, sf):
    return O.cargo_deny(deny_runs(spark, sf))[1]


def types_runs(spark, sf):
    d = _docs(spark, sf)
    number = F.col("doc_id")
    file = F.concat(F.lit("/repo/"), "path")
    checked = F.to_json(F.struct(F.lit("checked").alias("kind"), file.alias("file")))
    value = F.to_json(F.struct(F.lit("value").alias("kind"), file.alias("file"), (number % 4 + 1).alias("line"), F.lit(1).alias("column"), (number % 2 == 0).alias("is_error"), F.when(number % 2 == 0, "error").otherwise("string").alias("type")))
    line = F.concat_ws("\n", checked, F.when(number % 3 != 0, value))
    return _runs(d.withColumn("line", line), "stdout", "stderr")


@query("discarded_values", f"SELECT source AS module, path AS file, doc_id % 4 + 1 AS line, 1::BIGINT AS \"column\", doc_id % 2 = 0 AS is_error, CASE WHEN doc_id % 2 = 0 THEN 'error' ELSE 'string' END AS type FROM docs WHERE doc_id % 3 <> 0 AND {_ENDS} NOT IN (1, 2, 3, 4)", covers="30")
def discarded_values(spark, sf):
    return O.go_types(types_runs(spark, sf))[0]


# Four lines of Go for each document: the second is explained at its end, the fourth by the third.
_GO = "_ = f()\n_ = g() // closed already\n// the caller knows\n_ = h()\n"


@query("unexplained_errors", f"SELECT 'a-discarded-error-is-explained' AS rule, path, doc_id % 4 + 1 AS line_no FROM docs WHERE doc_id % 3 <> 0 AND {_ENDS} NOT IN (1, 2, 3, 4) AND doc_id % 2 = 0 AND doc_id % 4 IN (0, 2) AND doc_id % 4 + 1 <> 3", covers="a-discarded-error-is-explained")
def unexplained_errors(spark, sf):
    sources = store(spark, sf).docs.select("path", F.lit(_GO).alias("text"))
    return O.unexplained_errors(O.go_types(types_runs(spark, sf))[0], sources)


def compiler_payloads(spark, sf):
    number = F.col("doc_id")
    tag = F.get(F.array(*[F.lit(x) for x in ("clone-on-copy", "nested-lock", "other")]), F.when(number % 50 == 7, 2).otherwise((number % 2).cast("int")))
    line = F.concat(tag, F.lit("\t"), "path", F.lit(":"), (number % 90).cast("string"), F.lit(":1\n"))
    return _docs(spark, sf).groupBy(F.concat("source", F.lit("/"), (number % 10).cast("string")).alias("subject")).agg(F.array_join(F.collect_list(line), "").alias("payload"))


_SUBJECT = "source || '/' || (doc_id % 10)"


@query("compiler_findings", f"SELECT CASE WHEN doc_id % 2 = 0 THEN 'copy-clones' ELSE 'nested-locks' END AS rule, {_SUBJECT} AS subject, path || ':' || (doc_id % 90) || ':1' AS location FROM docs WHERE {_SUBJECT} NOT IN (SELECT {_SUBJECT} FROM docs WHERE doc_id % 50 = 7)", covers="31 copy-clones nested-locks")
def compiler_findings(spark, sf):
    return O.compiler_findings(compiler_payloads(spark, sf))[0]
