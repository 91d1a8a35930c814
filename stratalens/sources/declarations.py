"""Declared inputs in JSON and YAML, and facts of outside tools, as DataFrames with schemas.

Declarations are written by hand and small; a file is read whole. Unknown keys are refused,
so a misspelt one does not pass for an absent one.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.filters import Refused

CATALOG = "id string, kind string, name string, statement string"
FACT_STORE_VERSION = 1


def catalog(spark: SparkSession, path: str, schema: str = CATALOG) -> DataFrame:
    """A JSON array of entities, one row each; a malformed file fails as a whole."""
    return spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(schema).json(path)


def flat_yaml(text: str) -> list[dict[str, str]]:
    """A YAML list of flat mappings: '- key: value' items with scalar values or inline lists."""
    out: list[dict[str, str]] = []
    for n, line in enumerate(text.split("\n"), 1):
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare.strip() or bare.strip() in ("---", "..."):
            continue
        m = re.match(r"^(\s*)(- )?\s*([\w.-]+):\s*(.*)$", bare)
        if not m:
            raise Refused(f"line {n} is no mapping entry")
        if m[2]:
            out.append({})
        elif not out and not m[1]:
            if m[4]:
                raise Refused(f"line {n} stands outside of any item")
            continue  # the list's own name
        if not out:
            raise Refused(f"line {n} stands outside of any item")
        out[-1][m[3]] = m[4].strip().strip("'\"")
    return out


def yaml_rows(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """Items of a flat YAML list as rows; keys that the schema lacks are refused."""
    names = [c.split()[0] for c in schema.split(", ")]
    rows = flat_yaml(text)
    extra = sorted({k for r in rows for k in r} - set(names))
    if extra:
        raise Refused(f"unknown keys: {', '.join(extra)}")
    strings = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
    kinds = dict(c.split(" ", 1) for c in schema.split(", "))
    lists = lambda n: F.filter(F.transform(F.split(F.regexp_replace(n, r"^\[|\]$", ""), ","), F.trim), lambda x: x != "")
    return strings.select(*[(lists(n) if kinds[n].startswith("array") else F.col(n).cast(kinds[n])).alias(n) for n in names])


BLOCK_LINEAGE = "path string, ordinal bigint, hash string"
STATEMENTS = "statement_id string, kind string, text string"
SECTION_LINEAGE = "heading string, target string, disposition string"


def block_lineage(spark, text: str) -> DataFrame:
    return yaml_rows(spark, text, BLOCK_LINEAGE)


def statements(spark, text: str) -> DataFrame:
    return yaml_rows(spark, text, STATEMENTS)


def section_lineage(spark, text: str) -> DataFrame:
    return yaml_rows(spark, text, SECTION_LINEAGE)


def profile(text: str) -> dict:
    """A projection profile: id, title, format, output, sections of title, content and filter."""
    got = json.loads(text)
    known = {"id", "title", "format", "output", "sections"}
    if extra := sorted(set(got) - known):
        raise Refused(f"unknown keys: {', '.join(extra)}")
    for s in got.get("sections", []):
        if extra := sorted(set(s) - {"title", "content", "filter"}):
            raise Refused(f"unknown section keys: {', '.join(extra)}")
    return got


def tool_edges(spark: SparkSession, metadata: str) -> DataFrame:
    """Dependency edges (package, target, kind) from a package manager's metadata in JSON."""
    got = json.loads(metadata)
    members = {p["name"] for p in got["packages"]}
    rows = [(p["name"], d["name"], d.get("kind") or "normal") for p in got["packages"] for d in p.get("dependencies", []) if d["name"] in members]
    return spark.createDataFrame(rows, "package string, target string, kind string")


def module_edges(spark: SparkSession, graph: str, own: str) -> DataFrame:
    """First-party edges from a 'module dependency' graph, one edge a line."""
    pairs = [line.split() for line in graph.split("\n") if line.strip()]
    bare = lambda x: x.split("@")[0]
    rows = [(bare(a), bare(b), "normal") for a, b in pairs if bare(a).startswith(own) and bare(b).startswith(own)]
    return spark.createDataFrame(rows, "package string, target string, kind string")


DIAGNOSTIC = "reason string, package_id string, message struct<level:string,message:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:bigint>>>"


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Compiler messages in JSON lines as (package, level, code, message, path, line)."""
    out = spark.read.schema(DIAGNOSTIC).json(path).filter("reason = 'compiler-message'")
    first = F.get("message.spans", F.lit(0))
    return out.select(F.col("package_id").alias("package"), "message.level", F.col("message.code.code").alias("code"), F.col("message.message").alias("message"), first["file_name"].alias("path"), first["line_start"].alias("line"))


FACTS = "contract string, contract_version string, subject string, semantic_inputs string, provider string, provider_version string, guarantee string, variant string, configuration string, generation bigint, schema string, payload binary, deps array<string>"


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts with the store's version; written aside and then swapped in by one rename."""
    spark = facts.sparkSession
    jvm = spark.sparkContext._jvm
    fresh, target = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path)
    facts.withColumn("store_version", F.lit(FACT_STORE_VERSION)).write.mode("overwrite").parquet(path + ".new")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(fresh, target):
        raise Refused(f"{path} could not be replaced")


def read_facts(spark: SparkSession, path: str, understood: list[str]) -> DataFrame:
    """The store's facts; refused whole on another version, key shape or payload schema."""
    got = spark.read.parquet(path)
    names = [c.split()[0] for c in FACTS.split(", ")]
    if missing := sorted(set(names) - set(got.columns)):
        raise Refused(f"the store lacks {', '.join(missing)}")
    if not got.filter(F.col("store_version") != FACT_STORE_VERSION).isEmpty():
        raise Refused("the store has another version")
    if not got.filter(~F.col("schema").isin(understood)).isEmpty():
        raise Refused("the store holds payloads of a schema that is not understood")
    return got.select(*names)
