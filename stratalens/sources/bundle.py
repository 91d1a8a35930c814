"""A whole store as one deterministic JSON-lines bundle, and its checked import.

Line 1 is a header with format and schema version, the last line a manifest with the count
of each table and a digest over them; between them one typed record a line, tables in order
and rows by natural key. An import is refused whole unless counts, digest, references inside
the bundle and disjointness from the store all hold.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.filters import Refused
from ..schemas import KEYS, REFERENCES, SCHEMAS, VERSION

FORMAT = "bundle/1"


def lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(at, value): the bundle's records with their place; sorted by ``at`` they are the text."""
    out = None
    for i, name in enumerate(n for n in SCHEMAS if n in tables):
        df = tables[name].select(*[c.split()[0] for c in _split(SCHEMAS[name])])
        key = F.struct(F.lit(i).alias("t"), F.to_json(F.struct(*KEYS[name]), {"ignoreNullFields": "false"}).alias("k"))
        row = F.to_json(F.struct(F.lit(name).alias("table"), F.struct(*df.columns).alias("row")), {"ignoreNullFields": "false"})
        part = df.select(key.alias("at"), row.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _split(schema: str) -> list[str]:
    """Columns of a DDL schema; commas inside <> do not split."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def digest(records: DataFrame, buckets: int = 4096) -> str:
    """A digest of the records, whatever their order: no task gathers them all."""
    by = records.select(F.sha2("value", 256).alias("d")).groupBy(F.pmod(F.xxhash64("d"), F.lit(buckets)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d"))
    got = by.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("d")).first()
    return got["d"]


def export(tables: dict[str, DataFrame], path: str) -> dict:
    """Writes the bundle as ordered part files of text; returns its manifest."""
    records = lines(tables)
    spark = records.sparkSession
    counts = {r["t"]: r["n"] for r in records.groupBy(F.get_json_object("value", "$.table").alias("t")).agg(F.count("*").alias("n")).collect()}
    manifest = {"kind": "manifest", "counts": dict(sorted(counts.items())), "digest": digest(records)}
    ends = spark.createDataFrame([(-1, json.dumps({"kind": "header", "format": FORMAT, "version": VERSION})), (10**6, json.dumps(manifest))], "t int, value string")
    whole = records.unionByName(ends.select(F.struct("t", F.lit("").alias("k")).alias("at"), "value"))
    whole.orderBy("at").select("value").write.mode("overwrite").text(path)
    return manifest


def parse(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The bundle's tables; refused whole if it is not trustworthy."""
    text = spark.read.text(path)
    kind = F.get_json_object("value", "$.kind")
    ends = text.filter(kind.isNotNull()).limit(10).collect()
    found = [json.loads(r["value"]) for r in ends]
    heads, manifests = [x for x in found if x["kind"] == "header"], [x for x in found if x["kind"] == "manifest"]
    if len(heads) != 1 or len(manifests) != 1 or heads[0].get("format") != FORMAT or heads[0].get("version") != VERSION:
        raise Refused("no header and manifest of this format and version")
    records = text.filter(kind.isNull())
    name = F.get_json_object("value", "$.table")
    counts = {r["t"]: r["n"] for r in records.groupBy(name.alias("t")).agg(F.count("*").alias("n")).collect()}
    if counts != manifests[0]["counts"]:
        raise Refused("the counts differ from the manifest's")
    if digest(records) != manifests[0]["digest"]:
        raise Refused("the digest differs from the manifest's")
    out = {}
    for table in counts:
        if table not in SCHEMAS:
            raise Refused(f"{table} is no table of this version")
        own = records.filter(name == table).select(F.from_json("value", f"struct<table:string,row:struct<{_ddl(SCHEMAS[table])}>>", {"mode": "FAILFAST"}).alias("r"))
        out[table] = own.select("r.row.*")
    return out


def _ddl(schema: str) -> str:
    return ",".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in _split(schema))


def dangling(tables: dict[str, DataFrame]) -> DataFrame | None:
    """(table, reference) of every reference that does not resolve inside the bundle."""
    out = None
    for table, columns, other, keys in REFERENCES:
        if table not in tables:
            continue
        rows = tables[table]
        for c in columns:
            rows = rows.filter(F.col(c).isNotNull())
        named = rows.select(*[F.col(c).alias(k) for c, k in zip(columns, keys)]).distinct()
        lost = named.join(tables[other].select(*keys), keys, "left_anti") if other in tables else named
        part = lost.select(F.lit(table).alias("table"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("reference"))
        out = part if out is None else out.unionByName(part)
    return out


def overlapping(tables: dict[str, DataFrame], store: dict[str, DataFrame]) -> DataFrame | None:
    """(table, key) of identities that the store has already."""
    out = None
    for name, df in tables.items():
        if name in store:
            key = F.to_json(F.struct(*KEYS[name]), {"ignoreNullFields": "false"})
            part = df.select(key.alias("key")).join(store[name].select(key.alias("key")), "key", "left_semi").select(F.lit(name).alias("table"), "key")
            out = part if out is None else out.unionByName(part)
    return out


def load(spark: SparkSession, path: str, store: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The store with the bundle's rows, all checks passed; nothing is written."""
    tables = parse(spark, path)
    lost, twice = dangling(tables), overlapping(tables, store)
    if lost is not None and not lost.isEmpty():
        raise Refused("a reference does not resolve inside the bundle")
    if twice is not None and not twice.isEmpty():
        raise Refused("an identity is in the store already")
    return {n: store[n].unionByName(tables[n]) if n in store and n in tables else (store.get(n) or tables.get(n)) if n not in store or n not in tables else store[n] for n in {*store, *tables}}
