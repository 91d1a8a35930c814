"""Findings and projections written out: CSV, JSON lines, SARIF, GraphML, and rendered text.

Tables of any size (CSV, JSON lines) are written by Spark as part files. Single documents
(SARIF, GraphML, rendered projections) are what a person or a tool opens whole: their rows
stream to the driver in order and must stay under ``most`` rows, which is checked first.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators.filters import Refused

# The columns of the finding table, in order.
FINDING_COLUMNS = ["record", "rule", "subject_name", "locations", "bucket", "suppression_kind", "suppression_justification", "gate", "applicability", "evidence", "summary", "execution_successful", "reason"]
MOST_ROWS = 200_000


def _ordered(df: DataFrame, *order, most: int = MOST_ROWS) -> Iterator:
    if df.limit(most + 1).count() > most:
        raise Refused(f"over {most} rows do not make one document")
    return df.orderBy(*order).toLocalIterator()


def finding_table(findings: DataFrame, successful: bool, reasons: list[str]) -> DataFrame:
    """Run rows (one, or one per reason) and finding rows in one shape, all strings."""
    spark = findings.sparkSession
    have = set(findings.columns)
    cell = lambda c: F.array_join("locations", ";") if c == "locations" else F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    rows = findings.select(F.lit(1).alias("at"), *[(F.lit("finding") if c == "record" else cell(c)).alias(c) for c in FINDING_COLUMNS])
    flag = str(successful).lower()
    runs = [(0, "run", *[""] * (len(FINDING_COLUMNS) - 3), flag, r) for r in (reasons or [""])]
    return spark.createDataFrame(runs, rows.schema).unionByName(rows)


def write_csv(findings: DataFrame, path: str, successful: bool = True, reasons: list[str] = ()) -> None:
    """RFC 4180 text: CRLF, quotes doubled, run rows first, then findings in reading order."""
    table = finding_table(findings, successful, list(reasons)).orderBy("at", "rule", "subject_name", "locations").drop("at")
    quoted = lambda c: F.when(F.col(c).rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    lines = table.select(F.concat_ws(",", *[quoted(c) for c in FINDING_COLUMNS]).alias("value"))
    head = findings.sparkSession.createDataFrame([(",".join(FINDING_COLUMNS),)], "value string")
    head.coalesce(1).unionAll(lines).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def jsonl(findings: DataFrame, successful: bool = True, reasons: list[str] = ()) -> DataFrame:
    """One run line, then one line per finding."""
    spark = findings.sparkSession
    run = spark.createDataFrame([(json.dumps({"record": "run", "execution_successful": successful, "reasons": list(reasons)}),)], "value string")
    rows = findings.orderBy("rule", "subject", "locations").select(F.to_json(F.struct(F.lit("finding").alias("record"), *findings.columns)).alias("value"))
    return run.coalesce(1).unionAll(rows)


LEVELS = {"Blocking": "error", "Advisory": "warning", "Review": "note", "Unreachable": "none"}


def sarif(findings: DataFrame, tool: str = "stratalens", most: int = MOST_ROWS) -> dict:
    """A SARIF 2.1.0 log with one run."""
    results, rules = [], set()
    for r in _ordered(findings, "rule", "subject", "locations", most=most):
        rules.add(r["rule"])
        one = {"ruleId": r["rule"], "level": LEVELS.get(r["gate"], "none"), "message": {"text": r["summary"]}, "locations": [_location(x) for x in r["locations"]]}
        if "bucket" in findings.columns and r["bucket"] in ("suppressed", "baselined"):
            one["suppressions"] = [{"kind": "external"}]
        results.append(one)
    driver = {"name": tool, "rules": [{"id": x} for x in sorted(rules)]}
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": driver}, "results": results}]}


def _location(text: str) -> dict:
    path, _, line = text.rpartition(":")
    if path and line.isdigit():
        return {"physicalLocation": {"artifactLocation": {"uri": path}, "region": {"startLine": int(line)}}}
    return {"physicalLocation": {"artifactLocation": {"uri": text}}}


def graphml(nodes: DataFrame, edges: DataFrame, most: int = MOST_ROWS) -> str:
    """Nodes (id, kind) and directed edges (src, dst, label) as GraphML."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="kind" for="node" attr.name="kind" attr.type="string"/>', '<key id="label" for="edge" attr.name="label" attr.type="string"/>', '<graph edgedefault="directed">']
    out += [f"<node id={quoteattr(str(r['id']))}><data key=\"kind\">{_html.escape(str(r['kind']))}</data></node>" for r in _ordered(nodes, "id", most=most)]
    out += [f"<edge source={quoteattr(str(r['src']))} target={quoteattr(str(r['dst']))}><data key=\"label\">{_html.escape(str(r['label']))}</data></edge>" for r in _ordered(edges, "src", "dst", "label", most=most)]
    return "\n".join([*out, "</graph>", "</graphml>", ""])


# ---- projections -------------------------------------------------------------------------------


def render(title: str, sections: list[tuple[str, DataFrame]], format: str, most: int = MOST_ROWS) -> str:
    """A projection's sections of items (identity, names, values, body) in a declared format."""
    got = [(t, [(r["identity"], list(zip(r["names"], r["values"])), r["body"]) for r in _ordered(df, "identity", most=most)]) for t, df in sections]
    if empty := [t for t, rows in got if not rows]:
        raise Refused(f"{empty[0]} selects nothing")
    made = {"markdown": _markdown, "html": _html_page, "json": _json, "yaml": _yaml, "mermaid": _mermaid, "contextpack": _pack}
    if format not in made:
        raise Refused(f"{format} is no format")
    return made[format](title, got)


def _markdown(title, sections):
    out = [f"# {title}", ""]
    for t, items in sections:
        out += [f"## {t}", ""]
        for identity, fields, body in items:
            out += [f"### {identity}", ""] + [f"- {n}: {v}" for n, v in fields] + [""] * bool(fields)
            out += [body, ""] if body else []
    return "\n".join(out)


def _html_page(title, sections):
    e = _html.escape
    out = [f"<!DOCTYPE html><html><head><title>{e(title)}</title></head><body><h1>{e(title)}</h1>"]
    for t, items in sections:
        out.append(f"<h2>{e(t)}</h2>")
        for identity, fields, body in items:
            out.append(f"<h3>{e(identity)}</h3><dl>" + "".join(f"<dt>{e(n)}</dt><dd>{e(v)}</dd>" for n, v in fields) + "</dl>" + (f"<p>{e(body)}</p>" if body else ""))
    return "\n".join([*out, "</body></html>", ""])


def _plain(title, sections):
    return {"title": title, "sections": [{"title": t, "items": [{"identity": i, "fields": [{"name": n, "value": v} for n, v in f], "body": b} for i, f, b in items]} for t, items in sections]}


def _json(title, sections):
    return json.dumps(_plain(title, sections), indent=2, ensure_ascii=False) + "\n"


def _yaml(title, sections):
    q = lambda x: json.dumps(x, ensure_ascii=False)  # noqa: E731  JSON strings are YAML strings
    out = [f"title: {q(title)}", "sections:"]
    for t, items in sections:
        out += [f"  - title: {q(t)}", "    items:"]
        for i, fields, body in items:
            out += [f"      - identity: {q(i)}", "        fields:" if fields else "        fields: []"]
            out += [f"          - name: {q(n)}\n            value: {q(v)}" for n, v in fields] + [f"        body: {q(body)}"]
    return "\n".join(out) + "\n"


def _mermaid(title, sections):
    """Items are nodes; a field named 'to' is an edge."""
    out, ids = ["graph TD"], {}
    for _, items in sections:
        for i, fields, _ in items:
            a = ids.setdefault(i, f"n{len(ids)}")
            out.append(f'  {a}["{_html.escape(i)}"]')
            for n, v in fields:
                if n == "to":
                    out.append(f"  {a} --> {ids.setdefault(v, f'n{len(ids)}')}")
    return "\n".join(out) + "\n"


def _pack(title, sections):
    return "".join(json.dumps({"pack": title, "section": t, "identity": i, "fields": dict(f), "body": b}, ensure_ascii=False) + "\n" for t, items in sections for i, f, b in items)


def items_of(df: DataFrame, identity: str, fields: list[str], body: str | None = None) -> DataFrame:
    """Any reader's rows as projection items; nulls are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(text(identity).alias("identity"), F.array(*[F.lit(f) for f in fields]).alias("names"), F.array(*[text(f) for f in fields]).alias("values"), (F.col(body) if body else F.lit(None).cast("string")).alias("body"))


def stamp(sections: list[tuple[str, DataFrame]], output: str) -> dict:
    """The sidecar of a rendered projection: digests of its inputs, in order, and of its text."""
    h = hashlib.sha256()
    for t, df in sections:
        h.update(t.encode() + b"\x1d")
        for r in _ordered(df.select("identity", X.item_digest("identity", "names", "values", "body").alias("d")), "identity"):
            h.update(r["d"].encode() + b"\n")
    return {"inputs": h.hexdigest(), "output": hashlib.sha256(output.encode()).hexdigest()}
