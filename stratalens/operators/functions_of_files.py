"""Functions of source files with their complexity, nesting and labels, by a brace scan.

Nesting needs a counter over characters, which columns cannot express without folding each
character; the scan runs on Arrow batches, row by row, without a shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = "path string, name string, line_no long, complexity long, depth long, useless_labels long"
_FN = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*(?:fn|func)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')
_CONSTRUCT = re.compile(r"\b(?:if|while|for|loop|match|switch|select)\b")
_LABEL = re.compile(r"'(\w+):\s*(?:loop|while|for)\b")
_JUMP = re.compile(r"\b(?:break|continue)\s+'(\w+)")


def functions_in(text: str) -> list[tuple[str, int, int, int, int]]:
    """(name, line, cyclomatic complexity, deepest nesting, labels that no inner jump needs)."""
    out, open_fn = [], None
    depth, segment = 0, ""
    for n, raw in enumerate((text or "").split("\n"), 1):
        line = _STRING.sub('""', raw)
        line = line.split("//", 1)[0]
        if open_fn is None and (m := _FN.match(line)):
            open_fn = {"name": m[1], "line": n, "base": depth, "complexity": 1, "deepest": 0, "blocks": [], "labels": [], "jumps": [], "begun": False}
        if open_fn is not None:
            body = line
            if not open_fn["begun"]:
                body = line[line.index("{") + 1 :] if "{" in line else ""
            open_fn["complexity"] += len(re.findall(r"\b(?:if|while|for|loop|case|catch)\b|&&|\|\|", body)) + max(0, body.count("=>"))
            open_fn["labels"] += _LABEL.findall(body)
            open_fn["jumps"] += _JUMP.findall(body)
        segment += " "
        for c in line:
            if c not in "{};":
                segment += c
                continue
            pending, segment = bool(_CONSTRUCT.search(segment)), ""
            if c == "{":
                depth += 1
                if open_fn is not None:
                    if not open_fn["begun"]:
                        open_fn["begun"] = True
                    else:
                        open_fn["blocks"].append(pending)
                        open_fn["deepest"] = max(open_fn["deepest"], sum(open_fn["blocks"]))
            elif c == "}":
                depth = max(0, depth - 1)
                if open_fn is not None and open_fn["begun"]:
                    if open_fn["blocks"]:
                        open_fn["blocks"].pop()
                    elif depth <= open_fn["base"]:
                        f, open_fn = open_fn, None
                        out.append((f["name"], f["line"], f["complexity"], f["deepest"], len(set(f["labels"]) - set(f["jumps"]))))
        if open_fn is not None and not open_fn["begun"] and line.rstrip().endswith(";"):
            open_fn = None
    return out


def functions(sources: DataFrame) -> DataFrame:
    """One row per function with a body. Null and other texts have none."""

    def run(batches):
        for b in batches:
            rows = [(p, *f) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in functions_in(t)]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return sources.filter(F.col("language").isin("rust", "go")).select("path", "text").mapInArrow(run, SCHEMA)


def limit_findings(found: DataFrame, complexity_max: int | None, nesting_max: int = 3) -> DataFrame:
    """Functions over the limits; an undeclared complexity limit is one finding of its own."""
    deep = found.filter(F.col("depth") > nesting_max).select(F.lit("nesting-depth").alias("rule"), "path", "name", F.col("depth").alias("measure"))
    labels = found.filter("useless_labels > 0").select(F.lit("a-labeled-jump-leaves-one-loop").alias("rule"), "path", "name", F.col("useless_labels").alias("measure"))
    if complexity_max is None:
        spark = found.sparkSession
        undeclared = spark.createDataFrame([("cyclomatic-complexity", None, "undeclared-limit", None)], "rule string, path string, name string, measure bigint")
        return deep.unionByName(labels).unionByName(undeclared)
    over = found.filter(F.col("complexity") > complexity_max).select(F.lit("cyclomatic-complexity").alias("rule"), "path", "name", F.col("complexity").alias("measure"))
    return deep.unionByName(labels).unionByName(over)


# ---- conditional branches ----------------------------------------------------------------------

DIRECTIVE = r"(?m)^[ \t]*#[ \t]*(if|elif|else|endif)\b([^\n]*)"


def condition(expression: str, defined: dict[str, int], everywhere: int) -> int:
    """The builds in which a preprocessor condition holds, as bits: symbols, true, false, !, &&, ||,
    == and != and brackets. ``defined`` has the builds of each symbol."""
    tokens = re.findall(r"\w+|&&|\|\||!=|==|!|\(|\)", expression)

    def joined(at, operators, inner):
        value, at = inner(at)
        while at < len(tokens) and tokens[at] in operators:
            right, after = inner(at + 1)
            value, at = operators[tokens[at]](value, right), after
        return value, at

    def either(at):
        return joined(at, {"||": lambda a, b: a | b}, both)

    def both(at):
        return joined(at, {"&&": lambda a, b: a & b}, same)

    def same(at):
        return joined(at, {"==": lambda a, b: everywhere & ~(a ^ b), "!=": lambda a, b: a ^ b}, one)

    def one(at):
        if at >= len(tokens):
            return 0, at
        if tokens[at] == "!":
            value, at = one(at + 1)
            return everywhere & ~value, at
        if tokens[at] == "(":
            value, at = either(at + 1)
            return value, at + 1
        return everywhere if tokens[at] == "true" else defined.get(tokens[at], 0), at + 1

    return either(0)[0]


def builds_of(builds: list[set[str]]) -> tuple[dict[str, int], int]:
    """(the builds of each symbol, all builds) as bits."""
    defined: dict[str, int] = {}
    for i, symbols in enumerate(builds):
        for symbol in symbols:
            defined[symbol] = defined.get(symbol, 0) | 1 << i
    return defined, (1 << len(builds)) - 1


def dead_branches(directives, defined: dict[str, int], everywhere: int) -> list[int]:
    """Lines of the directives (line, word, rest) whose branch no build compiles."""
    out: list[int] = []
    stack: list[tuple[int, int, int]] = []  # builds that come by, that took a branch, that take this one
    for line, word, rest in directives:
        expression = rest.split("//")[0]
        if word == "if":
            outer = stack[-1][2] if stack else everywhere
            on = outer & condition(expression, defined, everywhere)
            stack.append((outer, on, on))
        elif not stack:
            continue
        elif word == "endif":
            stack.pop()
            continue
        else:
            outer, taken, _ = stack[-1]
            on = outer & ~taken & (everywhere if word == "else" else condition(expression, defined, everywhere))
            stack[-1] = (outer, taken | on, on)
        if not stack[-1][2]:
            out.append(line)
    return out


def conditional_branches(text: str | None, builds: list[set[str]]) -> list[int]:
    """Lines of the branches of one text that no build compiles."""
    found = [(n, m[1], m[2]) for n, line in enumerate((text or "").split("\n"), 1) if (m := re.match(DIRECTIVE, line))]
    return dead_branches(found, *builds_of(builds))


def directives(sources: DataFrame, *columns: str) -> DataFrame:
    """The sources that have conditional directives, with these: line, word, rest."""
    whole = F.regexp_extract_all("text", F.lit(DIRECTIVE), F.lit(0))
    at = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), F.regexp_extract(x, DIRECTIVE, 1).alias("word"), F.regexp_extract(x, DIRECTIVE, 2).alias("rest"))), lambda x: x["word"] != "")
    return sources.filter((F.col("language") == "csharp") & (F.size(whole) > 0)).select(*columns, at.alias("directives"))


def uncompiled(sources: DataFrame, builds: list[set[str]]) -> DataFrame:
    """(path, line_no) of C# branches that no declared build compiles.

    All builds are judged at once, a bit for each, so a thousand cost what one does; only the
    directives of a source leave it.
    """
    defined, everywhere = builds_of(builds)

    def run(batches):
        for b in batches:
            paths, lines = [], []
            for path, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                dead = dead_branches([(d["line"], d["word"], d["rest"]) for d in found], defined, everywhere)
                paths += [path] * len(dead)
                lines += dead
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lines, pa.int64())], names=["path", "line_no"])

    return directives(sources, "path").mapInArrow(run, "path string, line_no long")


def conditional_symbols(sources: DataFrame) -> DataFrame:
    """(symbol, sources, directives): the symbols that conditions ask for, and how often."""
    named = directives(sources, "path").select("path", F.explode("directives").alias("d")).filter("d.word in ('if', 'elif')")
    words = F.regexp_extract_all(F.substring_index("d.rest", "//", 1), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    used = named.select("path", F.explode(F.array_except(words, F.array(F.lit("true"), F.lit("false")))).alias("symbol"))
    return used.groupBy("symbol").agg(F.countDistinct("path").alias("sources"), F.count("*").alias("directives"))
