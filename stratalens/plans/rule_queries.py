"""Queries of the text, item and file rules over source files derived from the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import filters as Q, functions_of_files as X, graph as G, incremental as I, line_rules as L, rules as R
from ..operators.providers import RuleDescriptor, judge_all
from .registry import query
from .store import sql_text as T, store

_SPACE = r"[\x09-\x0D\x20\x85\p{Z}]"
_TRIM = lambda x: f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_COMMENT = lambda x: f"CASE WHEN regexp_matches({x}, '^\\s*//') THEN {_TRIM(f'regexp_replace({x}, ' + T(R.COMMENT_MARK) + ', chr(0))'.replace('chr(0)', chr(39) * 2))} END"


def _violates_sql(r: R.TextRule) -> str:
    parts = [f"coalesce(regexp_matches({r.on}, {T(r.pattern)}), false)"]
    if r.languages:
        parts.append(f"language IN ({', '.join(T(x) for x in r.languages)})")
    if r.also:
        parts.append(f"regexp_matches({r.on}, {T(r.also)})")
    if r.unless:
        parts.append(f"NOT regexp_matches({r.on}, {T(r.unless)})")
    if r.reason:
        for p in {"block": ["block"], "adjacent": ["line_end", "line_before"], "before": ["line_before"]}[r.reach]:
            parts.append(f"NOT regexp_matches({p}, {T(r.reason)})")
    if not r.judges_tests:
        parts.append(f"NOT regexp_matches(path, {T(R.TEST_PATH)})")
    return f"CASE WHEN {' AND '.join(parts)} THEN {T(r.id)} END"


LINES_SQL = "SELECT path, language, lines, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS line FROM (SELECT path, language, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\r$', '')) AS lines FROM sources)"
SITES_SQL = f"""
SELECT path, language, line_no, line, code, regexp_replace(code, {T(R.STRING_BODY_PLAIN)}, '""', 'g') AS masked, {_COMMENT('line')} AS comment,
  coalesce(array_to_string(list_filter(list_transform(lines[coalesce(last, 0) + 1:line_no - 1], lambda x: {_COMMENT('x')}), lambda x: x IS NOT NULL), chr(10)), '') AS block,
  coalesce({_TRIM("regexp_extract(lines[line_no - 1], '^\\s*(?://|#)(.*)$', 1)")}, '') AS line_before, {_TRIM("regexp_extract(line, '(?://|#)(.*)$', 1)")} AS line_end
FROM (SELECT *, regexp_replace(line, {T(R.CODE_PREFIX_PLAIN)}, '\\1') AS code, max(CASE WHEN NOT regexp_matches(line, {T(R.BLOCK_LINE)}) THEN line_no END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ({LINES_SQL}))"""
_judged_sql = lambda rules: f"SELECT rule, path, line_no FROM (SELECT path, line_no, unnest(list_filter([{', '.join(_violates_sql(r) for r in rules)}], lambda x: x IS NOT NULL)) AS rule FROM ({SITES_SQL}))"
JUDGED_SQL = _judged_sql(R.TEXT_RULES)
# The kept runs leave out the rules that ``line_rules`` judges.
KEPT_RULES = [r for r in R.TEXT_RULES if r.id not in L.RULES]
KEPT_SQL = _judged_sql(KEPT_RULES)


def _judge_kept(sources):
    return R.judge(sources, KEPT_RULES)


@query("text_rule_findings", JUDGED_SQL, covers="233 234 235 " + " ".join(r.id for r in R.TEXT_RULES))
def text_rule_findings(spark, sf):
    return R.judge(store(spark, sf).sources.select("path", "language", "text"))


@query("text_rule_counts", f"SELECT rule, count(*) AS n, count(DISTINCT path) AS files FROM ({JUDGED_SQL}) GROUP BY 1", covers="235")
def text_rule_counts(spark, sf):
    found = R.judge(store(spark, sf).sources.select("path", "language", "text"))
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


# ---- items -----------------------------------------------------------------------------------

_X = lambda p, n: f"regexp_extract(m, {T(p)}, {n})"
ITEMS_SQL = f"""
SELECT path, language, line_no, CASE WHEN is_item THEN i.kind ELSE 'field' END AS kind, CASE WHEN is_item THEN i.public ELSE {_X(R.FIELD, 1)} <> '' END AS public, CASE WHEN is_item THEN i.name ELSE {_X(R.FIELD, 2)} END AS name, CASE WHEN is_item THEN m ELSE {_X(R.FIELD, 3)} END AS rest FROM (
SELECT *, CASE language WHEN 'rust' THEN {{'kind': {_X(R.RUST_ITEM, 2)}, 'public': {_X(R.RUST_ITEM, 1)} <> '', 'name': {_X(R.RUST_ITEM, 3)}}} WHEN 'go' THEN {{'kind': {_X(R.GO_ITEM, 1)}, 'public': regexp_matches({_X(R.GO_ITEM, 2)}, '^[A-Z]'), 'name': {_X(R.GO_ITEM, 2)}}} ELSE {{'kind': {_X(R.CSHARP_ITEM, 2)}, 'public': contains({_X(R.CSHARP_ITEM, 1)}, 'public'), 'name': {_X(R.CSHARP_ITEM, 3)}}} END AS i, regexp_matches(m, CASE language WHEN 'rust' THEN {T(R.RUST_ITEM)} WHEN 'go' THEN {T(R.GO_ITEM)} ELSE {T(R.CSHARP_ITEM)} END) AS is_item FROM (SELECT path, language, line_no, regexp_replace(regexp_replace(line, {T(R.CODE_PREFIX_PLAIN)}, '\\1'), {T(R.STRING_BODY_PLAIN)}, '""', 'g') AS m FROM ({LINES_SQL}) WHERE language IN ('rust', 'go', 'csharp')))
WHERE is_item OR language = 'rust' AND regexp_matches(m, {T(R.FIELD)})"""


@query("source_items", f"SELECT path, language, line_no, kind, public, name FROM ({ITEMS_SQL})", covers="18 19 20 21")
def source_items(spark, sf):
    return R.items(store(spark, sf).sources).select("path", "language", "line_no", "kind", "public", "name")


_WORDS = "list_filter(string_split(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_'), lambda w: w <> '')"
_IN = lambda xs: "(" + ", ".join(T(x) for x in xs) + ")"
_PARAMS = "len(list_filter(list_transform(string_split(regexp_extract(rest, '[A-Za-z0-9_>]\\(([^()]*)\\)', 1), ','), lambda p: " + _TRIM("p") + "), lambda p: p <> '' AND NOT regexp_matches(p, '^&?(?:''\\w+\\s+)?(?:mut\\s+)?self\\b')))"
_TYPES = "kind IN ('struct', 'enum', 'trait', 'union', 'type', 'class', 'interface', 'record')"
_M = lambda x, p: f"regexp_matches({x}, {T(p)})"
_STEM = "regexp_extract(path, '([^/]+)\\.[^.]+$', 1)"
ITEM_RULES_SQL = {
    "single-letter-names": "length(name) = 1 AND name <> '_'",
    "naming-clarity": f"len(list_filter({_WORDS}, lambda w: w IN {_IN(R.VAGUE_WORDS)})) > 0",
    "abbreviations": f"len(list_filter({_WORDS}, lambda w: length(w) >= 2 AND (w IN {_IN(R.BANNED_WORDS)} OR NOT regexp_matches(w, '[aeiouy0-9]')) AND w NOT IN {_IN(R.APPROVED_WORDS)})) > 0",
    "boolean-predicates": "language = 'rust' AND kind = 'field' AND rest = 'bool' AND NOT regexp_matches(name, '^(?:is_|has_|can_|should_)')",
    "data-names-stay-lower-snake": f"language = 'rust' AND kind IN ('mod', 'field') AND NOT {_M('name', R.LOWER_SNAKE)}",
    "function-naming-convention": f"language = 'rust' AND kind = 'fn' AND name <> 'main' AND NOT {_M('name', R.UPPER_SNAKE)}",
    "project-owned-function-names-use-upper-snake-case": f"language = 'rust' AND kind = 'fn' AND name <> 'main' AND NOT {_M('name', R.UPPER_SNAKE)}",
    "test-functions-use-test-subject-should-behavior": "kind IN ('fn', 'func') AND starts_with(name, 'Test_') AND NOT contains(name, '_Should_')",
    "exported-functions-use-upper-snake-case": f"language = 'go' AND kind = 'func' AND public AND NOT {_M('name', R.UPPER_SNAKE)}",
    "unexported-functions-lowercase-only-the-first-letter": "language = 'go' AND kind = 'func' AND NOT public AND name NOT IN ('main', 'init') AND NOT regexp_matches(name, '^[a-z][a-z0-9]*(?:_[A-Z0-9][a-z0-9]*)*$')",
    "types-use-upper-camel-case-lower-camel-case": f"language = 'go' AND kind = 'type' AND NOT CASE WHEN public THEN {_M('name', R.UPPER_CAMEL)} ELSE {_M('name', R.LOWER_CAMEL)} END",
    "variables-use-lower-snake-case": f"language = 'go' AND kind = 'var' AND name <> '_' AND NOT {_M('name', R.LOWER_SNAKE)}",
    "constants-split-by-export": f"language = 'go' AND kind = 'const' AND NOT CASE WHEN public THEN {_M('name', R.SCREAMING)} ELSE {_M('name', R.LOWER_SNAKE)} END",
    "a-package-is-named-after-its-directory": "language = 'go' AND kind = 'package' AND name <> 'main' AND NOT regexp_matches(name, '_test$') AND regexp_replace(regexp_extract(path, '([^/]+)/[^/]+$', 1), '[-_]', '', 'g') <> regexp_replace(name, '[-_]', '', 'g')",
    "file-name-matches-declared-type": f"language = 'rust' AND {_TYPES} AND public AND {_STEM} NOT IN ('lib', 'main', 'mod') AND lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) <> {_STEM}",
    "parameter-count": f"language = 'rust' AND kind = 'fn' AND {_PARAMS} > {R.PARAMETERS_MAX}",
    "go-helpers-package-five-inputs": f"language = 'go' AND kind = 'func' AND {_PARAMS} > {R.PARAMETERS_MAX}",
}
_CASES = ", ".join(f"CASE WHEN {test} THEN {T(r)} END" for r, test in ITEM_RULES_SQL.items())


@query("item_rule_findings", f"SELECT rule, path, line_no, name FROM (SELECT path, line_no, name, unnest(list_filter([{_CASES}], lambda x: x IS NOT NULL)) AS rule FROM ({ITEMS_SQL}))", covers=" ".join(ITEM_RULES_SQL))
def item_rule_findings(spark, sf):
    return R.item_findings(R.items(store(spark, sf).sources))


@query("arity_policy", f"SELECT 'function-arity' AS rule, path, line_no, name, {_PARAMS}::BIGINT AS arity FROM ({ITEMS_SQL}) WHERE kind IN ('fn', 'func') AND {_PARAMS} > CASE language WHEN 'rust' THEN 1 WHEN 'go' THEN 0 ELSE 99 END", covers="function-arity")
def arity_policy(spark, sf):
    policy = spark.createDataFrame([("rust", 1), ("go", 0)], "language string, most int")
    return R.arity_findings(R.items(store(spark, sf).sources), policy)


# ---- files -----------------------------------------------------------------------------------

_N = "(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END)"
FILE_RULES_SQL = {
    "500-lines": f"language <> 'go' AND {_N} > 500",
    "1500-lines": f"language <> 'go' AND {_N} > 1500",
    "five-hundred-line-review-trigger": f"language = 'go' AND {_N} > 500",
    "one-thousand-line-hard-trigger": f"language = 'go' AND {_N} > 1000",
    "scripts-use-a-portable-shebang": "starts_with(text, '#!') AND NOT starts_with(regexp_extract(text, '^#!\\s*([^\\n]*)', 1), '/usr/bin/env ')",
    "a-script-declares-its-purpose": "starts_with(text, '#!') AND NOT starts_with(regexp_extract(text, '^[^\\n]*\\n\\s*([^\\n]*)', 1), '#')",
    "executed-scripts-set-nounset": "starts_with(text, '#!') AND NOT regexp_matches(text, '(?m)^\\s*set\\s+(?:[^#\\n]*\\s)?(?:-[a-zA-Z]*u[a-zA-Z]*|-o\\s+nounset)\\b')",
    "no-mod-rs-files": "language = 'rust' AND regexp_matches(path, '(?:^|/)src/(?:.*/)?mod\\.rs$')",
}
_FILE_CASES = ", ".join(f"CASE WHEN {test} THEN {T(r)} END" for r, test in FILE_RULES_SQL.items())


@query("file_rule_findings", f"SELECT rule, path, n::BIGINT AS measure FROM (SELECT path, {_N} AS n, unnest(list_filter([{_FILE_CASES}], lambda x: x IS NOT NULL)) AS rule FROM sources) UNION ALL SELECT 'one-public-type-per-file', path, count(*) FROM ({ITEMS_SQL}) WHERE kind IN ('struct', 'enum', 'trait', 'union', 'class', 'interface', 'record') AND public GROUP BY path HAVING count(*) > 1", covers=" ".join(FILE_RULES_SQL) + " one-public-type-per-file")
def file_rule_findings(spark, sf):
    s = store(spark, sf).sources
    return R.file_findings(s, R.items(s))


@query("tooling_language", "SELECT 'declared-tooling-language-for-scripts' AS rule, path FROM sources WHERE ends_with(lower(path), '.sh') OR ends_with(lower(path), '.cs')", covers="declared-tooling-language-for-scripts")
def tooling_language(spark, sf):
    return R.forbidden_extensions(store(spark, sf).sources, [".sh", ".CS"])


@query("recognised_sources", "SELECT path, CASE WHEN ends_with(path, '.rs') THEN 'rust' ELSE 'go' END AS language FROM sources WHERE ends_with(path, '.rs') OR ends_with(path, '.go')", covers="2 7 8")
def recognised_sources(spark, sf):
    return Q.by_extension(store(spark, sf).sources.select("path"), {"rs": "rust", "go": "go"})


@query("facade_double_publication", "SELECT 'facade-chooses-flattening-or-namespace' AS rule, path, unnest(list_distinct(list_intersect(regexp_extract_all(text, '(?m)^\\s*pub mod (\\w+);', 1), regexp_extract_all(text, '(?m)^\\s*pub use (?:self::)?(\\w+)::', 1)))) AS child FROM sources WHERE language = 'rust'", covers="facade-chooses-flattening-or-namespace")
def facade_double_publication(spark, sf):
    return R.facade_findings(store(spark, sf).sources)


@query("facade_consumer_imports", "WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?m)^\\s*pub use (?:self::)?(\\w+::\\w+);', 1)) AS child FROM sources WHERE language = 'rust') SELECT 'facade-consumers-use-the-facade-path' AS rule, path, child FROM (SELECT path, unnest(list_distinct(regexp_extract_all(text, '(?m)^\\s*use \\w+::(\\w+::\\w+);', 1))) AS child FROM sources WHERE language = 'rust') WHERE child IN (SELECT child FROM r)", covers="facade-consumers-use-the-facade-path")
def facade_consumer_imports(spark, sf):
    return R.consumer_imports(store(spark, sf).sources)


@query("function_metrics", covers="27 cyclomatic-complexity nesting-depth a-labeled-jump-leaves-one-loop")
def function_metrics(spark, sf):
    found = X.functions(store(spark, sf).sources)
    return X.limit_findings(found, 10)


# (fragment of C#, lines of branches that no build compiles) where builds have all sets of S0 to S9 but
# those with S8 and S9 together
_BRANCHES = [
    ("#if S0 && !S1 // @\nx\n#elif S1 || !S0\ny\n#else\nz\n#endif\n", [5]),
    ("#if S2\n#if !S2\ndead @\n#else\nx\n#endif\n#elif S2 || false\ny\n#endif\n", [2, 7]),
    ("  # if (S3 == S4) != !(S3 != S4)\n#endif\n#if true\n#else // @\n#endif\n", [1, 4]),
    ("#if S8 && S9\n@\n#elif S8 || S9\nx\n#elif !S8\ny\n#else\nz\n#endif\n", [1, 7]),
    ("// #if false\n#if UNKNOWN\n@\n#endif\n#endif\n#else\n", [2]),
]
_BRANCH_VALUES = ", ".join(f"({k}, {line})" for k, (_, dead) in enumerate(_BRANCHES) for line in dead)
_BRANCH_SIZES = "[" + ", ".join(str(t.count("\n")) for t, _ in _BRANCHES) + "]"
BUILDS = [{f"S{j}" for j in range(10) if b >> j & 1} for b in range(1024) if b >> 8 != 3]


def _branched(spark, sf):
    """(path, language, text): a fragment of C# for each line of a document."""
    d = F.col("doc_id")
    pick = lambda i: F.get(F.array(*[F.lit(t) for t, _ in _BRANCHES]), ((d * 3 + i + 1) % len(_BRANCHES)).cast("int"))
    clean = lambda x: F.translate(x, "#/", "  ")
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.replace(pick(i), F.lit("@"), clean(x))), "")
    return store(spark, sf).docs.select("path", F.lit("csharp").alias("language"), text.alias("text"))


_BRANCHED_SQL = f"""SELECT path, k, 1 + coalesce(sum(size) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line FROM
  (SELECT path, i, (doc_id * 3 + i) % {len(_BRANCHES)} AS k, ({_BRANCH_SIZES})[((doc_id * 3 + i) % {len(_BRANCHES)} + 1)::INT] AS size FROM (SELECT doc_id, path, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs))"""


@query("conditional_branches", f"SELECT path, (first_line + line - 1)::BIGINT AS line_no FROM ({_BRANCHED_SQL}) JOIN (VALUES {_BRANCH_VALUES}) f(k, line) USING (k)", covers="29 uncompiled-conditional-branch")
def conditional_branches(spark, sf):
    return X.uncompiled(_branched(spark, sf), BUILDS)


_SYMBOL_VALUES = ", ".join(f"({k}, '{s}', {n})" for k, s, n in [(0, "S0", 2), (0, "S1", 2), (1, "S2", 3), (2, "S3", 1), (2, "S4", 1), (3, "S8", 3), (3, "S9", 2), (4, "UNKNOWN", 1)])


@query("conditional_symbols", f"SELECT symbol, count(DISTINCT path) AS sources, sum(n)::BIGINT AS directives FROM (SELECT path, symbol, n FROM ({_BRANCHED_SQL}) JOIN (VALUES {_SYMBOL_VALUES}) f(k, symbol, n) USING (k)) GROUP BY 1", covers="196")
def conditional_symbols(spark, sf):
    return X.conditional_symbols(_branched(spark, sf))


_TOOLS = {"lint-diagnostics": "click", "dependency-policy": "error", "copy-clones": "view", "nested-locks": "purchase", "review-finding": "signup", "a-discarded-error-is-explained": "scroll"}
_TOOLS_SQL = " ".join(f"WHEN {T(e)} THEN {T(r)}" for r, e in _TOOLS.items())


@query("tool_fact_findings", f"SELECT rule, 'user' || user_id AS path, 'g' || generation || '/' || s AS site FROM (SELECT *, CASE event_type {_TOOLS_SQL} END AS rule, unnest(range(0, (event_id % 3)::INT)) AS s FROM facts) WHERE rule IS NOT NULL", covers="22 23 24 lint-diagnostics dependency-policy copy-clones nested-locks review-finding a-discarded-error-is-explained")
def tool_fact_findings(spark, sf):
    f = store(spark, sf).facts
    sites = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda s: s < F.col("event_id") % 3), lambda s: F.concat(F.lit("g"), F.col("generation").cast("string"), F.lit("/"), s.cast("string")))
    f = f.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("path"), "event_type", sites.alias("sites"))
    parts = [R.passthrough(f.filter(F.col("event_type") == e), r, "path", "sites") for r, e in _TOOLS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("unresolved_mirrors", "WITH d AS (SELECT n_name AS path, CASE WHEN n_nationkey % 4 <> 0 THEN 'T' || (n_nationkey % 8) END AS name FROM nation) SELECT rule, path, name FROM (SELECT unnest(['completeness-mirror', 'guarantee-declares-its-exerciser']) AS rule), d WHERE name IS NULL OR name NOT IN ('T1', 'T2', 'T5')", covers="106 164 completeness-mirror guarantee-declares-its-exerciser")
def unresolved_mirrors(spark, sf):
    k = F.col("n_nationkey")
    d = store(spark, sf).table("nation").select(F.col("n_name").alias("path"), F.when(k % 4 != 0, F.concat(F.lit("T"), (k % 8).cast("string"))).alias("name"))
    there = spark.createDataFrame([("T1",), ("T2",), ("T5",)], "name string")
    return R.unresolved(d, there, "completeness-mirror").unionByName(R.unresolved(d, there, "guarantee-declares-its-exerciser"))


@query("standards_corpus", "SELECT 'standards-corpus' AS rule, 'src' || (i % 25) || '/' || i AS path, CASE WHEN 'src' || (i % 25) || '/' || i IN (SELECT path FROM docs) THEN 'read' ELSE 'absent' END AS state FROM (SELECT unnest(range(0, 100)) AS i)", covers="standards-corpus")
def standards_corpus(spark, sf):
    i = F.col("id")
    declared = spark.range(100).select(F.concat(F.lit("src"), (i % 25).cast("string"), F.lit("/"), i.cast("string")).alias("path"))
    return R.corpus_documents(store(spark, sf).docs, declared)


_AXES = ["nesting-depth-max", "parameter-count-max", "file-lines-max"]


@query("undeclared_policy_keys", f"SELECT 'undeclared-policy-key' AS rule, key, language FROM (SELECT CASE WHEN p_partkey % 5 < 3 THEN {list(_AXES)}[(p_partkey % 5 + 1)::INT] ELSE 'key-' || p_partkey END AS key, CASE WHEN p_partkey % 2 = 0 THEN 'go' END AS language FROM part) WHERE key NOT IN ({', '.join(T(x) for x in _AXES)})", covers="undeclared-policy-key")
def undeclared_policy_keys(spark, sf):
    k = F.col("p_partkey")
    axis = F.get(F.array(*[F.lit(x) for x in _AXES]), (k % 5).cast("int"))
    policy = store(spark, sf).table("part").select(F.coalesce(axis, F.concat(F.lit("key-"), k.cast("string"))).alias("key"), F.when(k % 2 == 0, "go").alias("language"))
    return R.undeclared_keys(policy, _AXES)


@query("role_surface_pairs", "SELECT 'declared-role-matches-surface' AS rule, path, 'AgentRequired' AS applicability FROM sources WHERE language = 'rust'", covers="declared-role-matches-surface")
def role_surface_pairs(spark, sf):
    """Pairs of a declared role and a surface need a model's judgment; the engine only says so."""
    return Q.population(store(spark, sf).sources.withColumnRenamed("language", "lang"), ["rust"]).select(F.lit("declared-role-matches-surface").alias("rule"), "path", F.lit("AgentRequired").alias("applicability"))


@query("registered_rules", f"SELECT rule, count(*) AS n FROM ({KEPT_SQL}) WHERE rule IN ('no-trailing-whitespace', 'unsafe-justification') GROUP BY 1", covers="221 225 233")
def registered_rules(spark, sf):
    """Two registered descriptors: one judged anew, one reused as no family it reads changed."""
    by_id = {r.id: r for r in R.TEXT_RULES}
    own = lambda i: lambda s: R.judge(s, [by_id[i]])
    rules = [RuleDescriptor("no-trailing-whitespace", own("no-trailing-whitespace")), RuleDescriptor("unsafe-justification", own("unsafe-justification"), facts=("syntax",), languages=("rust",))]
    s = store(spark, sf).sources.select("path", "language", "text")
    recorded = judge_all(rules[1:], s)
    return judge_all(rules, s, reuse=recorded, changed={"limits"}).groupBy("rule").agg(F.count("*").alias("n"))


# ---- incremental checks ----------------------------------------------------------------------

# The record of the run before: every source of an even document, one in ten since edited.
_EDITED = "CASE WHEN doc_id % 10 = 4 THEN text || ' edited' ELSE text END"


def _record(s):
    d = F.col("doc_id")
    before = s.filter(d % 2 == 0).withColumn("text", F.when(d % 10 == 4, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))).select("path", "language", "text")
    return before, I.digests(before)


@query("incremental_check", JUDGED_SQL, covers="220 221 225")
def incremental_check(spark, sf):
    """Reused and fresh findings together are those of judging everything anew."""
    s = store(spark, sf).sources
    before, recorded = _record(s)
    return I.recheck(s.select("path", "language", "text"), recorded, R.judge(before), R.judge)


@query("incremental_cost", f"SELECT count(*) AS sources, count_if(NOT (doc_id % 2 = 0 AND {_EDITED} = text))::BIGINT AS materialisations FROM sources", covers="220 225")
def incremental_cost(spark, sf):
    s = store(spark, sf).sources
    return I.cost(s.select("path", "language", "text"), _record(s)[1])


# The tree of the run before: sources of even documents, one in ten since edited, and one of each odd document that is gone.
_BEFORE_SQL = f"SELECT doc_id, path, language, {_EDITED} AS text FROM sources WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, path || '.gone', language, text FROM sources WHERE doc_id % 2 = 1"
_JUDGED_BEFORE_SQL = KEPT_SQL.replace("FROM sources)", f"FROM ({_BEFORE_SQL}))")


def _resident(spark, sf):
    """A record of two runs: the tree before, and the tree as it is."""
    s = store(spark, sf).sources
    d = F.col("doc_id")
    even = s.filter(d % 2 == 0).withColumn("text", F.when(d % 10 == 4, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    before = even.unionByName(s.filter(d % 2 == 1).withColumn("path", F.concat("path", F.lit(".gone"))))
    record = I.Record(spark, f"{G.shared_folder(spark)}/records/{uuid.uuid4().hex}")
    record.update(before.select("path", "language", "text"), _judge_kept, 0, whole=True)
    record.update(s.select("path", "language", "text"), _judge_kept, 1, whole=True)
    return record


@query("resident_findings", KEPT_SQL, covers="220 221 225")
def resident_findings(spark, sf):
    """The kept findings after a run over what changed are those of judging everything anew."""
    return _resident(spark, sf).findings()


@query("resident_changes", f"WITH a AS ({KEPT_SQL}), b AS ({_JUDGED_BEFORE_SQL}) SELECT 'added' AS change, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'withdrawn', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)", covers="225")
def resident_changes(spark, sf):
    return _resident(spark, sf).changes(1)
