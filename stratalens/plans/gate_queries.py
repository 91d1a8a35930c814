"""Queries over findings: partition, allowances, phases, comparison of runs, policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered as O, text as X
from ..operators import filters as Q, gate as G, policy as P, providers as V
from .registry import query
from .store import store

NOW = 50  # the moment, as a number, at which expiries are judged


def _calibrated(spark):
    return spark.createDataFrame([(1, "short-text"), (2, "short-text"), (3, "no-such-rule")], "entry_no int, rule string")


def _suppressions(spark):
    rows = [(1, "shouting", "src1", 100), (2, "shouting", "src1", 10), (3, "shouting", "src2", 10), (4, "license-line", "src3", None), (5, "long-text", "nowhere", None)]
    return spark.createDataFrame(rows, "entry_no int, rule string, subject string, expires int")


def _baseline(spark):
    rows = [(1, "long-text", "src0", 1), (2, "long-text", "src1", 1000), (3, "long-text", "src4", None), (4, "long-text", "src0", 500), (5, "shouting", "src5", 2), (6, "shouting", "elsewhere", 1), (7, "license-line", "src6", 3)]
    return spark.createDataFrame(rows, "entry_no int, rule string, subject string, allowance int")


_CAL = "cal(entry_no, rule) AS (VALUES (1, 'short-text'), (2, 'short-text'), (3, 'no-such-rule'))"
_SUP = "sup(entry_no, rule, subject, expires) AS (VALUES (1, 'shouting', 'src1', 100), (2, 'shouting', 'src1', 10), (3, 'shouting', 'src2', 10), (4, 'license-line', 'src3', NULL), (5, 'long-text', 'nowhere', NULL))"
_BASE = "base(entry_no, rule, subject, allowance) AS (VALUES (1, 'long-text', 'src0', 1), (2, 'long-text', 'src1', 1000), (3, 'long-text', 'src4', NULL), (4, 'long-text', 'src0', 500), (5, 'shouting', 'src5', 2), (6, 'shouting', 'elsewhere', 1), (7, 'license-line', 'src6', 3))"
_EVIDENCE = "list_position(['AgentJudged', 'HumanAsserted', 'Predicted', 'Approximate', 'Derived', 'Observed', 'Verified', 'Authoritative'], evidence)"
_FAIL = "gate = 'Blocking' AND applicability IN ('Supported', 'SupportedWithFallback', 'PartiallySupported')"
_FRAME = lambda x: f"strlen({x}) || ':' || {x}"
_LOCS = "coalesce(array_to_string(list_transform(locations, lambda x: strlen(x) || ':' || x), ''), '')"
OCCURRENCE_SQL = f"sha256({_FRAME('rule')} || {_FRAME('subject')} || {_FRAME('summary')} || strlen({_LOCS}) || ':' || {_LOCS})"
LINE_SQL = f"sha256({_FRAME('rule')} || {_FRAME('subject')} || {_FRAME('summary')})"

# Continuity of a lineage over recorded states 1 to 4: derived from subjects.
_HISTORY = f"hist AS (SELECT DISTINCT {LINE_SQL} AS line, CASE WHEN lang = 'de' THEN 'recreated' ELSE 'exact' END AS continuity FROM findings)"

PARTITION_SQL = f"""
WITH {_CAL}, {_SUP}, {_BASE}, {_HISTORY},
b1 AS (SELECT rule, subject, arg_min(coalesce(allowance, -1), entry_no) AS allowance FROM base GROUP BY ALL),
f AS (SELECT *, {OCCURRENCE_SQL} AS occurrence, {LINE_SQL} AS line FROM findings WHERE {_FAIL}),
l AS (SELECT f.*, b1.allowance, CASE WHEN {_EVIDENCE} < 4 THEN 'below-floor' WHEN f.rule IN (SELECT rule FROM cal) THEN 'calibrated' WHEN EXISTS (SELECT 1 FROM sup WHERE sup.rule = f.rule AND sup.subject = f.subject AND (expires IS NULL OR expires > {NOW})) THEN 'suppressed' WHEN b1.rule IS NOT NULL THEN 'tolerated' ELSE 'blocking' END AS first FROM f LEFT JOIN b1 ON b1.rule = f.rule AND b1.subject = f.subject),
c AS (SELECT *, count_if(first = 'tolerated') OVER (PARTITION BY rule, subject) AS observed FROM l)
SELECT doc_id, rule, subject, occurrence, CASE WHEN first <> 'tolerated' THEN first WHEN allowance >= 0 AND observed > allowance THEN 'baseline-exceeded' WHEN (SELECT continuity FROM hist WHERE hist.line = c.line) = 'recreated' THEN 'recreated' ELSE 'baselined' END AS bucket FROM c"""


def _partitioned(spark, sf):
    f = G.with_identity(store(spark, sf).findings)
    history = f.groupBy("line").agg(F.when(F.first("lang") == "de", "recreated").otherwise("exact").alias("continuity"))
    return G.partition(f, floor="Approximate", calibrated=_calibrated(spark), suppressions=_suppressions(spark), baseline=_baseline(spark), now=NOW, history=history)


@query("gate_partition", PARTITION_SQL, covers="64 65 107 108 125 173 174 190 249")
def gate_partition(spark, sf):
    return _partitioned(spark, sf).select("doc_id", "rule", "subject", "occurrence", "bucket")


@query("gate_buckets", f"SELECT bucket, rule, count(*) AS n FROM ({PARTITION_SQL}) GROUP BY ALL", covers="249")
def gate_buckets(spark, sf):
    return _partitioned(spark, sf).groupBy("bucket", "rule").agg(F.count("*").alias("n"))


@query("run_disposition", f"SELECT CASE WHEN bool_or(bucket IN ('blocking', 'baseline-exceeded', 'recreated')) THEN 'failed' ELSE 'passed' END AS disposition FROM ({PARTITION_SQL})", covers="130")
def run_disposition(spark, sf):
    return G.run_disposition(_partitioned(spark, sf))


@query("coverage_claim", "SELECT CASE WHEN bool_or(applicability IN ('MissingCapability', 'ProviderUnavailable', 'DependencyUnavailable', 'Unparseable', 'AnalysisFailed')) THEN 'incomplete' ELSE 'complete' END AS claim FROM findings", covers="66 129")
def coverage_claim(spark, sf):
    return G.claim(store(spark, sf).findings)


@query("rule_coverage", "SELECT rule, count_if(applicability IN ('Supported', 'SupportedWithFallback', 'PartiallySupported'))::BIGINT AS evaluated, count_if(applicability IN ('MissingCapability', 'ProviderUnavailable', 'DependencyUnavailable', 'Unparseable', 'AnalysisFailed'))::BIGINT AS debt FROM findings GROUP BY 1", covers="66")
def rule_coverage(spark, sf):
    return G.coverage(store(spark, sf).findings)


@query("explained_finding", f"SELECT * FROM ({PARTITION_SQL}) WHERE occurrence = (SELECT min(occurrence) FROM ({PARTITION_SQL}))", covers="250")
def explained_finding(spark, sf):
    p = _partitioned(spark, sf).select("doc_id", "rule", "subject", "occurrence", "bucket")
    least = p.agg(F.min("occurrence").alias("m"))
    return p.join(F.broadcast(least), F.col("occurrence") == F.col("m")).drop("m")


@query("found_finding", "SELECT rule, subject, summary, locations FROM findings WHERE rule = 'license-line' AND list_contains(locations, 'shared/en') ORDER BY subject, summary, locations LIMIT 1", covers="67 153")
def found_finding(spark, sf):
    return Q.find(store(spark, sf).findings, "license-line", "shared/en").select("rule", "subject", "summary", "locations")


@query("scoped_findings", "SELECT doc_id, rule FROM findings WHERE len(locations) = 0 OR len(list_filter(locations, lambda p: (p = 'src1' OR starts_with(p, 'src1/') OR p = 'shared' OR starts_with(p, 'shared/')) AND NOT (p = 'shared/de' OR starts_with(p, 'shared/de/')))) > 0", covers="61 62")
def scoped_findings(spark, sf):
    return store(spark, sf).findings.filter(Q.admitted("locations", ["src1", "shared"], ["shared/de"])).select("doc_id", "rule")


@query("selected_findings", "SELECT doc_id, rule, lang FROM findings WHERE rule IN ('shouting', 'short-text') AND lang IN ('en', 'fr')", covers="63 68")
def selected_findings(spark, sf):
    f = store(spark, sf).findings
    return Q.population(f.filter(Q.selected_rules("rule", ["shouting", "short-text"])), ["en", "fr"]).select("doc_id", "rule", "lang")


@query("baseline_populations", f"WITH {_BASE}, b1 AS (SELECT rule, subject, nullif(arg_min(coalesce(allowance, -1), entry_no), -1) AS allowance FROM base GROUP BY ALL) SELECT *, CASE WHEN allowance IS NULL THEN 0 ELSE greatest(observed - allowance, 0) END::BIGINT AS excess FROM (SELECT f.rule, f.subject, allowance, count(*) AS observed FROM findings f JOIN b1 USING (rule, subject) GROUP BY 1, 2, 3)", covers="125 126")
def baseline_populations(spark, sf):
    return G.baseline_populations(store(spark, sf).findings, _baseline(spark))


@query("unmatched_policy", f"WITH {_BASE} SELECT entry_no, rule, subject FROM base b WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.rule = b.rule AND f.subject = b.subject)", covers="109")
def unmatched_policy(spark, sf):
    return G.unmatched_entries(_baseline(spark), store(spark, sf).findings, ["rule", "subject"]).select("entry_no", "rule", "subject")


_PHASES = [(1, "style", ["short-text"], 100000), (2, "tone", ["shouting", "none"], 3), (3, "size", ["long-text"], 0), (4, "legal", ["license-line"], 5), (5, "empty", [], 0)]
PHASES_SQL = "WITH p(phase_no, phase, rules, most) AS (VALUES (1, 'style', ['short-text'], 100000), (2, 'tone', ['shouting', 'none'], 3), (3, 'size', ['long-text'], 0), (4, 'legal', ['license-line'], 5), (5, 'empty', []::VARCHAR[], 0)), c AS (SELECT p.*, (SELECT count(*) FROM findings f WHERE list_contains(p.rules, f.rule)) AS blocking FROM p), x AS (SELECT *, blocking > most AND phase <> 'tone' AS failed FROM c) SELECT phase_no, phase, blocking, CASE WHEN EXISTS (SELECT 1 FROM x e WHERE e.phase_no < x.phase_no AND e.failed) THEN 'skipped' WHEN failed THEN 'failed' ELSE 'passed' END AS disposition FROM x"


def _phases(spark, sf):
    declared = spark.createDataFrame(_PHASES, "phase_no int, phase string, rules array<string>, most int")
    return declared, G.phases(store(spark, sf).findings, declared, spark.createDataFrame([("tone",)], "phase string"))


@query("gate_phases", PHASES_SQL, covers="127 149")
def gate_phases(spark, sf):
    return _phases(spark, sf)[1]


@query("phased_disposition", f"WITH o AS ({PHASES_SQL}) SELECT CASE WHEN (SELECT bool_or(disposition = 'failed') FROM o) THEN 'failed' ELSE 'passed' END AS disposition", covers="128")
def phased_disposition(spark, sf):
    declared, outcomes = _phases(spark, sf)
    return G.phased_disposition(F.lit("failed"), store(spark, sf).findings, declared, outcomes)


_RUNS = f"runs AS (SELECT doc_id, {OCCURRENCE_SQL} AS occurrence, gate, evidence FROM findings), a AS (SELECT CASE WHEN doc_id % 4 = 1 THEN 'old:' || occurrence ELSE occurrence END AS occurrence, min(gate) AS bucket, min(evidence) AS reason FROM runs GROUP BY 1), b AS (SELECT CASE WHEN doc_id % 5 = 2 THEN 'new:' || occurrence ELSE occurrence END AS occurrence, min(CASE WHEN doc_id % 10 = 3 THEN 'Review' ELSE gate END) AS bucket, min(CASE WHEN doc_id % 10 = 7 THEN NULL ELSE evidence END) AS reason FROM runs GROUP BY 1)"


def _runs(spark, sf):
    f = G.with_identity(store(spark, sf).findings)
    d = F.col("doc_id")
    renamed = lambda where, mark: F.when(where, F.concat(F.lit(mark), "occurrence")).otherwise(F.col("occurrence")).alias("occurrence")
    a = f.groupBy(renamed(d % 4 == 1, "old:")).agg(F.min("gate").alias("bucket"), F.min("evidence").alias("reason"))
    b = f.groupBy(renamed(d % 5 == 2, "new:")).agg(F.min(F.when(d % 10 == 3, "Review").otherwise(F.col("gate"))).alias("bucket"), F.min(F.when(d % 10 == 7, None).otherwise(F.col("evidence"))).alias("reason"))
    return a, b


@query("gate_compare", f"WITH {_RUNS} SELECT coalesce(a.occurrence, b.occurrence) AS occurrence, CASE WHEN a.occurrence IS NULL THEN 'added' WHEN b.occurrence IS NULL THEN 'removed' ELSE 'changed' END AS change, a.bucket AS bucket_before, b.bucket AS bucket_after FROM a FULL JOIN b ON a.occurrence = b.occurrence WHERE a.occurrence IS NULL OR b.occurrence IS NULL OR a.bucket IS DISTINCT FROM b.bucket OR a.reason IS DISTINCT FROM b.reason", covers="95 98")
def gate_compare(spark, sf):
    return G.compare_runs(*_runs(spark, sf))


@query("gate_added", f"WITH {_RUNS} SELECT * FROM b WHERE occurrence NOT IN (SELECT occurrence FROM a)", covers="96")
def gate_added(spark, sf):
    return G.added(*_runs(spark, sf))


@query("gate_removed", f"WITH {_RUNS} SELECT * FROM a WHERE occurrence NOT IN (SELECT occurrence FROM b)", covers="97")
def gate_removed(spark, sf):
    return G.removed(*_runs(spark, sf))


@query("occurrence_collisions", f"SELECT occurrence, path, rn FROM (SELECT path, {OCCURRENCE_SQL} AS occurrence, row_number() OVER (PARTITION BY {OCCURRENCE_SQL} ORDER BY path, doc_id) AS rn FROM findings) WHERE rn > 1", covers="133")
def occurrence_collisions(spark, sf):
    return G.collisions(G.with_identity(store(spark, sf).findings))


@query("lineage_continuity", f"WITH o AS (SELECT DISTINCT {LINE_SQL} AS line, 1 + doc_id % 4 AS state FROM findings), t AS (SELECT line, min(state) AS first, max(state) AS last, count(*) AS seen FROM o GROUP BY 1) SELECT line, CASE WHEN seen < last - first + 1 OR last < 4 THEN 'recreated' WHEN seen = 4 THEN 'exact' ELSE 'none' END AS continuity FROM t", covers="148 223")
def lineage_continuity(spark, sf):
    f = G.with_identity(store(spark, sf).findings)
    states = spark.createDataFrame([(1,), (2,), (3,), (4,)], "state bigint")
    return G.continuity(f.select("line", (1 + F.col("doc_id") % 4).alias("state")), states)


# ---- policies --------------------------------------------------------------------------------


@query("scoped_limits", "WITH l(key, language, value) AS (VALUES ('size', 'en', 10), ('size', NULL, 20), ('other', 'fr', 5)) SELECT doc_id, coalesce((SELECT value FROM l WHERE key = 'size' AND language = d.lang), (SELECT value FROM l WHERE key = 'size' AND language IS NULL)) AS \"limit\" FROM docs d", covers="195")
def scoped_limits(spark, sf):
    limits = spark.createDataFrame([("size", "en", 10), ("size", None, 20), ("other", "fr", 5)], "key string, language string, value int")
    return P.scoped_limits(store(spark, sf).docs.select("doc_id", "lang"), limits, "size").select("doc_id", "limit")


_LAYERS_SQL = "layers AS (SELECT (n_nationkey % 3)::INT AS layer, n_nationkey::INT AS position, 'k' || (n_nationkey % 9) AS key, n_name AS value FROM nation)"


def _layers(s):
    n = F.col("n_nationkey")
    return s.table("nation").select((n % 3).cast("int").alias("layer"), n.cast("int").alias("position"), F.concat(F.lit("k"), (n % 9).cast("string")).alias("key"), F.col("n_name").alias("value"))


@query("effective_policy", f"WITH {_LAYERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY layer DESC, position) AS rn, min((layer, position)) OVER (PARTITION BY key) AS f FROM layers) SELECT key, value, layer, f[1] AS first_layer, f[2] AS first_position FROM r WHERE rn = 1", covers="261 262 263")
def effective_policy(spark, sf):
    return P.effective(_layers(store(spark, sf)))


@query("displaced_policy", "WITH layers AS (SELECT (n_nationkey % 2)::INT AS layer, 'k' || (n_nationkey % 5) AS key, n_name AS value FROM nation) SELECT key, layer, value FROM layers l WHERE layer < (SELECT max(layer) FROM layers m WHERE m.key = l.key)", covers="263")
def displaced_policy(spark, sf):
    n = F.col("n_nationkey")
    return P.displaced(store(spark, sf).table("nation").select((n % 2).cast("int").alias("layer"), F.concat(F.lit("k"), (n % 5).cast("string")).alias("key"), F.col("n_name").alias("value")))


@query("policy_contradictions", f"WITH {_LAYERS_SQL} SELECT layer, key, count(DISTINCT value) AS values FROM layers GROUP BY ALL HAVING count(DISTINCT value) > 1", covers="264")
def policy_contradictions(spark, sf):
    return P.contradictions(_layers(store(spark, sf)))


@query("absent_layers", f"WITH {_LAYERS_SQL} SELECT layer FROM (VALUES (0), (1), (2), (3), (4)) k(layer) WHERE layer NOT IN (SELECT layer FROM layers)", covers="265")
def absent_layers(spark, sf):
    return P.absent_layers(spark.createDataFrame([(i,) for i in range(5)], "layer int"), _layers(store(spark, sf)))


_GOALS_SQL = "goals AS (SELECT r_name AS goal FROM region UNION ALL SELECT 'UNSERVED'), parts AS (SELECT n_name AS part, CASE n_nationkey % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [r_name] WHEN 2 THEN [r_name, 'UNDECLARED'] ELSE [r_name, 'ASIA'] END AS serves FROM nation JOIN region ON r_regionkey = n_regionkey)"


def _goals(s):
    goals = s.table("region").select(F.col("r_name").alias("goal")).union(s.spark.createDataFrame([("UNSERVED",)], "goal string"))
    n = s.table("nation").join(s.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    k = F.col("n_nationkey") % 4
    serves = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("r_name")).when(k == 2, F.array("r_name", F.lit("UNDECLARED"))).otherwise(F.array("r_name", F.lit("ASIA")))
    return goals, n.select(F.col("n_name").alias("part"), serves.alias("serves"))


@query("goal_coverage", f"WITH {_GOALS_SQL}, s AS (SELECT goal, count(DISTINCT part) AS n FROM (SELECT part, unnest(serves) AS goal FROM parts) GROUP BY 1) SELECT g.goal, coalesce(n, 0)::BIGINT AS servers, CASE WHEN coalesce(n, 0) = 0 THEN 'orphaned' WHEN n > 4 THEN 'smeared' ELSE 'served' END AS standing FROM goals g LEFT JOIN s USING (goal)", covers="131 goals-and-parts-line-up")
def goal_coverage(spark, sf):
    return P.goal_coverage(*_goals(store(spark, sf)), 4)


@query("goal_mismatches", f"WITH {_GOALS_SQL} SELECT DISTINCT part AS name, 'undeclared-goal' AS problem FROM (SELECT part, unnest(serves) AS goal FROM parts) WHERE goal NOT IN (SELECT goal FROM goals) UNION ALL SELECT part, 'serves-nothing' FROM parts WHERE len(serves) = 0", covers="131")
def goal_mismatches(spark, sf):
    return P.goal_mismatches(*_goals(store(spark, sf)))


_EDGES_SQL = "deps AS (SELECT s_suppkey % 97 AS package, (s_suppkey * 5 + 2) % 97 AS target, CASE WHEN s_suppkey % 10 = 0 THEN 'dev' ELSE 'normal' END AS kind FROM supplier UNION SELECT c_custkey % 97, (c_custkey * 3 + 1) % 97, 'normal' FROM customer), placement AS (SELECT p AS package, 'c' || (p % 4) AS component FROM (SELECT unnest(range(0, 97)) AS p) WHERE p % 13 <> 0)"


def _edges(s):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    a = s.table("supplier").select((k % 97).alias("package"), ((k * 5 + 2) % 97).alias("target"), F.when(k % 10 == 0, "dev").otherwise("normal").alias("kind"))
    b = s.table("customer").select((c % 97).alias("package"), ((c * 3 + 1) % 97).alias("target"), F.lit("normal").alias("kind"))
    p = s.spark.range(97).filter("id % 13 <> 0").select(F.col("id").alias("package"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("component"))
    return a.union(b).distinct(), p


@query("dependency_direction", f"WITH {_EDGES_SQL}, permits(f, t) AS (VALUES ('c0', 'c1'), ('c1', 'c2'), ('c2', 'c3')) SELECT d.package, d.target, d.kind, CASE WHEN d.kind = 'dev' THEN 'not-judged' WHEN a.component IS NULL OR b.component IS NULL THEN 'unplaced' WHEN a.component = b.component THEN 'inside' WHEN (a.component, b.component) IN (SELECT (f, t) FROM permits) THEN 'permitted' WHEN d.package = 5 AND d.target = 16 OR d.package = 6 AND d.target = 19 THEN 'excepted' ELSE 'violation' END AS verdict FROM deps d LEFT JOIN placement a ON a.package = d.package LEFT JOIN placement b ON b.package = d.target", covers="103 104 dependency-direction")
def dependency_direction(spark, sf):
    edges, placement = _edges(store(spark, sf))
    permits = spark.createDataFrame([("c0", "c1"), ("c1", "c2"), ("c2", "c3")], "from_component string, to_component string")
    return P.admissible(edges, placement, permits, spark.createDataFrame([(5, 16), (6, 19)], "package bigint, target bigint"))


@query("dependency_completeness", f"WITH {_EDGES_SQL} SELECT DISTINCT package FROM deps WHERE package NOT IN (SELECT package FROM placement)", covers="dependency-completeness")
def dependency_completeness(spark, sf):
    edges, placement = _edges(store(spark, sf))
    return P.unplaced(edges.select("package").distinct(), placement)


@query("dependency_write_authority", f"WITH {_EDGES_SQL} SELECT package, target FROM deps WHERE target IN (7, 22) AND (target, package) NOT IN (SELECT (7, 1) UNION SELECT (22, 4))", covers="dependency-write-authority")
def write_authority(spark, sf):
    edges, _ = _edges(store(spark, sf))
    return P.write_authority(edges, spark.createDataFrame([(7, 1), (22, 4)], "authority bigint, door bigint"))


_TRACE_SQL = "trace AS (SELECT p_partkey AS entry, CASE p_partkey % 3 WHEN 0 THEN 'partial' WHEN 1 THEN 'diverged' ELSE 'met' END AS assessment, CASE WHEN p_partkey % 4 <> 0 THEN 's' || (p_partkey % 50) END AS site, CASE WHEN p_partkey % 6 = 0 THEN 'g' || (p_partkey % 20) END AS gap, CASE WHEN p_partkey % 5 = 1 THEN 'r' || (p_partkey % 30) END AS record FROM part)"


@query("requirement_trace", f"WITH {_TRACE_SQL} SELECT entry, 'partial-without-gap' AS problem FROM trace WHERE assessment = 'partial' AND gap IS NULL UNION ALL SELECT entry, 'divergence-without-record' FROM trace WHERE assessment = 'diverged' AND record IS NULL UNION ALL SELECT entry, 'unresolved-site' FROM trace WHERE site IS NOT NULL AND site NOT IN (SELECT 's' || i FROM (SELECT unnest(range(0, 40)) AS i)) UNION ALL SELECT entry, 'unresolved-gap' FROM trace WHERE gap IS NOT NULL AND gap NOT IN (SELECT 'g' || i FROM (SELECT unnest(range(0, 10)) AS i)) UNION ALL SELECT entry, 'unresolved-record' FROM trace WHERE record IS NOT NULL AND record NOT IN (SELECT 'r' || i FROM (SELECT unnest(range(0, 20)) AS i))", covers="266 267 268 269 270 requirement-trace-staleness")
def requirement_trace(spark, sf):
    k = F.col("p_partkey")
    name = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    trace = store(spark, sf).table("part").select(k.alias("entry"), F.when(k % 3 == 0, "partial").when(k % 3 == 1, "diverged").otherwise("met").alias("assessment"), F.when(k % 4 != 0, name("s", 50)).alias("site"), F.when(k % 6 == 0, name("g", 20)).alias("gap"), F.when(k % 5 == 1, name("r", 30)).alias("record"))
    known = lambda c, p, n: spark.range(n).select(F.concat(F.lit(p), F.col("id").cast("string")).alias(c))
    return P.trace_problems(trace, known("site", "s", 40), known("gap", "g", 10), known("record", "r", 20))


@query("cross_language_correspondence", "WITH s AS (SELECT n_name AS name, CASE WHEN n_nationkey % 4 < 3 THEN 'GO_' || CASE WHEN n_nationkey % 8 = 1 THEN 'X' ELSE '' END || n_name END AS counterpart, [n_name, 'f' || n_regionkey, 'id'] AS fields FROM nation), g AS (SELECT 'GO_' || n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN [n_name, 'f' || n_regionkey, 'id'] ELSE ['id', 'extra'] END AS fields FROM nation) SELECT s.name, counterpart, list_sort(list_filter(s.fields, lambda x: NOT list_contains(coalesce(g.fields, []), x))) AS missing, list_sort(list_filter(coalesce(g.fields, []), lambda x: NOT list_contains(s.fields, x))) AS extra, CASE WHEN g.name IS NULL THEN 'unresolved' WHEN n.n_nationkey % 2 = 0 THEN 'corresponds' ELSE 'differs' END AS verdict FROM s JOIN nation n ON n.n_name = s.name LEFT JOIN g ON g.name = s.counterpart WHERE counterpart IS NOT NULL", covers="105 cross-language-correspondence")
def cross_language(spark, sf):
    n = store(spark, sf).table("nation")
    k = F.col("n_nationkey")
    fields = F.array("n_name", F.concat(F.lit("f"), F.col("n_regionkey").cast("string")), F.lit("id"))
    left = n.select(F.col("n_name").alias("name"), F.when(k % 4 < 3, F.concat(F.lit("GO_"), F.when(k % 8 == 1, "X").otherwise(""), "n_name")).alias("counterpart"), fields.alias("fields"))
    right = n.select(F.concat(F.lit("GO_"), "n_name").alias("name"), F.when(k % 2 == 0, fields).otherwise(F.array(F.lit("id"), F.lit("extra"))).alias("fields"))
    return P.correspondence(left, right)


# ---- providers -------------------------------------------------------------------------------

_OFFER_SQL = "offers AS (SELECT 'cap' || (n_regionkey % 2) AS capability, n_name AS provider, list_extract(['Predicted', 'Approximate', 'Syntactic', 'SemanticallyResolved', 'RuntimeObserved'], (n_nationkey % 5 + 1)::INT) AS variant, list_extract(['Sound', 'Unsound', 'Unknown'], (n_nationkey % 3 + 1)::INT) AS soundness, list_extract(['Unknown', 'Sound'], (n_nationkey % 2 + 1)::INT) AS completeness, list_extract(['File', 'Project', 'Symbol', 'WholeWorkspace'], (n_nationkey % 4 + 1)::INT) AS incremental FROM nation)"
_VR = "list_position(['Predicted', 'Approximate', 'Syntactic', 'SemanticallyResolved', 'RuntimeObserved'], {0}.variant)"
_GR = "list_position(['None', 'WholeWorkspace', 'Project', 'File', 'Symbol', 'Region'], {0}.incremental)"


def _reaches(a, b):
    return f"({_VR.format(a)} >= {_VR.format(b)} AND ({b}.soundness <> 'Sound' OR {a}.soundness = 'Sound') AND ({b}.completeness <> 'Sound' OR {a}.completeness = 'Sound') AND {_GR.format(a)} >= {_GR.format(b)})"


def _offers(s):
    k = F.col("n_nationkey")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    return s.table("nation").select(F.concat(F.lit("cap"), (F.col("n_regionkey") % 2).cast("string")).alias("capability"), F.col("n_name").alias("provider"), pick(O.VARIANT).alias("variant"), pick(["Sound", "Unsound", "Unknown"]).alias("soundness"), pick(["Unknown", "Sound"]).alias("completeness"), pick(["File", "Project", "Symbol", "WholeWorkspace"]).alias("incremental"))


@query("provider_standings", f"WITH {_OFFER_SQL} SELECT a.capability, a.provider, b.provider AS against, CASE WHEN {_reaches('a', 'b')} AND {_reaches('b', 'a')} THEN 'equivalent' WHEN {_reaches('a', 'b')} THEN 'stronger' WHEN {_reaches('b', 'a')} THEN 'weaker' ELSE 'incomparable' END AS standing FROM offers a JOIN offers b ON a.capability = b.capability AND a.provider <> b.provider", covers="192 193")
def provider_standings(spark, sf):
    return V.standings(_offers(store(spark, sf)))


@query("usable_offers", f"WITH {_OFFER_SQL} SELECT * FROM offers WHERE list_position(['Predicted', 'Approximate', 'Syntactic', 'SemanticallyResolved', 'RuntimeObserved'], variant) >= 3 AND soundness = 'Sound' AND list_position(['None', 'WholeWorkspace', 'Project', 'File', 'Symbol', 'Region'], incremental) >= 3", covers="237 238")
def usable_offers(spark, sf):
    return V.usable(_offers(store(spark, sf)), {"variant": "Syntactic", "soundness": "Sound", "completeness": "Unknown", "incremental": "Project"})


# Offers of customers, in the order of their keys: a capability for each nation.
_MANY_SQL = "c AS (SELECT 'cap' || c_nationkey AS capability, c_custkey AS provider, c_custkey AS position, c_custkey % 5 AS v, (c_custkey // 5 % 3 = 0)::INT AS s, (c_custkey // 15 % 2 = 1)::INT AS k, c_custkey // 7 % 4 + 1 AS g FROM customer)"
_ABOVE = "{0}.v >= {1}.v AND {0}.s >= {1}.s AND {0}.k >= {1}.k AND {0}.g >= {1}.g AND ({0}.v, {0}.s, {0}.k, {0}.g) <> ({1}.v, {1}.s, {1}.k, {1}.g)"
_WAYS_SQL = f"""up AS (SELECT a.capability, a.provider AS low, b.provider AS high, b.position FROM c a JOIN c b ON a.capability = b.capability AND {_ABOVE.format('b', 'a')}),
near AS (SELECT capability, high AS x, low AS z FROM up UNION ALL SELECT capability, provider, provider FROM c),
w AS (SELECT capability, x, [min(z)] AS way FROM near GROUP BY ALL
  UNION ALL SELECT capability, x, list_append(any_value(way), min(z)) FROM (SELECT w.capability, w.x, w.way, near.z FROM w JOIN up ON up.low = w.way[-1] JOIN near ON near.x = w.x AND near.z = up.high WHERE w.way[-1] <> w.x) GROUP BY capability, x)"""
RANKING_SQL = f"WITH RECURSIVE {_MANY_SQL}, {_WAYS_SQL} SELECT capability, x AS provider, (row_number() OVER (PARTITION BY capability ORDER BY list_append(way, 4611686018427387904)))::INT AS rank FROM w WHERE way[-1] = x"


def _many_offers(s):
    k = F.col("c_custkey")
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    div = lambda n: F.floor(k / n)
    return s.table("customer").select(F.concat(F.lit("cap"), F.col("c_nationkey").cast("string")).alias("capability"), k.alias("provider"), k.alias("position"), pick(O.VARIANT, k % 5).alias("variant"), pick(["Sound", "Unknown", "Unsound"], div(5) % 3).alias("soundness"), pick(["Unknown", "Sound"], div(15) % 2).alias("completeness"), pick(O.GRANULARITY[1:], div(7) % 4).alias("incremental"))


@query("provider_ranking", RANKING_SQL, covers="150 236")
def provider_ranking(spark, sf):
    return V.rankings(_many_offers(store(spark, sf)))


_RESOLVED_SQL = f"""WITH RECURSIVE {_MANY_SQL.replace('c AS', 'o AS', 1)},
r AS (SELECT s_suppkey AS id, 'cap' || s_nationkey AS capability, s_suppkey % 5 AS v, (s_suppkey % 2 = 0)::INT AS s, 0 AS k, s_suppkey % 3 + 2 AS g, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 3 END AS preferred FROM supplier),
c AS (SELECT r.id AS capability, o.provider, o.position, o.v, o.s, o.k, o.g, o.provider IS NOT DISTINCT FROM r.preferred AS liked FROM r JOIN o ON o.capability = r.capability AND o.v >= r.v AND o.s >= r.s AND o.k >= r.k AND o.g >= r.g),
{_WAYS_SQL.replace('near.x = w.x', 'near.capability = w.capability AND near.x = w.x').replace('up.low = w.way[-1]', 'up.capability = w.capability AND up.low = w.way[-1]')},
best AS (SELECT c.* FROM w JOIN c ON c.capability = w.capability AND c.provider = w.x WHERE way[-1] = x QUALIFY row_number() OVER (PARTITION BY c.capability ORDER BY liked DESC, list_append(way, 4611686018427387904)) = 1)
SELECT r.id, r.capability, best.provider, (SELECT count(*) FROM c f WHERE f.capability = r.id AND {_ABOVE.format('best', 'f')})::BIGINT AS weaker FROM r LEFT JOIN best ON best.capability = r.id"""


@query("resolved_requirements", _RESOLVED_SQL, covers="158 237 238")
def resolved_requirements(spark, sf):
    s, k = store(spark, sf), F.col("s_suppkey")
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    needs = s.table("supplier").select(k.alias("id"), F.concat(F.lit("cap"), F.col("s_nationkey").cast("string")).alias("capability"), pick(O.VARIANT, k % 5).alias("variant"), F.when(k % 2 == 0, "Sound").otherwise("Unknown").alias("soundness"), F.lit("Unknown").alias("completeness"), pick(O.GRANULARITY, k % 3 + 2).alias("incremental"), F.when(k % 4 == 0, k * 3).alias("preferred"))
    return V.resolved(needs, _many_offers(s))


@query("first_materialised_fact", "SELECT user_id, arg_min(payload, (CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, event_id)) AS payload FROM facts WHERE generation = 3 AND event_type IN ('click', 'view', 'error') GROUP BY 1", covers="239")
def first_materialised(spark, sf):
    ranks = spark.createDataFrame([("click", 1), ("view", 2), ("error", 3)], "provider string, rank int")
    f = store(spark, sf).facts.filter("generation = 3").select("user_id", F.col("event_type").alias("provider"), "event_id", "payload")
    return V.first_materialised(f.select("user_id", "provider", "event_id", "payload"), ranks, ["user_id"]).select("user_id", "payload")


@query("broadened_granularity", f"WITH {_OFFER_SQL} SELECT provider, incremental, list_extract(['None', 'WholeWorkspace', 'Project', 'File', 'Symbol', 'Region'], least(list_position(['None', 'WholeWorkspace', 'Project', 'File', 'Symbol', 'Region'], incremental), 4)) AS effective FROM offers WHERE list_position(['None', 'WholeWorkspace', 'Project', 'File', 'Symbol', 'Region'], incremental) < 4", covers="194 200")
def broadened_granularity(spark, sf):
    from ..operators.facts import broadened

    return broadened(_offers(store(spark, sf)), "File").select("provider", "incremental", O.coarser("incremental", F.lit("File")).alias("effective"))


@query("subject_intersections", "WITH s AS (SELECT o_orderkey AS id, ['a' || (o_orderkey % 7), 'b' || (o_orderkey % 5)] AS x, ['b' || (o_orderkey % 3), 'c'] AS y, o_orderkey % 4 = 0 AS u FROM orders) SELECT id, CASE WHEN list_has_any(x, y) THEN 'overlaps' WHEN u THEN 'unknown' ELSE 'disjoint' END AS standing, list_sort(list_intersect(x, y)) AS shared FROM s", covers="111 163 252")
def subject_intersections(spark, sf):
    from ..operators.ledger import intersect

    k = F.col("o_orderkey")
    part = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    s = store(spark, sf).table("orders").select(k.alias("id"), F.array(part("a", 7), part("b", 5)).alias("x"), F.array(part("b", 3), F.lit("c")).alias("y"), (k % 4 == 0).alias("u"))
    return s.select("id", intersect("x", "y", "u", F.lit(False)).alias("standing"), F.sort_array(F.array_intersect("x", "y")).alias("shared"))
