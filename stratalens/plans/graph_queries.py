"""Queries over facts, dependency graphs, the work board and correction plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import facts as V, graph as G, ledger as L, policy as P
from .registry import query
from .store import store

KEYS = ["user_id", "event_type"]

# ---- facts -----------------------------------------------------------------------------------


@query("latest_facts", "SELECT user_id, event_type, max(generation) AS generation, arg_max(payload, generation) AS payload FROM facts GROUP BY 1, 2", covers="140 216")
def latest_facts(spark, sf):
    return V.latest(store(spark, sf).facts, KEYS).select(*KEYS, "generation", "payload")


@query("facts_at_generation", "SELECT user_id, event_type, max(generation) AS generation, arg_max(payload, generation) AS payload FROM facts WHERE generation <= 10 GROUP BY 1, 2", covers="218")
def facts_at_generation(spark, sf):
    return V.current_at(store(spark, sf).facts, KEYS, 10).select(*KEYS, "generation", "payload")


@query("fact_history", "SELECT user_id, event_type, generation, payload, age FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY generation DESC) - 1 AS age FROM facts) WHERE age <= 1", covers="216 219")
def fact_history(spark, sf):
    return V.with_history(store(spark, sf).facts, KEYS).select(*KEYS, "generation", "payload", "age")


_ARRIVING = "arriving AS (SELECT user_id, event_type, generation, payload FROM facts WHERE event_id % 3 = 0), known AS (SELECT user_id, event_type, generation, payload FROM facts WHERE generation <= 15)"


def _arriving(s):
    f = s.facts
    return f.filter("generation <= 15").select(*KEYS, "generation", "payload"), f.filter("event_id % 3 = 0").select(*KEYS, "generation", "payload")


@query("backdated_facts", f"WITH {_ARRIVING} SELECT a.* FROM arriving a JOIN (SELECT user_id, event_type, max(generation) AS g FROM known GROUP BY 1, 2) k USING (user_id, event_type) WHERE a.generation < g", covers="217")
def backdated_facts(spark, sf):
    known, arriving = _arriving(store(spark, sf))
    return V.backdated(known, arriving, KEYS)


@query("materialised_facts", f"WITH {_ARRIVING} SELECT DISTINCT * FROM (SELECT * FROM known UNION ALL SELECT a.* FROM arriving a LEFT JOIN (SELECT user_id, event_type, max(generation) AS g FROM known GROUP BY 1, 2) k USING (user_id, event_type) WHERE g IS NULL OR a.generation >= g)", covers="216")
def materialised_facts(spark, sf):
    known, arriving = _arriving(store(spark, sf))
    return V.materialise(known, arriving, KEYS)


@query("unchanged_facts", "WITH k AS (SELECT user_id, event_type, arg_max(round(payload), generation) AS p FROM facts WHERE generation <= 15 GROUP BY 1, 2) SELECT a.user_id, a.event_type, a.generation FROM facts a JOIN k USING (user_id, event_type) WHERE generation > 15 AND round(a.payload) IS NOT DISTINCT FROM k.p", covers="220")
def unchanged_facts(spark, sf):
    f = store(spark, sf).facts.withColumn("payload", F.round("payload"))
    return V.unchanged(f.filter("generation > 15"), f.filter("generation <= 15"), KEYS, "payload").select(*KEYS, "generation")


@query("caused_facts", "SELECT user_id, event_type, generation FROM facts WHERE event_type IN ('click', 'error') AND generation = 4", covers="197")
def caused_facts(spark, sf):
    return V.caused(store(spark, sf).facts, event_type=["click", "error"], generation=4).select(*KEYS, "generation")


CLOSURE_SQL = "WITH RECURSIVE up(n) AS (SELECT DISTINCT node FROM depends WHERE node % 1000 = 5 UNION SELECT d.node FROM depends d JOIN up ON d.needs = up.n) "


@query("invalidation_closure", CLOSURE_SQL + "SELECT node, CASE WHEN node IN (SELECT n FROM up) THEN 'invalidated' ELSE 'retained' END AS state FROM (SELECT DISTINCT node FROM (SELECT node FROM depends UNION ALL SELECT needs FROM depends))", covers="198 199")
def invalidation_closure(spark, sf):
    d = store(spark, sf).depends
    nodes = d.select("node").union(d.select(F.col("needs").alias("node")))
    return V.invalidated(nodes, d, d.select("node").filter("node % 1000 = 5"))


@query("invalidation_stops", "WITH RECURSIVE up(n) AS (SELECT DISTINCT node FROM depends WHERE node % 1000 = 5 UNION SELECT d.node FROM depends d JOIN up ON d.needs = up.n WHERE d.node % 40 NOT IN (3, 9)) SELECT n AS node FROM up", covers="198")
def invalidation_stops(spark, sf):
    d = store(spark, sf).depends
    edges = d.select(F.col("needs").alias("src"), F.col("node").alias("dst"))
    return G.reach(d.select("node").filter("node % 1000 = 5"), edges, d.select("node").filter("node % 40 in (3, 9)"))


_PATHS = "WITH RECURSIVE e AS (SELECT node AS src, needs AS dst FROM depends), p(src, dst) AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src) "


@query("dependency_closure", _PATHS + "SELECT src, dst FROM p", covers="202")
def dependency_closure(spark, sf):
    return G.closure(store(spark, sf).depends.select(F.col("node").alias("src"), F.col("needs").alias("dst")))


@query("dependency_rings", _PATHS + "SELECT a.src AS node, min(a.dst) AS ring FROM p a JOIN p b ON b.src = a.dst AND b.dst = a.src GROUP BY 1", covers="203")
def dependency_rings(spark, sf):
    return G.rings(store(spark, sf).depends.select(F.col("node").alias("src"), F.col("needs").alias("dst")))


@query("scc_condensation", _PATHS + ", n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT node, coalesce((SELECT min(a.dst) FROM p a JOIN p b ON b.src = a.dst AND b.dst = a.src WHERE a.src = node), node) AS component FROM n), ce AS (SELECT DISTINCT x.component AS a, y.component AS b FROM e JOIN c x ON x.node = e.src JOIN c y ON y.node = e.dst WHERE x.component <> y.component), lv(c, l) AS (SELECT DISTINCT component, 0 FROM c UNION SELECT ce.a, l + 1 FROM ce JOIN lv ON lv.c = ce.b WHERE l < 60) SELECT node, component, (SELECT max(l) FROM lv WHERE lv.c = component) AS level FROM c", covers="201")
def scc_condensation(spark, sf):
    d = store(spark, sf).depends
    nodes = d.select("node").union(d.select(F.col("needs").alias("node")))
    return G.condensation_levels(nodes, d.select(F.col("node").alias("src"), F.col("needs").alias("dst")))


# An acyclic graph: a part needs parts of smaller keys.
_ACYCLIC = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey - 7 FROM part WHERE p_partkey > 7 AND p_partkey % 4 = 0)"


def _acyclic(s):
    k = F.col("p_partkey")
    p = s.table("part")
    a = p.filter(k > 0).select(k.alias("src"), F.floor(k / 2).cast("long").alias("dst"))
    return a.union(p.filter((k > 7) & (k % 4 == 0)).select(k, k - 7)).distinct()


@query("workflow_waves", f"WITH RECURSIVE {_ACYCLIC}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), lv(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.src, level + 1 FROM e JOIN lv ON lv.node = e.dst) SELECT node, max(level) AS level FROM lv GROUP BY 1", covers="208")
def workflow_waves(spark, sf):
    e = _acyclic(store(spark, sf))
    return G.levels(e.select(F.col("src").alias("node")).union(e.select("dst")), e)


@query("wave_cut", f"WITH RECURSIVE {_ACYCLIC}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), lv(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.src, level + 1 FROM e JOIN lv ON lv.node = e.dst), w AS (SELECT node, max(level) AS level FROM lv GROUP BY 1) SELECT node, level, (row_number() OVER (PARTITION BY level ORDER BY node) - 1) // 4 AS chunk FROM w", covers="209")
def wave_cut(spark, sf):
    e = _acyclic(store(spark, sf))
    return G.wave_cut(G.levels(e.select(F.col("src").alias("node")).union(e.select("dst")), e), 4)


@query("module_reachability", f"WITH RECURSIVE {_ACYCLIC}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(node) AS (SELECT 150::BIGINT UNION SELECT 199 UNION SELECT e.dst FROM e JOIN r ON r.node = e.src) SELECT node FROM n WHERE node NOT IN (SELECT node FROM r)", covers="207 no-orphan-modules")
def module_reachability(spark, sf):
    e = _acyclic(store(spark, sf))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return nodes.join(G.reach(spark.createDataFrame([(150,), (199,)], "node bigint"), e), "node", "left_anti")


# ---- snapshots -------------------------------------------------------------------------------

_CHANGES = "cur AS (SELECT path, sha256 AS digest FROM docs WHERE doc_id % 3 <> 0), chg AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN sha256 || 'x' ELSE sha256 END AS digest FROM docs WHERE doc_id % 5 <> 0)"
EFFECTS_SQL = f"WITH {_CHANGES} SELECT coalesce(cur.path, chg.path) AS path, CASE WHEN chg.path IS NULL THEN 'kept' WHEN chg.digest IS NULL AND cur.path IS NULL THEN 'already-absent' WHEN chg.digest IS NULL THEN 'removed' WHEN cur.path IS NULL THEN 'added' WHEN cur.digest = chg.digest THEN 'redundant' ELSE 'modified' END AS effect, CASE WHEN chg.path IS NOT NULL THEN chg.digest ELSE cur.digest END AS digest FROM cur FULL JOIN chg ON cur.path = chg.path"


def _effects(s):
    d = F.col("doc_id")
    cur = s.docs.filter(d % 3 != 0).select("path", F.col("sha256").alias("digest"))
    chg = s.docs.filter(d % 5 != 0).select("path", F.when(d % 4 == 0, None).when(d % 4 == 1, F.concat("sha256", F.lit("x"))).otherwise(F.col("sha256")).alias("digest"))
    return V.apply_changes(cur, chg)


@query("applied_changes", EFFECTS_SQL, covers="213 214 215")
def applied_changes(spark, sf):
    return _effects(store(spark, sf))


@query("generation_advances", f"SELECT bool_or(effect IN ('added', 'modified', 'removed')) AS advances FROM ({EFFECTS_SQL})", covers="213")
def generation_advances(spark, sf):
    return V.advances(_effects(store(spark, sf)))


@query("snapshot_digest", "WITH r AS (SELECT sha256(strlen(path) || ':' || path || strlen(sha256) || ':' || sha256) AS d FROM docs), b AS (SELECT substr(d, 1, 3) AS b, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM r GROUP BY 1) SELECT sha256(string_agg(b || ':' || d, chr(10) ORDER BY b)) AS digest FROM b", covers="49")
def snapshot_digest(spark, sf):
    return V.snapshot_digest(store(spark, sf).docs.select("path", F.col("sha256").alias("digest")))


@query("projection_freshness", "SELECT path AS id, CASE WHEN doc_id % 7 = 0 THEN 'absent' WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'diverged' WHEN doc_id % 3 = 0 THEN 'stale-inputs' WHEN doc_id % 5 = 0 THEN 'edited' ELSE 'fresh' END AS state FROM docs", covers="44 224")
def projection_freshness(spark, sf):
    d, docs = F.col("doc_id"), store(spark, sf).docs
    recorded = docs.select(F.col("path").alias("id"), F.col("sha256").alias("inputs"), F.sha2("sha256", 256).alias("output"))
    inputs = docs.select(F.col("path").alias("id"), F.when(d % 3 == 0, "moved").otherwise(F.col("sha256")).alias("digest"))
    outputs = docs.filter(d % 7 != 0).select(F.col("path").alias("id"), F.when(d % 5 == 0, "edited").otherwise(F.sha2("sha256", 256)).alias("digest"))
    return V.freshness(recorded, inputs, outputs)


# ---- work board ------------------------------------------------------------------------------

NOW = 40
_UNMET = "st AS (SELECT n.id, n.position, n.needs, coalesce(i.state, 'missing') AS need_state FROM item_needs n LEFT JOIN items i ON i.id = n.needs), unmet AS (SELECT id, arg_min(needs, position) AS needs, arg_min(need_state, position) AS need_state FROM st WHERE need_state <> 'Done' GROUP BY 1)"
_PATHS_OF = "ip AS (SELECT DISTINCT id, lower(unnest(paths)) AS path FROM items)"
_HELD = f"claims AS (SELECT id FROM items WHERE state = 'Claimed' AND lease_expires > {NOW}), held AS (SELECT a.id, min(b.id) AS held_by FROM ip a JOIN ip b ON (a.path = b.path OR starts_with(a.path, b.path || '/') OR starts_with(b.path, a.path || '/')) AND a.id <> b.id WHERE b.id IN (SELECT id FROM claims) GROUP BY 1)"
REFUSALS_SQL = f"WITH {_UNMET}, {_PATHS_OF}, {_HELD} SELECT i.id, CASE WHEN state = 'Claimed' AND lease_expires <= {NOW} THEN 'lapsed' WHEN state <> 'Ready' THEN 'not-claimable' WHEN u.need_state = 'missing' THEN 'dependency-missing' WHEN u.need_state = 'Declined' THEN 'dependency-declined' WHEN u.needs IS NOT NULL THEN 'dependency-unmet' WHEN h.held_by IS NOT NULL THEN 'overlap' END AS refusal FROM items i LEFT JOIN unmet u USING (id) LEFT JOIN held h USING (id)"


@query("claim_refusals", REFUSALS_SQL, covers="191 206")
def claim_refusals(spark, sf):
    s = store(spark, sf)
    return L.refusals(s.items, s.item_needs, NOW)


@query("eligible_items", f"SELECT id FROM ({REFUSALS_SQL}) WHERE refusal IS NULL", covers="156 205")
def eligible_items(spark, sf):
    s = store(spark, sf)
    return L.eligible(s.items, s.item_needs, NOW)


@query("unmet_dependencies", f"WITH {_UNMET} SELECT * FROM unmet", covers="204")
def unmet_dependencies(spark, sf):
    s = store(spark, sf)
    return L.unmet(s.items, s.item_needs)


@query("held_ground", f"WITH {_PATHS_OF}, {_HELD} SELECT * FROM held", covers="110")
def held_ground(spark, sf):
    return L.held_ground(store(spark, sf).items, NOW)


@query("shared_subjects", f"WITH {_PATHS_OF} SELECT DISTINCT a.id AS left_id, b.id AS right_id, CASE WHEN starts_with(b.path, a.path) THEN b.path ELSE a.path END AS path FROM ip a JOIN ip b ON (a.path = b.path OR starts_with(a.path, b.path || '/') OR starts_with(b.path, a.path || '/')) AND a.id <> b.id WHERE split_part(a.path, '/', 1) = split_part(b.path, '/', 1)", covers="251")
def shared_subjects(spark, sf):
    own = L.paths_of(store(spark, sf).items)
    return L.shared_subjects(own, own)


@query("overlapping_claims", f"WITH {_PATHS_OF}, {_HELD.split(', held')[0]} SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM ip a JOIN ip b ON (a.path = b.path OR starts_with(a.path, b.path || '/') OR starts_with(b.path, a.path || '/')) AND a.id < b.id WHERE a.id IN (SELECT id FROM claims) AND b.id IN (SELECT id FROM claims)", covers="254")
def overlapping_claims(spark, sf):
    return L.overlapping_claims(store(spark, sf).items, NOW)


@query("ambiguous_paths", "SELECT id, path, count(DISTINCT raw) AS spellings FROM (SELECT id, raw, lower(array_to_string(list_filter(string_split(raw, '/'), lambda s: s <> '' AND s <> '.'), '/')) AS path FROM (SELECT id, unnest(CASE WHEN id % 9 = 0 THEN list_concat(paths, [upper(paths[1]), './' || paths[2]]) ELSE paths END) AS raw FROM items)) GROUP BY 1, 2 HAVING count(DISTINCT raw) > 1", covers="253")
def ambiguous_paths(spark, sf):
    items = store(spark, sf).items
    more = F.concat("paths", F.array(F.upper(F.get("paths", F.lit(0))), F.concat(F.lit("./"), F.get("paths", F.lit(1)))))
    return L.ambiguous_paths(items.withColumn("paths", F.when(F.col("id") % 9 == 0, more).otherwise(F.col("paths"))))


@query("duplicate_ids", "SELECT id, count(*) AS n FROM (SELECT l_orderkey AS id FROM lineitem) GROUP BY 1 HAVING count(*) > 1", covers="134")
def duplicate_ids(spark, sf):
    return L.duplicate_ids(store(spark, sf).table("lineitem").select(F.col("l_orderkey").alias("id")))


@query("board_mentions", "SELECT id FROM items WHERE contains(state, 'lai') OR contains(coalesce(holder, ''), '-2') OR len(list_filter(paths, lambda x: contains(x, 'area77'))) > 0", covers="255 257")
def board_mentions(spark, sf):
    hit = L.mentions(store(spark, sf).items, "lai", ["state"])
    more = L.mentions(store(spark, sf).items, "-2", ["holder"])
    paths = L.mentions(store(spark, sf).items, "area77", [], ["paths"])
    return hit.select("id").union(more.select("id")).union(paths.select("id")).distinct()


@query("board_touching", f"WITH {_PATHS_OF} SELECT i.id, CASE WHEN EXISTS (SELECT 1 FROM ip WHERE ip.id = i.id AND (ip.path = 'area17' OR starts_with(ip.path, 'area17/'))) THEN 'admitted' ELSE 'undecided' END AS standing FROM items i WHERE EXISTS (SELECT 1 FROM ip WHERE ip.id = i.id AND (ip.path = 'area17' OR starts_with(ip.path, 'area17/'))) OR len(paths) = 0", covers="256")
def board_touching(spark, sf):
    target = spark.createDataFrame([(-1, "area17")], "id bigint, path string")
    return L.touching(store(spark, sf).items, target).select("id", "standing")


@query("board_validation", f"WITH RECURSIVE {_PATHS_OF}, {_HELD.split(', held')[0]}, p(src, dst) AS (SELECT id, needs FROM item_needs UNION SELECT p.src, n.needs FROM p JOIN item_needs n ON n.id = p.dst) SELECT DISTINCT 'missing-dependency' AS problem, n.id FROM item_needs n WHERE needs NOT IN (SELECT id FROM items) UNION ALL SELECT DISTINCT 'dependency-ring', src FROM p WHERE src = dst UNION ALL SELECT DISTINCT 'overlapping-claims', a.id FROM ip a JOIN ip b ON (a.path = b.path OR starts_with(a.path, b.path || '/') OR starts_with(b.path, a.path || '/')) AND a.id < b.id WHERE a.id IN (SELECT id FROM claims) AND b.id IN (SELECT id FROM claims)", covers="203 241")
def board_validation(spark, sf):
    s = store(spark, sf)
    return L.validate(s.items, s.item_needs, NOW)


# ---- corrections -----------------------------------------------------------------------------

_ACCESS = "acc AS (SELECT o_orderkey AS plan, 'file' AS tier, o_custkey AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 'write' ELSE 'read' END AS mode FROM orders)"
CONFLICT_SQL = f"WITH {_ACCESS}, t AS (SELECT plan, tier, subject, bool_or(mode = 'write') AS w FROM acc GROUP BY 1, 2, 3) SELECT a.plan AS src, b.plan AS dst, a.tier, a.subject, CASE WHEN a.w AND b.w THEN 'write-write' ELSE 'read-write' END AS conflict FROM t a JOIN t b ON a.tier = b.tier AND a.subject = b.subject AND a.plan < b.plan WHERE a.w OR b.w"


def _access(s):
    k = F.col("o_orderkey")
    return s.table("orders").select(k.alias("plan"), F.lit("file").alias("tier"), F.col("o_custkey").alias("subject"), F.when(k % 3 == 0, "write").otherwise("read").alias("mode"))


@query("plan_conflicts", CONFLICT_SQL, covers="258")
def plan_conflicts(spark, sf):
    return P.plan_conflicts(_access(store(spark, sf)))


@query("plan_waves", f"WITH RECURSIVE c AS (SELECT src AS a, dst AS b FROM ({CONFLICT_SQL})), lv(p, l) AS (SELECT o_orderkey, 0 FROM orders UNION SELECT c.b, l + 1 FROM c JOIN lv ON lv.p = c.a) SELECT p AS position, max(l) AS wave FROM lv GROUP BY 1", covers="259 260")
def plan_waves(spark, sf):
    access = _access(store(spark, sf))
    return G.greedy_waves(access.select(F.col("plan").alias("position")), P.plan_conflicts(access).select("src", "dst"))


@query("convergence", "SELECT turn + 10 * conv_id AS round, f AS first_round FROM (SELECT *, min(turn + 10 * conv_id) OVER (PARTITION BY length(text)) AS f FROM conversations) WHERE f < turn + 10 * conv_id", covers="271")
def convergence(spark, sf):
    c = store(spark, sf).table("conversations")
    return P.converged(c.select((F.col("turn") + 10 * F.col("conv_id")).alias("round"), F.length("text").alias("signature")))


@query("directory_rollup", "SELECT split_part(path, '/', 1) AS directory, count(*) AS files, sum(byte_length)::BIGINT AS bytes, count_if(lang = 'en')::BIGINT AS english, sum(byte_length) FILTER (lang <> 'en')::BIGINT AS other_bytes FROM docs GROUP BY 1", covers="132")
def directory_rollup(spark, sf):
    d = store(spark, sf).docs
    return d.groupBy(F.substring_index("path", "/", 1).alias("directory")).agg(F.count("*").alias("files"), F.sum("byte_length").alias("bytes"), F.count_if(F.col("lang") == "en").alias("english"), F.sum(F.when(F.col("lang") != "en", F.col("byte_length"))).alias("other_bytes"))


@query("rule_cache_population", "SELECT lang AS slice, a <> b AS moved FROM (SELECT lang, list_sort(list(path)) AS a, list_sort(list(path) FILTER (NOT (lang = 'en' AND doc_id % 10 = 0))) AS b FROM docs GROUP BY 1)", covers="221 222")
def rule_cache_population(spark, sf):
    """Whether a slice's population is another than the recorded one: by digests, not lists."""
    d = store(spark, sf).docs
    own = F.sum(F.xxhash64("path").cast("decimal(38,0)"))
    kept = ~((F.col("lang") == "en") & (F.col("doc_id") % 10 == 0))
    recorded = F.sum(F.when(kept, F.xxhash64("path").cast("decimal(38,0)")))
    return d.groupBy(F.col("lang").alias("slice")).agg(((own != recorded) | (F.count("*") != F.count(F.when(kept, 1)))).alias("moved"))
