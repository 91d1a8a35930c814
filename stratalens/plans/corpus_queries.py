"""Queries of the document store: scalars, filters, readers, preservation, revisions, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import difference as D, facts as V, filters as Q, preservation as P, revisions as R, segment as S, views as J
from ..operators.graph import settle
from ..operators.mentions import mentions
from .registry import query
from .store import norm_sql, store

# ---- templates and preservation ------------------------------------------------------------

TEMPLATES_SQL = "SELECT normalized_hash, count(*) AS sections, count(DISTINCT (path, revision)) AS documents, min(normalized) AS sample FROM blocks WHERE kind = 'prose' AND length(normalized) >= 36 GROUP BY 1 HAVING count(*) >= 3"


@query("filler_templates", TEMPLATES_SQL, covers="72 112 113 154 165 168")
def filler_templates(spark, sf):
    return P.templates(store(spark, sf).blocks)


@query("widest_template", f"SELECT * FROM ({TEMPLATES_SQL}) ORDER BY sections DESC, sample LIMIT 1", covers="155")
def widest_template(spark, sf):
    return P.templates(store(spark, sf).blocks).orderBy(F.desc("sections"), "sample").limit(1)


DECLARED_SQL = "SELECT normalized_hash, 'declared' AS role, 2 + (ascii(substr(normalized_hash, 8, 1)) % 3)::BIGINT AS multiplicity FROM blocks WHERE doc_id % 2 = 0 GROUP BY normalized_hash"


def _declarations(s):
    return s.blocks.filter("doc_id % 2 = 0").select("normalized_hash").distinct().withColumn("multiplicity", (2 + F.ascii(F.substring("normalized_hash", 8, 1)) % 3).cast("long"))


@query("template_excess_over_declared", f"WITH t AS ({TEMPLATES_SQL}), d AS ({DECLARED_SQL}) SELECT t.*, coalesce(d.multiplicity, 0)::BIGINT AS declared, (sections - coalesce(d.multiplicity, 0))::BIGINT AS excess FROM t LEFT JOIN d USING (normalized_hash) WHERE sections > coalesce(d.multiplicity, 0)", covers="114 115 228")
def template_excess(spark, sf):
    s = store(spark, sf)
    return P.undeclared_excess(P.templates(s.blocks), _declarations(s))


@query("repetition_index", "SELECT normalized_hash, count(*) AS sections, count(DISTINCT (path, revision)) AS documents FROM blocks GROUP BY 1", covers="122")
def repetition_index(spark, sf):
    return P.repetition_index(store(spark, sf).blocks)


@query("stub_documents", f"WITH t AS ({TEMPLATES_SQL}) SELECT path, revision, count(*) AS keyed, count(t.normalized_hash) AS filler FROM blocks LEFT JOIN t USING (normalized_hash) WHERE length(normalized) >= 36 GROUP BY ALL HAVING count(*) = count(t.normalized_hash)", covers="123")
def stub_documents(spark, sf):
    s = store(spark, sf)
    return P.stub_documents(s.blocks, P.templates(s.blocks))


UNDISPOSED_SQL = "SELECT path, revision, ordinal FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM lineage l WHERE l.path = b.path AND l.revision = b.revision AND l.block_ordinal = b.ordinal) AND NOT EXISTS (SELECT 1 FROM omissions o WHERE o.path = b.path AND o.revision = b.revision AND o.block_ordinal = b.ordinal)"


@query("undisposed_blocks", UNDISPOSED_SQL, covers="86 87 226")
def undisposed_blocks(spark, sf):
    s = store(spark, sf)
    return P.undisposed(s.blocks, s.lineage, s.omissions).select("path", "revision", "ordinal")


@query("unjustified_supersessions", "SELECT statement_id FROM statements s WHERE supersedes_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM history h WHERE h.node_id = s.node_id AND h.event = 'content_changed')", covers="227")
def unjustified(spark, sf):
    s = store(spark, sf)
    return P.unjustified_changes(s.statements, s.history)


@query("untraced_statements", "SELECT statement_id FROM statements s WHERE NOT EXISTS (SELECT 1 FROM lineage l WHERE l.target_statement = s.statement_id AND l.block_ordinal IS NOT NULL AND l.disposition IN ('preserved-verbatim', 'preserved-normalized'))", covers="229")
def untraced(spark, sf):
    s = store(spark, sf)
    return P.untraced_statements(s.statements, s.lineage)


@query("only_from_commentary", "WITH c AS (SELECT DISTINCT path, revision, ordinal FROM blocks WHERE doc_id % 4 = 1), t AS (SELECT l.target_statement, c.path IS NOT NULL AS inside FROM lineage l LEFT JOIN c ON c.path = l.path AND c.revision = l.revision AND c.ordinal = l.block_ordinal WHERE l.target_statement IS NOT NULL AND l.block_ordinal IS NOT NULL) SELECT target_statement FROM t GROUP BY 1 HAVING bool_and(inside)", covers="88 89")
def only_from_commentary(spark, sf):
    s = store(spark, sf)
    commentary = s.blocks.filter("doc_id % 4 = 1")
    commentary.createOrReplaceTempView("commentary_blocks")
    return P.only_from_commentary(s.lineage, spark.table("commentary_blocks"))


def _rules(s):
    b = s.blocks
    return {
        "NSV-PRESERVE-002": lambda: (b, P.undisposed(b, s.lineage, s.omissions)),
        "NSV-PRESERVE-003": lambda: (s.statements, P.unjustified_changes(s.statements, s.history)),
        "NSV-PRESERVE-004": lambda: (P.templates(b), P.undeclared_excess(P.templates(b), _declarations(s))),
        "NSV-PRESERVE-006": lambda: (s.statements, P.untraced_statements(s.statements, s.lineage)),
        "NSV-EMPTY": lambda: (b.filter("false"), b.filter("false")),
    }


OUTCOMES_SQL = f"""SELECT rule, checked, offending, CASE WHEN offending > 0 THEN 'violated' ELSE 'satisfied' END AS status, checked = 0 AND offending = 0 AS vacuous FROM (
SELECT 'NSV-PRESERVE-002' AS rule, (SELECT count(*) FROM blocks) AS checked, (SELECT count(*) FROM ({UNDISPOSED_SQL})) AS offending
UNION ALL SELECT 'NSV-PRESERVE-003', (SELECT count(*) FROM statements), (SELECT count(*) FROM statements s WHERE supersedes_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM history h WHERE h.node_id = s.node_id AND h.event = 'content_changed'))
UNION ALL SELECT 'NSV-PRESERVE-004', (SELECT count(*) FROM ({TEMPLATES_SQL})), (SELECT count(*) FROM ({TEMPLATES_SQL}) t LEFT JOIN ({DECLARED_SQL}) d USING (normalized_hash) WHERE t.sections > coalesce(d.multiplicity, 0))
UNION ALL SELECT 'NSV-PRESERVE-006', (SELECT count(*) FROM statements), (SELECT count(*) FROM statements s WHERE NOT EXISTS (SELECT 1 FROM lineage l WHERE l.target_statement = s.statement_id AND l.block_ordinal IS NOT NULL AND l.disposition IN ('preserved-verbatim', 'preserved-normalized')))
UNION ALL SELECT 'NSV-EMPTY', 0, 0)"""


@query("rule_outcomes", OUTCOMES_SQL, covers="230 231 232 139")
def rule_outcomes(spark, sf):
    return P.run_rules(_rules(store(spark, sf)))


@query("validation_summary", f"SELECT count(*) AS rules, sum(checked)::BIGINT AS checked, sum(offending)::BIGINT AS offending, count_if(status = 'violated')::BIGINT AS violated, count_if(vacuous)::BIGINT AS vacuous FROM ({OUTCOMES_SQL})", covers="138")
def validation_summary(spark, sf):
    return P.validation_summary(P.run_rules(_rules(store(spark, sf))))


@query("ruleset_hash", "SELECT sha256(string_agg(DISTINCT n_name, chr(10) ORDER BY n_name)) AS ruleset FROM nation", covers="135")
def ruleset_hash(spark, sf):
    return P.ruleset_hash(store(spark, sf).table("nation"), "n_name")


@query("registry_reconciliation", "SELECT rule, 'unregistered' AS problem FROM (SELECT n_name AS rule FROM nation WHERE n_nationkey % 3 <> 0 EXCEPT SELECT n_name FROM nation WHERE n_nationkey % 4 <> 0) UNION ALL SELECT rule, 'undeclared' FROM (SELECT n_name AS rule FROM nation WHERE n_nationkey % 4 <> 0 EXCEPT SELECT n_name FROM nation WHERE n_nationkey % 3 <> 0)", covers="162")
def registry_reconciliation(spark, sf):
    n = store(spark, sf).table("nation").select(F.col("n_name").alias("rule"), "n_nationkey")
    return P.reconcile(n.filter("n_nationkey % 3 <> 0").select("rule"), n.filter("n_nationkey % 4 <> 0").select("rule"))


# ---- readers ---------------------------------------------------------------------------------


@query("documents_with_counts", "SELECT d.path, d.revision, d.sha256, d.byte_length, (SELECT count(*) FROM blocks b WHERE b.path = d.path AND b.revision = d.revision AND b.kind = 'heading') AS headings, (SELECT count(*) FROM blocks b WHERE b.path = d.path AND b.revision = d.revision) AS blocks FROM docs d", covers="32 33 75 169")
def documents_with_counts(spark, sf):
    s = store(spark, sf)
    blobs = s.docs.select("sha256", "byte_length").dropDuplicates(["sha256"])
    return J.documents_with_counts(s.docs.select("path", "revision", "sha256"), blobs, s.blocks.filter("kind = 'heading'"), s.blocks)


@query("blocks_of_documents", "SELECT b.path, b.revision, b.ordinal, b.kind, b.content_hash, d.lang FROM blocks b JOIN docs d ON d.path = b.path AND d.revision = b.revision WHERE d.lang = 'en' AND b.kind = 'prose' AND b.path ILIKE 'SRC1/%'", covers="50 51 52 55 76 77")
def blocks_of_documents(spark, sf):
    s = store(spark, sf)
    out = s.blocks.select("path", "revision", "ordinal", "kind", "content_hash").join(s.docs.select("path", "revision", "lang"), ["path", "revision"])
    return Q.Query(out).equal("lang", "en").equal("kind", "prose").prefix("path", "SRC1/").equal("revision", None).order_by("path", "ordinal")


@query("nodes_view", "SELECT node_id, kind, authority, n.title, coalesce(s.title, '') AS suite FROM nodes n LEFT JOIN suites s USING (suite_id) WHERE deleted_at IS NULL", covers="79 91 57")
def nodes_view(spark, sf):
    s = store(spark, sf)
    return J.nodes_view(s.nodes, s.suites)


@query("relations_view", "SELECT from_node, a.title AS from_title, type, to_node, b.title AS to_title, coalesce(t.inverse_of, '') AS inverse, coalesce(s.title, '') AS suite FROM relations r JOIN nodes a ON a.node_id = r.from_node JOIN nodes b ON b.node_id = r.to_node JOIN relation_types t ON t.name = r.type LEFT JOIN suites s ON s.suite_id = a.suite_id", covers="80")
def relations_view(spark, sf):
    s = store(spark, sf)
    return J.relations_view(s.relations, s.nodes, s.relation_types, s.suites)


@query("statements_of_nodes", "SELECT statement_id, s.kind, n.title, canonical_hash FROM statements s JOIN nodes n USING (node_id) WHERE deleted_at IS NULL", covers="81")
def statements_of_nodes(spark, sf):
    s = store(spark, sf)
    return s.statements.join(s.nodes.filter("deleted_at is null").select("node_id", "title"), "node_id").select("statement_id", "kind", "title", "canonical_hash")


@query("lineage_view", "SELECT CASE WHEN l.block_ordinal IS NOT NULL AND l.row_ordinal IS NOT NULL THEN l.path || '#' || l.block_ordinal || ':' || l.row_ordinal WHEN l.block_ordinal IS NOT NULL THEN l.path || '#' || l.block_ordinal WHEN l.heading IS NOT NULL THEN l.path || '#' || l.heading ELSE l.path END AS source, disposition, coalesce(l.target_node, l.target_statement, '') AS target, coalesce(n.title, s.canonical_hash, '') AS target_text, coalesce(b.content_hash, '') AS source_hash FROM lineage l LEFT JOIN blocks b ON b.path = l.path AND b.revision = l.revision AND b.ordinal = l.block_ordinal LEFT JOIN nodes n ON n.node_id = l.target_node LEFT JOIN statements s ON s.statement_id = l.target_statement", covers="82 90 152 186")
def lineage_view(spark, sf):
    s = store(spark, sf)
    return J.lineage_view(s.lineage, s.blocks, s.nodes, s.statements)


@query("omissions_view", "SELECT o.path || '#' || o.block_ordinal AS source, reason, justification, coalesce(b.kind, '') AS kind, coalesce(b.content_hash, '') AS content_hash FROM omissions o LEFT JOIN blocks b ON b.path = o.path AND b.revision = o.revision AND b.ordinal = o.block_ordinal", covers="83")
def omissions_view(spark, sf):
    s = store(spark, sf)
    return J.omissions_view(s.omissions, s.blocks)


@query("neighbourhood", "SELECT * FROM nodes n WHERE deleted_at IS NULL AND node_id <> 'NAT-000005' AND EXISTS (SELECT 1 FROM relations r WHERE (r.from_node = 'NAT-000005' AND r.to_node = n.node_id) OR (r.to_node = 'NAT-000005' AND r.from_node = n.node_id))", covers="84 212 60")
def neighbourhood(spark, sf):
    s = store(spark, sf)
    subject = Q.substitute_subject({"node": "{subject}"}, "NAT-000005")["node"]
    return J.neighbourhood(s.relations, s.nodes, subject).select("node_id", "kind", "authority", "title", "deleted_at", "suite_id")


@query("documents_behind_node", "SELECT DISTINCT d.path, d.revision FROM docs d JOIN lineage l ON l.path = d.path AND l.revision = d.revision WHERE l.target_node = 'NAT-000002'", covers="85")
def documents_behind(spark, sf):
    s = store(spark, sf)
    return J.documents_behind(s.lineage, s.docs, "NAT-000002")


@query("family_edge_counts", "SELECT from_family, to_family, count(*) AS edges FROM (SELECT regexp_replace(from_node, '-[0-9]+$', '') AS from_family, regexp_replace(to_node, '-[0-9]+$', '') AS to_family FROM relations) WHERE from_family <> to_family GROUP BY 1, 2", covers="120 121")
def family_edge_counts(spark, sf):
    return J.family_edges(store(spark, sf).relations)


@query("edges_with_inverses", "SELECT from_node, type, to_node FROM relations UNION SELECT to_node, inverse_of, from_node FROM relations r JOIN relation_types t ON t.name = r.type WHERE inverse_of IS NOT NULL", covers="36 38")
def edges_with_inverses(spark, sf):
    s = store(spark, sf)
    return J.with_inverse_edges(s.relations, s.relation_types)


@query("edge_constraint_violations", "SELECT from_node, type, to_node, CASE WHEN NOT list_contains(domain_kinds, a.kind) THEN 'domain' ELSE 'range' END AS side FROM relations r JOIN relation_types t ON t.name = r.type JOIN nodes a ON a.node_id = from_node JOIN nodes b ON b.node_id = to_node WHERE NOT list_contains(domain_kinds, a.kind) OR NOT list_contains(range_kinds, b.kind)", covers="210 37")
def edge_violations(spark, sf):
    s = store(spark, sf)
    return J.edge_violations(s.relations, s.nodes, s.relation_types)


@query("edge_cardinality", "WITH doubled AS (SELECT from_node, type, to_node FROM relations UNION ALL SELECT from_node, type, to_node || 'x' FROM relations WHERE ends_with(from_node, '3')) SELECT from_node, type, count(*) AS edges, max_per_node FROM doubled JOIN relation_types t ON t.name = type WHERE max_per_node IS NOT NULL GROUP BY ALL HAVING count(*) > max_per_node", covers="211")
def edge_cardinality(spark, sf):
    s = store(spark, sf)
    more = s.relations.filter(F.endswith("from_node", F.lit("3"))).withColumn("to_node", F.concat("to_node", F.lit("x")))
    return J.cardinality_violations(s.relations.unionByName(more), s.relation_types)


@query("narrowed_nodes", "SELECT node_id, title FROM nodes WHERE kind = 'nation' AND authority = 'derived' AND node_id ILIKE 'nat-00000%' AND node_id IN (SELECT node_id FROM history WHERE event = 'content_changed')", covers="54 56 74")
def narrowed_nodes(spark, sf):
    s = store(spark, sf)
    status = s.history.select("node_id", F.col("event").alias("status"))
    return Q.narrow_nodes(s.nodes, status, kind="nation", authority="derived", prefix="nat-00000", status="content_changed").select("node_id", "title")


@query("either_end", "SELECT * FROM relations WHERE from_node = 'NAT-000003' OR to_node = 'NAT-000003'", covers="53")
def either_end(spark, sf):
    return Q.Query(store(spark, sf).relations).either("from_node", "to_node", "NAT-000003").df


@query("tiered_path_match", "WITH m AS (SELECT path, CASE WHEN path = '17' THEN 1 WHEN string_split(path, '/')[-1] = '17' THEN 2 WHEN contains(path, '17') THEN 3 END AS tier FROM docs) SELECT path, tier FROM m WHERE tier = (SELECT min(tier) FROM m)", covers="69")
def tiered_path(spark, sf):
    return Q.tiered_path_match(store(spark, sf).docs.select("path"), "17")


@query("current_values", "SELECT submission, field, arg_max(value, ordinal) AS value, max(ordinal) AS ordinal FROM submission_values GROUP BY ALL", covers="137")
def current_values(spark, sf):
    return V.current_values(store(spark, sf).submission_values)


@query("table_tallies", "SELECT 'documents' AS tab, count(*) AS n FROM docs UNION ALL SELECT 'blocks', count(*) FROM blocks UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'lineage', count(*) FROM lineage", covers="118 159")
def table_tallies(spark, sf):
    s = store(spark, sf)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("tab"), "n") for t, df in (("documents", s.docs), ("blocks", s.blocks), ("nodes", s.nodes), ("relations", s.relations), ("lineage", s.lineage))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# ---- scalars ---------------------------------------------------------------------------------


@query("text_scalars", f"SELECT doc_id, {norm_sql('text')} = text AS normal, 'sha256:' || sha256({norm_sql('text')}) AS normal_hash, regexp_matches(sha256, '^sha256:[0-9a-f]{{64}}$') AS valid, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS preview, regexp_replace(path, '^[^/]*/', '') AS short_path, sha256(strlen(path) || ':' || path || strlen(lang) || ':' || lang) AS framed FROM docs", covers="157 166 167 170 171 185")
def text_scalars(spark, sf):
    d = store(spark, sf).docs
    return d.select("doc_id", X.is_normalised("text").alias("normal"), X.normalised_hash("text").alias("normal_hash"), X.is_hash("sha256").alias("valid"), X.preview("text").alias("preview"), X.strip_first_segment("path").alias("short_path"), X.framed_digest("path", "lang").alias("framed"))


@query("url_paths", "SELECT page_id, lower(array_to_string(list_filter(string_split(replace(url, chr(92), '/'), '/'), lambda s: s <> '' AND s <> '.'), '/')) AS normal, sha256(lower(array_to_string(list_filter(string_split(replace(url, chr(92), '/'), '/'), lambda s: s <> '' AND s <> '.'), '/'))) AS subject FROM pages", covers="70 172")
def url_paths(spark, sf):
    return store(spark, sf).table("pages").select("page_id", X.normal_path("url").alias("normal"), X.subject_of_path("url").alias("subject"))


@query("filler_patterns", "SELECT doc_id, CASE WHEN contains(text, 'Released under') THEN 'Released under' WHEN contains(text, 'Licensed under') THEN 'Licensed under' WHEN contains(text, '!!') THEN '!!' END AS pattern FROM docs", covers="71")
def filler_patterns(spark, sf):
    return store(spark, sf).docs.select("doc_id", X.first_contained("text", ["Released under", "Licensed under", "!!"]).alias("pattern"))


@query("statement_ids", "SELECT statement_id, regexp_extract(statement_id, '^([A-Z][A-Z0-9-]*)-([0-9]{3,})$', 1) AS prefix, regexp_extract(statement_id, '^([A-Z][A-Z0-9-]*)-([0-9]{3,})$', 2)::BIGINT AS number FROM statements", covers="184")
def statement_ids(spark, sf):
    out = store(spark, sf).statements.select("statement_id", X.statement_id_parts("statement_id").alias("p"))
    return out.select("statement_id", "p.prefix", "p.number")


@query("template_keys", f"SELECT doc_id, ordinal, replace({norm_sql('text')}, 'the', '{{}}') AS key FROM blocks WHERE kind = 'prose'", covers="183")
def template_keys(spark, sf):
    b = store(spark, sf).blocks.filter("kind = 'prose'")
    return b.select("doc_id", "ordinal", X.template_key("text", F.lit(" the ")).alias("key"))


@query("item_digests", "SELECT node_id, sha256(concat_ws(chr(30), node_id, 'kind' || chr(31) || kind || chr(30) || 'title' || chr(31) || title, '')) AS digest FROM nodes", covers="136 187")
def item_digests(spark, sf):
    n = store(spark, sf).nodes
    return n.select("node_id", X.item_digest("node_id", F.array(F.lit("kind"), F.lit("title")), F.array("kind", "title"), F.lit(None).cast("string")).alias("digest"))


@query("sorted_kinds", "SELECT name, '[' || array_to_string(list_transform(list_sort(list_concat(domain_kinds, range_kinds)), lambda x: '\"' || x || '\"'), ',') || ']' AS kinds FROM relation_types", covers="188")
def sorted_kinds(spark, sf):
    return store(spark, sf).relation_types.select("name", X.sorted_json(F.concat("domain_kinds", "range_kinds")).alias("kinds"))


# ---- revisions -------------------------------------------------------------------------------

WALK_SQL = """
WITH s AS (SELECT rev_no, lag(rev_no) OVER (ORDER BY rev_no) AS prev, lead(rev_no) OVER (ORDER BY rev_no) AS nxt FROM (SELECT DISTINCT rev_no FROM revision_docs)),
came AS (SELECT a.path, a.rev_no, CASE WHEN NOT EXISTS (SELECT 1 FROM revision_docs p WHERE p.path = a.path AND p.rev_no < a.rev_no) THEN 'appeared' WHEN b.path IS NULL THEN 'reappeared' WHEN a.hash <> b.hash THEN 'changed' END AS event FROM revision_docs a JOIN s USING (rev_no) LEFT JOIN revision_docs b ON b.path = a.path AND b.rev_no = s.prev WHERE s.prev IS NOT NULL)
SELECT path, rev_no, event FROM came WHERE event IS NOT NULL
UNION ALL SELECT a.path, s.nxt, 'disappeared' FROM revision_docs a JOIN s USING (rev_no) LEFT JOIN revision_docs b ON b.path = a.path AND b.rev_no = s.nxt WHERE s.nxt IS NOT NULL AND b.path IS NULL"""


@query("revision_walk", WALK_SQL, covers="141 142")
def revision_walk(spark, sf):
    return R.walk(store(spark, sf).revision_docs)


@query("revision_events", f"SELECT rev_no, event, count(*) AS n FROM ({WALK_SQL}) GROUP BY ALL", covers="141")
def revision_events(spark, sf):
    return R.walk(store(spark, sf).revision_docs).groupBy("rev_no", "event").agg(F.count("*").alias("n"))


@query("revision_pair_diff", "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'appeared' WHEN b.path IS NULL THEN 'disappeared' WHEN a.hash <> b.hash THEN 'changed' ELSE 'kept' END AS event FROM (SELECT * FROM revision_docs WHERE rev_no = 3) a FULL JOIN (SELECT * FROM revision_docs WHERE rev_no = 4) b ON a.path = b.path", covers="6 99 160")
def revision_pair_diff(spark, sf):
    r = store(spark, sf).revision_docs
    return R.pair_diff(r.filter("rev_no = 3"), r.filter("rev_no = 4"))


@query("relocations", "WITH a AS (SELECT * FROM revision_docs WHERE rev_no = 1), b AS (SELECT * FROM revision_docs WHERE rev_no = 2) SELECT n.path AS to_path, list_sort(list(DISTINCT g.path)) AS from_paths, n.hash FROM b n JOIN a g ON g.hash = n.hash WHERE n.path NOT IN (SELECT path FROM a) AND g.path NOT IN (SELECT path FROM b) GROUP BY n.path, n.hash", covers="100")
def relocations(spark, sf):
    r = store(spark, sf).revision_docs
    return R.relocations(r.filter("rev_no = 1").select("path", "hash"), r.filter("rev_no = 2").select("path", "hash"))


@query("label_gaps", "WITH l AS (SELECT DISTINCT 1 + n_regionkey::INT AS major, n_nationkey::INT AS minor FROM nation WHERE n_nationkey % 3 <> 1), s AS (SELECT major, min(minor) AS lo, max(minor) AS hi FROM l GROUP BY 1) SELECT major, m::INT AS minor FROM (SELECT major, unnest(range(lo, hi + 1)) AS m FROM s) f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.major = f.major AND l.minor = f.m)", covers="4 5")
def label_gaps(spark, sf):
    n = store(spark, sf).table("nation").filter("n_nationkey % 3 <> 1")
    names = n.select(F.concat(F.lit("archive-v"), (F.col("n_regionkey") + 1).cast("string"), F.lit("."), F.col("n_nationkey").cast("string"), F.lit(".zip")).alias("name"))
    return R.label_gaps(R.parse_labels(names).select("major", "minor").distinct())


@query("kind_census", "SELECT revision, documents, fence_lines, pipe_lines, table_documents, code_blocks, prose_blocks, headings FROM (SELECT revision, count(DISTINCT path) AS documents, count_if(starts_with(line, '```'))::BIGINT AS fence_lines, count_if(p)::BIGINT AS pipe_lines, count(DISTINCT CASE WHEN p THEN path END) AS table_documents FROM (SELECT *, regexp_matches(line, '^[\\s\\x0b]*\\|.*\\|[\\s\\x0b]*$') AS p FROM doc_lines) GROUP BY 1) JOIN (SELECT revision, count_if(kind = 'code')::BIGINT AS code_blocks, count_if(kind = 'prose')::BIGINT AS prose_blocks, count_if(kind = 'heading')::BIGINT AS headings FROM blocks GROUP BY 1) USING (revision)", covers="119 178")
def kind_census(spark, sf):
    s = store(spark, sf)
    return R.kind_census(s.blocks, s.doc_lines)


@query("identifier_reconcile", "WITH o AS (SELECT statement_id AS id, canonical_text AS t FROM statements), n AS (SELECT statement_id AS id, CASE WHEN ends_with(statement_id, '2') THEN canonical_text || ' more' ELSE '  ' || canonical_text END AS t FROM statements WHERE NOT ends_with(statement_id, '5')) SELECT o.id, CASE WHEN n.id IS NULL THEN 'absent' WHEN " + norm_sql("o.t") + " = " + norm_sql("n.t") + " THEN 'preserved' ELSE 'reworded' END AS fate FROM o LEFT JOIN n USING (id)", covers="101")
def identifier_reconcile(spark, sf):
    o = store(spark, sf).statements.select(F.col("statement_id").alias("id"), F.col("canonical_text").alias("text"))
    n = o.filter(~F.endswith("id", F.lit("5"))).select("id", F.when(F.endswith("id", F.lit("2")), F.concat("text", F.lit(" more"))).otherwise(F.concat(F.lit("  "), "text")).alias("text"))
    return R.reconcile_identifiers(o, n)


@query("manifest_check", "WITH m AS (SELECT path, ordinal, CASE WHEN doc_id % 6 = 1 THEN 'sha256:0' ELSE content_hash END AS hash FROM blocks WHERE doc_id % 5 <> 2 UNION ALL SELECT path, 100000, 'x' FROM docs WHERE doc_id % 50 = 3) SELECT coalesce(b.path, m.path) AS path, coalesce(b.ordinal, m.ordinal)::BIGINT AS ordinal, CASE WHEN b.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unrecorded' WHEN b.content_hash = m.hash THEN 'equal' ELSE 'different' END AS verdict FROM blocks b FULL JOIN m ON m.path = b.path AND m.ordinal = b.ordinal", covers="9 102")
def manifest_check(spark, sf):
    s = store(spark, sf)
    m = s.blocks.filter("doc_id % 5 <> 2").select("path", "ordinal", F.when(F.col("doc_id") % 6 == 1, "sha256:0").otherwise(F.col("content_hash")).alias("hash"))
    extra = s.docs.filter("doc_id % 50 = 3").select("path", F.lit(100000).cast("long").alias("ordinal"), F.lit("x").alias("hash"))
    return R.manifest_check(s.blocks, m.unionByName(extra))


MEMBERS_SQL = "SELECT 'M-' || i AS id, name, CASE WHEN i % 2 = 0 THEN 'model' ELSE 'service' END AS family FROM (SELECT row_number() OVER (ORDER BY name) AS i, name FROM (SELECT DISTINCT split_part(canonical_text, ' ', 1) AS name FROM statements))"
POSITIONS_SQL = "SELECT name, CASE ascii(name) % 4 WHEN 0 THEN 'row' WHEN 1 THEN 'narrative' ELSE 'template' END AS kind FROM (SELECT DISTINCT split_part(canonical_text, ' ', 1) AS name FROM statements) WHERE length(name) % 3 <> 0"
FATES_SQL = f"WITH m AS ({MEMBERS_SQL}), p AS ({POSITIONS_SQL}) SELECT id, m.name, family, CASE WHEN p.kind IN ('row', 'narrative') THEN 'preserved' WHEN p.kind IS NOT NULL THEN 'hollowed' WHEN EXISTS (SELECT 1 FROM docs WHERE contains(docs.text, m.name)) THEN 'mentioned' ELSE 'gone' END AS fate FROM m LEFT JOIN p USING (name)"


def _fates(s):
    from pyspark.sql import Window as W

    names = s.statements.select(F.substring_index("canonical_text", " ", 1).alias("name")).distinct()
    members = names.withColumn("i", F.row_number().over(W.orderBy("name"))).select(F.concat(F.lit("M-"), F.col("i").cast("string")).alias("id"), "name", F.when(F.col("i") % 2 == 0, "model").otherwise("service").alias("family"))
    code = F.ascii("name") % 4
    positions = names.filter(F.length("name") % 3 != 0).select("name", F.when(code == 0, "row").when(code == 1, "narrative").otherwise("template").alias("kind"))
    return R.member_fates(members, positions, s.docs.select("path", "text"))


@query("member_fates", FATES_SQL, covers="245 246 247 248")
def member_fates(spark, sf):
    return _fates(store(spark, sf))


@query("name_mentions", "WITH m AS (SELECT DISTINCT split_part(canonical_text, ' ', 1) AS name FROM statements UNION SELECT DISTINCT canonical_text[1:j] FROM statements, (VALUES (3), (6), (9), (14), (25)) v(j)) SELECT name, path FROM m, docs WHERE name <> '' AND contains(text, name)", covers="247")
def name_mentions(spark, sf):
    s = store(spark, sf)
    first = s.statements.select(F.substring_index("canonical_text", " ", 1).alias("name"))
    more = s.statements.select(F.explode(F.array(*[F.substring("canonical_text", 1, j) for j in (3, 6, 9, 14, 25)])).alias("name"))
    return mentions(first.union(more), s.docs, settle)


@query("fate_tally", f"SELECT family, count_if(fate = 'preserved')::BIGINT AS preserved, count_if(fate = 'hollowed')::BIGINT AS hollowed, count_if(fate = 'mentioned')::BIGINT AS mentioned, count_if(fate = 'gone')::BIGINT AS gone FROM ({FATES_SQL}) GROUP BY 1", covers="124")
def fate_tally(spark, sf):
    return R.fate_tally(_fates(store(spark, sf)))


# ---- markdown --------------------------------------------------------------------------------

# A markdown document per conversation: a title, and a heading, a paragraph and a table a turn.


def markdown_documents(s):
    c = s.table("conversations")
    part = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), "text", F.lit("\n\n| n | role |\n| --- | :---: |\n| "), F.col("turn").cast("string"), F.lit(" | "), "role", F.lit(" |\n\n"))
    out = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "").alias("body"))
    title = F.concat(F.lit("---\nid: C-"), F.col("conv_id").cast("string"), F.lit("\n---\n# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"))
    return out.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), F.lit("v1").alias("revision"), F.concat(title, "body").alias("text"))


_TURNS = "SELECT 'conv/' || conv_id AS path, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role, text, conv_id FROM conversations"
SEGMENT_SQL = f"""
WITH t AS ({_TURNS}), paragraphs AS (SELECT path, k, turn, role, unnest(range(1, len(ps) + 1)) AS j, unnest(ps) AS p FROM (SELECT *, list_filter(string_split_regex(text, '\\n(?:[\\s]*\\n)+'), lambda x: trim(x) <> '') AS ps FROM t)),
parts AS (SELECT path, 0 AS k, 0 AS j, 'heading' AS kind, ['Conversation ' || conv_id] AS heading_path, '# Conversation ' || conv_id AS body FROM t WHERE k = 1
UNION ALL SELECT path, k, 0, 'heading', ['Conversation ' || conv_id, role || ' ' || turn], '## ' || role || ' ' || turn FROM t
UNION ALL SELECT t.path, t.k, 1, 'prose', ['Conversation ' || conv_id, role || ' ' || turn], text FROM t
UNION ALL SELECT path, k, 2, 'prose', ['Conversation ' || conv_id, role || ' ' || turn], '| n | role |' || chr(10) || '| --- | :---: |' || chr(10) || '| ' || turn || ' | ' || role || ' |' FROM t)
SELECT path, 'v1' AS revision, row_number() OVER (PARTITION BY path ORDER BY k, j) AS ordinal, kind, heading_path, 'sha256:' || sha256(body) AS content_hash FROM parts"""


@query("markdown_blocks", SEGMENT_SQL, covers="34 143 147 175 176 177 182")
def markdown_blocks(spark, sf):
    return S.segment(markdown_documents(store(spark, sf))).select("path", "revision", "ordinal", "kind", "heading_path", "content_hash")


ROWS_SQL = f"WITH t AS ({_TURNS}) SELECT path, 'v1' AS revision, 3 * k + 1 AS block_ordinal, r AS ordinal, 1::BIGINT AS table_ordinal, CASE r WHEN 1 THEN 'header' WHEN 2 THEN 'separator' ELSE 'content' END AS kind, CASE r WHEN 1 THEN ['n', 'role'] WHEN 2 THEN ['---', ':---:'] ELSE [turn::VARCHAR, role] END AS cells FROM t, (SELECT unnest([1, 2, 3]) AS r)"


@query("table_rows", ROWS_SQL, covers="144 145 146 179 180")
def table_rows(spark, sf):
    rows = S.table_rows(S.segment(markdown_documents(store(spark, sf))))
    return rows.select("path", "revision", "block_ordinal", "ordinal", "table_ordinal", "kind", "cells")


@query("row_census", f"SELECT count(*) AS lines, count_if(kind = 'header')::BIGINT AS header, count_if(kind = 'content')::BIGINT AS content, count_if(kind = 'separator')::BIGINT AS separator FROM ({ROWS_SQL})", covers="116 117")
def row_census(spark, sf):
    return S.row_census(S.table_rows(S.segment(markdown_documents(store(spark, sf)))))


@query("rows_of_documents", f"SELECT path, block_ordinal, ordinal, array_to_string(cells, ' | ') AS cells FROM ({ROWS_SQL}) WHERE kind = 'content'", covers="78 189")
def rows_of_documents(spark, sf):
    docs = markdown_documents(store(spark, sf))
    blocks = S.segment(docs)
    rows = S.table_rows(blocks).filter("kind = 'content'")
    keyed = blocks.select("path", "revision", F.col("ordinal").alias("block_ordinal"))
    return rows.join(keyed, ["path", "revision", "block_ordinal"]).join(docs.select("path", "revision"), ["path", "revision"]).select("path", "block_ordinal", "ordinal", F.array_join("cells", " | ").alias("cells"))


@query("table_defects", "SELECT path, revision, ordinal AS block_ordinal, 1::BIGINT AS table_ordinal, 1::BIGINT AS rows, 0::BIGINT AS separators, 'no-separator' AS defect FROM blocks WHERE kind <> 'code' AND regexp_matches(text, '^[\\s\\x0b]*\\|.*\\|[\\s\\x0b]*$') AND NOT regexp_matches(text, '^[\\s\\x0b]*\\|[|\\s:-]*--[|\\s:-]*\\|[\\s\\x0b]*$')", covers="181")
def table_defects(spark, sf):
    return S.table_defects(S.table_rows(store(spark, sf).blocks))


@query("record_front_matter", "SELECT DISTINCT 'conv/' || conv_id AS path, 'C-' || conv_id AS record_id, false AS refused FROM conversations", covers="15")
def record_front_matter(spark, sf):
    return S.records(markdown_documents(store(spark, sf))).select("path", "record_id", F.coalesce("refused", F.lit(False)).alias("refused"))


@query("headings", f"WITH t AS ({_TURNS}) SELECT path, 'Conversation ' || conv_id AS title, 1 AS depth FROM t WHERE k = 1 UNION ALL SELECT path, role || ' ' || turn, 2 FROM t", covers="76 182")
def headings(spark, sf):
    return S.headings(S.segment(markdown_documents(store(spark, sf)))).select("path", "title", "depth")


@query("inline_statements", "SELECT path, 'BM-' || doc_id AS statement_id, 'of ' || lang AS statement FROM docs", covers="13 14")
def inline_statements(spark, sf):
    d = store(spark, sf).docs
    return S.inline_statements(d.select("path", F.concat(F.lit("x {#BM-"), F.col("doc_id").cast("string"), F.lit("} of "), "lang", F.lit("\nnext")).alias("text")))


# ---- differences -----------------------------------------------------------------------------


@query("block_diff", "WITH a AS (SELECT path, ordinal, text FROM blocks), b AS (SELECT path, ordinal, CASE WHEN doc_id % 3 = 1 AND ordinal % 4 = 0 THEN text || ' more' ELSE text END AS text FROM blocks WHERE NOT (doc_id % 3 = 2 AND ordinal = 2)), ax AS (SELECT *, row_number() OVER (PARTITION BY path, text ORDER BY ordinal) AS rn FROM a), bx AS (SELECT *, row_number() OVER (PARTITION BY path, text ORDER BY ordinal) AS rn FROM b), e AS (SELECT ax.path, ax.ordinal AS ao, bx.ordinal AS bo FROM ax JOIN bx USING (path, text, rn)), a1 AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.path = a.path AND e.ao = a.ordinal)), b1 AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.path = b.path AND e.bo = b.ordinal)), an AS (SELECT *, row_number() OVER (PARTITION BY path, n ORDER BY ordinal) AS rn FROM (SELECT *, " + norm_sql("text") + " AS n FROM a1)), bn AS (SELECT *, row_number() OVER (PARTITION BY path, n ORDER BY ordinal) AS rn FROM (SELECT *, " + norm_sql("text") + " AS n FROM b1)), f AS (SELECT an.path, an.ordinal AS ao, bn.ordinal AS bo FROM an JOIN bn USING (path, n, rn)), a2 AS (SELECT * FROM a1 WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = a1.path AND f.ao = a1.ordinal)), b2 AS (SELECT * FROM b1 WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = b1.path AND f.bo = b1.ordinal)) SELECT path, ao AS a_ordinal, bo AS b_ordinal, CASE WHEN ao = bo THEN 'same' ELSE 'moved' END AS change FROM e UNION ALL SELECT path, ao, bo, 'reflowed' FROM f UNION ALL SELECT coalesce(a2.path, b2.path), a2.ordinal, b2.ordinal, CASE WHEN b2.path IS NULL THEN 'removed' WHEN a2.path IS NULL THEN 'added' ELSE 'reworded' END FROM a2 FULL JOIN b2 ON a2.path = b2.path AND a2.ordinal = b2.ordinal", covers="242")
def block_diff(spark, sf):
    a = store(spark, sf).blocks
    text = F.when((F.col("doc_id") % 3 == 1) & (F.col("ordinal") % 4 == 0), F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    b = a.filter(~((F.col("doc_id") % 3 == 2) & (F.col("ordinal") == 2))).select("path", "ordinal", X.content_hash(text).alias("content_hash"), X.normalised_hash(text).alias("normalized_hash"))
    return D.block_diff(a, b)


@query("identity_diff", "SELECT a.node_id, f AS field, CASE f WHEN 'title' THEN a.title ELSE a.deleted_at END AS was, CASE f WHEN 'title' THEN upper(a.title) || CASE WHEN a.kind = 'region' THEN '!' ELSE '' END ELSE NULL END AS now FROM nodes a, (SELECT unnest(['title', 'deleted_at']) AS f) WHERE was IS DISTINCT FROM now", covers="243")
def identity_diff(spark, sf):
    a = store(spark, sf).nodes
    b = a.select("node_id", F.concat(F.upper("title"), F.when(F.col("kind") == "region", "!").otherwise("")).alias("title"), F.lit(None).cast("string").alias("deleted_at"))
    return D.field_diff(a, b, "node_id", ["title", "deleted_at"])


@query("relation_changes", "WITH a AS (SELECT * FROM relations WHERE NOT ends_with(from_node, '1')), b AS (SELECT * FROM relations WHERE NOT ends_with(from_node, '2')) SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)", covers="161")
def relation_changes(spark, sf):
    r = store(spark, sf).relations
    return D.relation_changes(r.filter(~F.endswith("from_node", F.lit("1"))), r.filter(~F.endswith("from_node", F.lit("2"))))


@query("statement_locations", "WITH s AS (SELECT 'S-' || doc_id || '-' || ordinal AS statement_id, path, ordinal, text, doc_id FROM blocks), b AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN ordinal + 1 ELSE ordinal END AS ordinal, normalized FROM blocks WHERE doc_id % 4 <> 3) SELECT statement_id, CASE WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.normalized = " + norm_sql("s.text") + ") THEN 'gone' WHEN EXISTS (SELECT 1 FROM b WHERE b.normalized = " + norm_sql("s.text") + " AND b.path = s.path AND b.ordinal = s.ordinal) THEN 'held' ELSE 'moved' END AS location FROM s", covers="244")
def statement_locations(spark, sf):
    blocks = store(spark, sf).blocks
    s = blocks.select(F.concat(F.lit("S-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("ordinal").cast("string")).alias("statement_id"), "path", "ordinal", "text")
    later = blocks.filter("doc_id % 4 <> 3").withColumn("ordinal", F.when(F.col("doc_id") % 5 == 0, F.col("ordinal") + 1).otherwise(F.col("ordinal")))
    return D.locate_statements(s, later)
