"""Schemas of the store's twenty tables, and the version of their layout.

Strings compare by bytes. Surrogate keys are not kept: relations join by natural keys, which
also travel between stores.
"""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 8


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


# Table: (columns, natural key).
_TABLES = {
    "blobs": ("sha256 string, byte_length bigint, content binary", ["sha256"]),
    "source_documents": ("path string, revision string, sha256 string", ["path", "revision"]),
    "source_headings": ("path string, revision string, title string, depth int", ["path", "revision", "title", "depth"]),
    "source_blocks": ("path string, revision string, ordinal bigint, kind string, heading_path array<string>, text string, content_hash string, normalized_hash string", ["path", "revision", "ordinal"]),
    "nodes": ("node_id string, kind string, authority string, representation string, title string, deleted_at string, suite_id string", ["node_id"]),
    "node_aliases": ("alias string, node_id string", ["alias"]),
    "node_history": ("node_id string, ordinal bigint, event string, recorded_at string, previous_event_hash string, event_hash string", ["node_id", "ordinal"]),
    "relation_types": ("name string, inverse_of string, domain_kinds array<string>, range_kinds array<string>, max_per_node bigint", ["name"]),
    "relations": ("from_node string, type string, to_node string", ["from_node", "type", "to_node"]),
    "normative_statements": ("statement_id string, node_id string, kind string, canonical_text string, canonical_hash string, supersedes_hash string", ["statement_id"]),
    "lineage": ("path string, revision string, block_ordinal bigint, heading string, row_ordinal bigint, disposition string, target_node string, target_statement string", ["path", "revision", "block_ordinal", "heading", "row_ordinal", "target_node", "target_statement"]),
    "omissions": ("path string, revision string, block_ordinal bigint, heading string, reason string, justification string, decision string", ["path", "revision", "block_ordinal", "heading"]),
    "source_table_rows": ("path string, revision string, block_ordinal bigint, ordinal bigint, table_ordinal bigint, kind string, cells array<string>, text string", ["path", "revision", "block_ordinal", "ordinal"]),
    "suites": ("suite_id string, title string, authority_root int", ["suite_id"]),
    "record_front_matter": ("path string, revision string, status string, version string, tags array<string>", ["path", "revision"]),
    "record_relations": ("path string, revision string, ordinal bigint, type string, target string", ["path", "revision", "ordinal"]),
    "submissions": ("node_id string, kind string, state string", ["node_id"]),
    "submission_values": ("submission string, field string, ordinal bigint, origin string, value string, supersedes_hash string", ["submission", "field", "ordinal"]),
    "submission_gaps": ("submission string, ordinal bigint, description string, closed_by string", ["submission", "ordinal"]),
    "repeated_text_declarations": ("normalized_hash string, role string, multiplicity bigint", ["normalized_hash", "role"]),
}

SCHEMAS = {name: columns for name, (columns, _) in _TABLES.items()}
KEYS = {name: key for name, (_, key) in _TABLES.items()}

# Every reference between tables: (table, columns) -> (table, columns).
REFERENCES = [
    ("source_documents", ["sha256"], "blobs", ["sha256"]),
    ("source_blocks", ["path", "revision"], "source_documents", ["path", "revision"]),
    ("source_headings", ["path", "revision"], "source_documents", ["path", "revision"]),
    ("source_table_rows", ["path", "revision", "block_ordinal"], "source_blocks", ["path", "revision", "ordinal"]),
    ("nodes", ["suite_id"], "suites", ["suite_id"]),
    ("node_aliases", ["node_id"], "nodes", ["node_id"]),
    ("node_history", ["node_id"], "nodes", ["node_id"]),
    ("relations", ["from_node"], "nodes", ["node_id"]),
    ("relations", ["to_node"], "nodes", ["node_id"]),
    ("relations", ["type"], "relation_types", ["name"]),
    ("relation_types", ["inverse_of"], "relation_types", ["name"]),
    ("normative_statements", ["node_id"], "nodes", ["node_id"]),
    ("lineage", ["path", "revision", "block_ordinal"], "source_blocks", ["path", "revision", "ordinal"]),
    ("lineage", ["target_node"], "nodes", ["node_id"]),
    ("lineage", ["target_statement"], "normative_statements", ["statement_id"]),
    ("omissions", ["path", "revision", "block_ordinal"], "source_blocks", ["path", "revision", "ordinal"]),
    ("submissions", ["node_id"], "nodes", ["node_id"]),
    ("submission_values", ["submission"], "submissions", ["node_id"]),
    ("submission_gaps", ["submission"], "submissions", ["node_id"]),
]


def struct(table: str) -> T.StructType:
    """The StructType of a table; needs an active session to parse it."""
    return _schema(SCHEMAS[table])
