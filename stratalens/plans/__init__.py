"""Named queries over the driver's tables."""

from . import context_queries, corpus_queries, gate_queries, graph_queries, rule_queries, syntax_queries, tool_queries  # noqa: F401
from .registry import OPERATORS, ORACLES, QUERIES  # noqa: F401
