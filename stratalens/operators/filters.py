"""Filters and projections with optional parameters, tiers and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.ordered import EVIDENCE, at_least


class Refused(ValueError):
    """A request that the data or the caller's arguments do not allow."""


class Query:
    """A base DataFrame narrowed by filters that drop out when their value is None."""

    def __init__(self, base: DataFrame):
        self.df = base

    def equal(self, column: str, value) -> "Query":
        return self if value is None else Query(self.df.filter(F.col(column) == value))

    def prefix(self, column: str, value: str | None) -> "Query":
        return self if value is None else Query(self.df.filter(X.like_prefix(column, value)))

    def either(self, first: str, second: str, value) -> "Query":
        return self if value is None else Query(self.df.filter((F.col(first) == value) | (F.col(second) == value)))

    def among(self, key: str, other: DataFrame, other_key: str, column: str, value) -> "Query":
        """Rows whose key stands in ``other`` where its column equals the value; never more rows."""
        if value is None:
            return self
        keys = other.filter(F.col(column) == value).select(F.col(other_key).alias(key))
        return Query(self.df.join(keys, key, "left_semi"))

    def order_by(self, *columns) -> DataFrame:
        return self.df.orderBy(*columns)


def narrow_nodes(nodes: DataFrame, statuses: DataFrame | None = None, *, kind=None, authority=None, suite=None, node=None, title=None, prefix=None, status=None) -> DataFrame:
    """Five equalities, one prefix, and a semi-join on a status."""
    q = Query(nodes).equal("kind", kind).equal("authority", authority).equal("suite_id", suite).equal("node_id", node).equal("title", title).prefix("node_id", prefix)
    if status is not None and statuses is not None:
        q = q.among("node_id", statuses, "node_id", "status", status)
    return q.df


def blank_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def require_honoured(given: dict, honoured: set[str], kind: str) -> None:
    """Refuses a filter that this kind of content does not honour."""
    extra = sorted(k for k, v in given.items() if v is not None and k not in honoured)
    if extra:
        raise Refused(f"{kind} does not honour the filter {', '.join(extra)}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """An empty section is an error, not a thin result."""
    if df.isEmpty():
        raise Refused(f"{what} selects nothing")
    return df


def substitute_subject(filters: dict[str, str | None], subject: str) -> dict[str, str | None]:
    return {k: v.replace("{subject}", subject) if isinstance(v, str) else v for k, v in filters.items()}


def in_scope(path, include: list[str], exclude: list[str]) -> Column:
    """Under an included prefix (all, if none is named) and under no excluded one."""
    inside = X.under_any(path, include) if include else F.lit(True)
    return inside & ~X.under_any(path, exclude)


def admitted(locations, include: list[str], exclude: list[str]) -> Column:
    """Findings without a location are admitted; others by any location in scope."""
    c = X.col(locations)
    return (F.size(c) == 0) | F.exists(c, lambda p: in_scope(p, include, exclude))


def selected_rules(rule, include: list[str]) -> Column:
    return X.col(rule).isin(include) if include else F.lit(True)


def evidence_floor(evidence, floor: str) -> Column:
    return at_least(evidence, floor, EVIDENCE)


def find(findings: DataFrame, rule: str, location: str) -> DataFrame:
    """The first finding of the rule at the location, in reading order."""
    hit = findings.filter((F.col("rule") == rule) & F.array_contains("locations", location))
    return hit.orderBy("subject", "summary", "locations").limit(1)


def population(sources: DataFrame, languages: list[str] | None = None, kind: Column | None = None) -> DataFrame:
    """Every source, or those of one or more languages, or those a predicate holds for."""
    if languages is not None:
        sources = sources.filter(F.col("lang").isin(languages))
    return sources if kind is None else sources.filter(kind)


def tiered_path_match(documents: DataFrame, named: str) -> DataFrame:
    """Exact path, else file name, else a part of the path: the first tier with a match wins.

    One pass and one global minimum; the rows stay distributed.
    """
    tier = F.when(F.col("path") == named, 1).when(F.element_at(F.split("path", "/"), -1) == named, 2).when(F.contains("path", F.lit(named)), 3)
    matched = documents.withColumn("tier", tier).filter("tier is not null")
    best = matched.agg(F.min("tier").alias("best"))
    return matched.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


def by_extension(files: DataFrame, known: dict[str, str], path: str = "path") -> DataFrame:
    """Files whose extension a provider recognises, with the provider's language."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    pairs = [F.lit(x) for k, v in known.items() for x in (k, v)]
    return files.withColumn("language", F.create_map(*pairs)[ext]).filter("language is not null")
