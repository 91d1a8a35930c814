"""Closed vocabularies whose members compare by declared order, and the guarantee order.

Fixed values; a later member of an ordered vocabulary is the higher one.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EVIDENCE = ["AgentJudged", "HumanAsserted", "Predicted", "Approximate", "Derived", "Observed", "Verified", "Authoritative"]
GATE = ["Review", "Unreachable", "Advisory", "Blocking"]
APPLICABILITY = ["Supported", "SupportedWithFallback", "PartiallySupported", "NotApplicable", "MissingCapability", "ProviderUnavailable", "DependencyUnavailable", "ConfigurationDisabled", "Unparseable", "AnalysisFailed", "AgentRequired"]
EVALUATED = ["Supported", "SupportedWithFallback", "PartiallySupported"]
COVERAGE_DEBT = ["MissingCapability", "ProviderUnavailable", "DependencyUnavailable", "Unparseable", "AnalysisFailed"]
VARIANT = ["Predicted", "Approximate", "Syntactic", "SemanticallyResolved", "RuntimeObserved"]
GRANULARITY = ["None", "WholeWorkspace", "Project", "File", "Symbol", "Region"]
DISPOSITIONS = ["preserved-verbatim", "preserved-normalized", "superseded", "regression-filler", "omitted"]
PRESERVED = ["preserved-verbatim", "preserved-normalized"]


def rank(c, order: list[str]) -> Column:
    """Place of a member in its vocabulary, from 0; null for others."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(at > 0, (at - 1).cast("int"))


def at_rank(r: Column, order: list[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in order]), r)


def at_least(c, floor: str, order: list[str]) -> Column:
    return rank(c, order) >= F.lit(order.index(floor))


def can_fail(gate="gate", applicability="applicability") -> Column:
    """A finding can fail a build: it blocks, and its rule could be evaluated."""
    return (F.col(gate) == "Blocking") & F.col(applicability).isin(EVALUATED)


def is_coverage_debt(c="applicability") -> Column:
    return F.col(c).isin(COVERAGE_DEBT)


def satisfies(offered: str, required: str) -> Column:
    """Guarantee of prefix ``offered`` reaches the one of ``required`` on all four axes.

    Columns: <prefix>variant, <prefix>soundness, <prefix>completeness, <prefix>incremental.
    An assurance only counts as given when it is Sound.
    """
    o, r = (lambda n: F.col(offered + n)), (lambda n: F.col(required + n))
    sound = lambda n: (r(n) != "Sound") | (o(n) == "Sound")
    return (rank(o("variant"), VARIANT) >= rank(r("variant"), VARIANT)) & sound("soundness") & sound("completeness") & (rank(o("incremental"), GRANULARITY) >= rank(r("incremental"), GRANULARITY))


def standing(offered: str, against: str) -> Column:
    there, back = satisfies(offered, against), satisfies(against, offered)
    return F.when(there & back, "equivalent").when(there, "stronger").when(back, "weaker").otherwise("incomparable")


def coarser(a, b) -> Column:
    """The coarser of two granularities."""
    return at_rank(F.least(rank(a, GRANULARITY), rank(b, GRANULARITY)), GRANULARITY)
