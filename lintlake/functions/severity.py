"""Severity and reviewer vocabularies, and the column expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order (0 is the most severe) and reviewer order.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
CONFIDENCES = ["HIGH", "MEDIUM", "LOW"]
AGENTS = ["security", "privacy", "permission"]

UNKNOWN_SEVERITY_RANK = 5


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL up to 4 for INFO; unknown labels rank last."""
    known = F.array(*[F.lit(s) for s in SEVERITIES])
    position = F.array_position(known, severity)
    return (
        F.when(position > 0, position - 1)
        .otherwise(F.lit(UNKNOWN_SEVERITY_RANK))
        .cast("int")
    )


def agent_rank(agent: Column) -> Column:
    known = F.array(*[F.lit(a) for a in AGENTS])
    return (F.array_position(known, agent) - 1).cast("int")


def check_severity(name: str) -> str:
    """Validate a user-supplied threshold."""
    if name not in SEVERITIES[:4]:
        raise ValueError(
            f"min_severity must be one of {', '.join(SEVERITIES[:4])}; got {name!r}"
        )
    return name
