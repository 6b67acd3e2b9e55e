"""Constant tables as single SQL expressions.

The planner folds such an expression into one literal, so looking a row up is
an array access; no table has to be joined or broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sql_literal(value) -> str:
    """The value as Spark SQL text."""
    if value is None:
        return "cast(null as string)"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        # A dollar sign is written as an escape, or the parser would take
        # ``${...}`` for a configuration variable.
        escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
        return f"'{escaped}'"
    return f"cast(array({', '.join(sql_literal(v) for v in value)}) as array<string>)"


def rows_literal(rows: Sequence[Mapping[str, object]]) -> Column:
    """An array of structs; every row must have the same fields."""
    structs = [
        "named_struct(" + ", ".join(f"'{name}', {sql_literal(value)}" for name, value in row.items()) + ")"
        for row in rows
    ]
    return F.expr(f"array({', '.join(structs)})")


def texts_literal(values: Sequence[str]) -> Column:
    """An array of strings."""
    return F.expr(f"array({', '.join(sql_literal(v) for v in values)})")


def index_literal(keys: Mapping[str, int]) -> Column:
    """A map from text to number."""
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {v}" for k, v in keys.items()) + ")")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when any of the words occurs in the text."""
    return F.rlike(text, F.lit("|".join(re.escape(w) for w in words)))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once and named inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a wide struct column that the planner will not copy into its users.

    Field accesses on a plain column are pushed into its expression, which
    would evaluate it once per field; a one-element explode keeps it whole.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def exploded(values: Column) -> Column:
    """``explode`` of a column that is costly to compute and holds no nulls.

    For a plain column the planner infers that only rows with a filled array
    matter and pushes that condition, with the whole computation, below; an
    expression around it keeps the computation single.
    """
    return F.explode(F.array_compact(values))
