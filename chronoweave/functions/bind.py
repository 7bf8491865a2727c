"""Fix computed columns in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns through a one-row generator.

    Filters on the results then read the computed values; without it the planner rewrites each
    filter onto the full expressions and evaluates them again, past the size a generated method
    may have.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(made)))
