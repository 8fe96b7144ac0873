"""Keep costly columns from being evaluated again by later filters.

Catalyst pushes a filter below the projection that defines its columns and repeats
their expressions there; for regular expressions over text that multiplies the work.
A one-row generator is a boundary filters on its output do not cross, costs nothing
per row and stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose expressions are evaluated exactly once per row."""
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*kept, F.inline(F.array(made)))
