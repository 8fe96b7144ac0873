"""Order-dependent columns that survive hot groups.

A window over a group sorts the whole group in one task. Here the order column is
an integer that is unique inside the group, so cutting it into spans bounds what a
task can receive; what is carried into a span comes from one summary row or the edge rows per
span. The result equals the plain window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN = 1 << 20


def _span(order: str, span: int) -> Column:
    return F.expr(f"`{order}` div {span}L")


def _never_null(rows: DataFrame, key: str) -> Column:
    if rows.schema[key].dataType.simpleString() == "binary":
        return F.coalesce(F.concat(F.unhex(F.lit("01")), F.col(key)), F.unhex(F.lit("")))
    return F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))


def _keyed(rows: DataFrame, keys: list[str], order: str, span: int) -> tuple[DataFrame, list[str]]:
    """Add the span and never-null copies of the keys.

    Plain equality on them lets the join with the carried values reuse the window's
    partitioning; NULL stays a group of its own.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    added = {name: _never_null(rows, key) for name, key in zip(names, keys, strict=True)}
    return rows.withColumns({**added, "_span": _span(order, span)}), names


def running_totals(
    rows: DataFrame, keys: list[str], order: str, totals: dict[str, Column], span: int = SPAN
) -> DataFrame:
    """Inclusive running sums of integer expressions per group."""
    marked, names = _keyed(rows.withColumns(totals), keys, order, span)
    before = Window.partitionBy(*names).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*names, "_span").orderBy(order)
    spans = marked.groupBy(*names, "_span").agg(*[F.sum(n).alias(n) for n in totals])
    carried = spans.select(
        *names, "_span", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_c_{n}") for n in totals]
    )
    local = marked.withColumns({n: F.sum(n).over(inside) for n in totals})
    joined = local.join(carried, [*names, "_span"], "left")
    sums = {n: (F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).cast("bigint") for n in totals}
    return joined.withColumns(sums).select(*rows.columns, *totals)


def previous_value(
    rows: DataFrame, keys: list[str], order: str, value: str, name: str, span: int = SPAN
) -> DataFrame:
    """``lag(value)`` per group."""
    marked, names = _keyed(rows, keys, order, span)
    inside = Window.partitionBy(*names, "_span").orderBy(order)
    local = marked.withColumns(
        {
            "_lag": F.lag(value).over(inside), "_n": F.row_number().over(inside),
            "_ends": F.lead(F.lit(True)).over(inside).isNull(),
        }
    )
    # What precedes the first row of a span is the last row of the span before it.
    across = Window.partitionBy(*names).orderBy(order)
    edges = local.filter((F.col("_n") == 1) | F.col("_ends")).withColumn(name, F.lag(value).over(across))
    within = local.filter(F.col("_n") > 1).withColumn(name, F.col("_lag"))
    columns = [*rows.columns, name]
    return within.select(*columns).unionByName(edges.filter(F.col("_n") == 1).select(*columns))
