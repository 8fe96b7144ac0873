"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import staged


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("mark")
    ).first()
    return row["n"], row["mark"]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node with a link.

    ``links`` has long columns ``a`` and ``b``; order, repeats and loops do not matter. Each
    round points a node's larger neighbours at its smallest neighbour, then its smaller ones;
    the minima combine before they shuffle, so a hub costs one row per task. Every round is
    a written table: lineage stays short and a lost executor costs a re-read. Nothing but a
    row count and a checksum per round comes to the driver.
    """
    links = staged(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = _state(links)
    while state[0]:
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        low = low.select("a", F.least("a", "low").alias("low"))
        large = (
            both.where(F.col("b") > F.col("a"))
            .join(low, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        small = large.groupBy("a").agg(F.min("b").alias("low"))
        pointed = large.join(small, "a").where(F.col("b") != F.col("low")).select("b", "low")
        links = staged(pointed.union(small).toDF("a", "b").distinct(), "links")
        before, state = state, _state(links)
        if before == state:
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
