"""Audits: unique keys, allowed values, references between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V


def duplicate_keys(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; keys with a NULL part are always distinct."""
    complete = table.filter(~reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys)))
    return complete.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def duplicate_summary(name: str, table: DataFrame, *keys: str) -> DataFrame:
    return duplicate_keys(table, *keys).agg(
        F.lit(name).alias("audit"),
        F.count("*").alias("keys"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    ).select("audit", "keys", "rows")


def unique_keys(*tables: tuple[DataFrame, dict[str, list[str]]]) -> DataFrame:
    """All unique keys of several tables counted in one pass over each table.

    Every table comes with its audits, a name and the columns of its key. A row tells one key per audit; keys with
    a NULL part are always distinct and left out. Repeats are summed map-side, so a key that a third of all rows
    share is one row per task after the first count. Audits without repeats are told with zeros.
    """

    def told(columns: list[str]) -> Column:
        parts = [F.col(c).cast("string") for c in columns]
        complete = reduce(lambda a, b: a & b, (p.isNotNull() for p in parts))
        return F.when(complete, F.to_json(F.array(*parts)))

    keys = []
    for table, audits in tables:
        entry = [F.struct(F.lit(name).alias("audit"), told(c).alias("key")) for name, c in audits.items()]
        keys.append(table.select(F.explode(F.array(*entry)).alias("e")).select("e.audit", "e.key"))
    counted = reduce(DataFrame.unionByName, keys).filter(F.col("key").isNotNull()).groupBy("audit", "key").agg(
        F.count("*").alias("rows")
    )
    repeated = F.col("rows") > 1
    found = counted.groupBy("audit").agg(
        F.count_if(repeated).alias("keys"), F.sum(F.when(repeated, F.col("rows")).otherwise(0)).alias("rows")
    )
    spark = tables[0][0].sparkSession
    names = spark.createDataFrame([(n,) for _, audits in tables for n in audits], "audit string")
    zero = F.lit(0).cast("bigint")
    return names.join(found, "audit", "left").select(
        "audit", F.coalesce("keys", zero).alias("keys"), F.coalesce("rows", zero).alias("rows")
    )


DOMAINS: dict[str, list[str]] = {
    "type": V.TRANSACTION_TYPES,
    "payment_method": V.PAYMENT_METHODS,
    "primary_source": V.SOURCES,
    "parse_status": V.PARSE_STATUSES,
}


def domain_violations(ledger: DataFrame) -> DataFrame:
    """All value-domain rules counted in one pass over the ledger."""

    def broken(column: str, allowed: list[str]) -> Column:
        return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))

    rules = {name: broken(name, allowed) for name, allowed in DOMAINS.items()}
    rules["amount_minor"] = F.col("amount_minor") < 0
    rules["currency_code"] = F.length("currency_code") != 3
    counts = ledger.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "audit", "rows")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent, counted per key."""
    keys = child.filter(F.col(child_key).isNotNull()).groupBy(
        F.col(child_key).cast("bigint").alias("key")
    ).agg(F.count("*").alias("rows"))
    return keys.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def orphan_summary(name: str, *args) -> DataFrame:
    return orphans(*args).agg(
        F.lit(name).alias("audit"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")
    )
