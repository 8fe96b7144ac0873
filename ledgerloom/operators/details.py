"""Transaction detail and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.session import stage_table

#: Entries of one list of a payment's detail; more entries go on in the next chunk.
CHUNK = 1000

#: Bits of ``monotonically_increasing_id`` that hold the place inside a partition.
_PLACE_BITS = 33


def transaction_labels(bridge: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of every transaction, ordered by the label's own order."""
    named = labels.select(F.col("id").alias("label_id"), "name", "sort_order")
    return bridge.join(named, "label_id").select("txn_id", "label_id", "name", "sort_order")


def transaction_detail(
    ledger: DataFrame,
    categories: DataFrame,
    sources: DataFrame,
    bridge: DataFrame,
    labels: DataFrame,
) -> DataFrame:
    """Each transaction with its category, sources and labels, in tall form.

    One ``TRANSACTION`` row per payment plus one ``SOURCE`` row per contributor and
    one ``LABEL`` row per label, sorted together. Unlike nested lists this has no
    bound on how many rows one payment may own: the sort splits them.
    """
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    head = ledger.join(named, "category_id", "left").select(
        "txn_id", F.lit(0).alias("part"), F.lit("TRANSACTION").alias("item"),
        F.col("merchant_name").alias("value"), F.col("category").alias("extra"),
        F.col("txn_ts").alias("at"), F.lit(0).cast("bigint").alias("sort_order"),
    )
    ids = ledger.select("txn_id")
    origin = sources.join(ids, "txn_id", "left_semi").select(
        "txn_id", F.lit(1).alias("part"), F.lit("SOURCE").alias("item"),
        F.concat_ws(":", "source", "source_identifier").alias("value"),
        F.col("origin_label").alias("extra"), F.col("imported_at").alias("at"),
        F.lit(0).cast("bigint").alias("sort_order"),
    )
    tags = transaction_labels(bridge, labels).join(ids, "txn_id", "left_semi").select(
        "txn_id", F.lit(2).alias("part"), F.lit("LABEL").alias("item"), F.col("name").alias("value"),
        F.lit(None).cast("string").alias("extra"), F.lit(None).cast("timestamp_ntz").alias("at"),
        F.col("sort_order").cast("bigint").alias("sort_order"),
    )
    return head.unionByName(origin).unionByName(tags).orderBy(
        "txn_id", "part", "at", "sort_order", "value"
    )


def chunked(
    rows: DataFrame, key: str, order: list[str], name: str, size: int = CHUNK,
    stage: Callable[[DataFrame, str], DataFrame] = stage_table,
) -> DataFrame:
    """The rows of every key as lists ``name`` of at most ``size`` structs: ``key, chunk, name``.

    Lists follow ``order`` (nulls first), then a hash of the row. The sort is cut into ranges
    anywhere but between rows equal in everything, so a key with very many rows fills many tasks;
    a row's place in its key is its place in the range plus what earlier ranges hold of the key.
    Rows without a key are left out.
    """
    fields = [c for c in rows.columns if c != key]
    keyed = rows.filter(F.col(key).isNotNull()).withColumn("_tie", F.xxhash64(*rows.columns))
    order_by = [key, *order, "_tie"]
    ranged = keyed.repartitionByRange(*order_by).sortWithinPartitions(*order_by).drop("_tie")
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "detail").withColumn(
        "_part", F.shiftright("_at", _PLACE_BITS)
    )
    # One row per key and range: a key has at most as many as there are ranges.
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).select(
        key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    place = F.col("_at") + F.col("_shift")
    listed = placed.join(starts, [key, "_part"]).select(
        key, F.floor(place / size).alias("chunk"), F.struct(place.alias("place"), F.struct(*fields).alias("row")).alias("item")
    )
    return listed.groupBy(key, "chunk").agg(F.array_sort(F.collect_list("item")).alias("items")).select(
        key, "chunk", F.transform("items", lambda x: x["row"]).alias(name)
    )


def full_detail(
    ledger: DataFrame,
    categories: DataFrame,
    sources: DataFrame,
    bridge: DataFrame,
    labels: DataFrame,
    size: int = CHUNK,
    stage: Callable[[DataFrame, str], DataFrame] = stage_table,
) -> DataFrame:
    """Every payment with all its columns, its category's name, and lists of sources and labels.

    ``sources`` are listed by import time, source, source id and origin, ``labels`` by their own order and
    name. A list holds ``size`` entries at most: a payment with more has further rows, which repeat
    its columns under the next ``chunk``. A payment without sources or labels has empty lists;
    sources and labels without a payment are left out, as are unknown labels and category names.
    """
    origins = sources.join(ledger.select("txn_id"), "txn_id", "left_semi")
    tags = transaction_labels(bridge, labels).join(ledger.select("txn_id"), "txn_id", "left_semi")
    per_source = chunked(origins, "txn_id", ["imported_at", "source", "source_identifier", "origin_label"], "sources", size, stage)
    per_label = chunked(tags, "txn_id", ["sort_order", "name"], "labels", size, stage)
    lists = per_source.join(per_label, ["txn_id", "chunk"], "full")
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    empty = {c: F.coalesce(c, F.array().cast(lists.schema[c].dataType)) for c in ("sources", "labels")}
    return (
        ledger.join(named, "category_id", "left")
        .join(lists, "txn_id", "left")
        .withColumns({"chunk": F.coalesce("chunk", F.lit(0)), **empty})
        .select(*ledger.columns, "category", "chunk", "sources", "labels")
    )
