"""Bulk edits: one job applies a table of edits; the last write per field wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions.text import strip


def latest_edits(edits: DataFrame) -> DataFrame:
    """Last write per transaction for each editable field (map-side combined)."""
    order = F.struct("edited_at", F.col("is_clear").cast("int"), "value")

    def last(field: str) -> Column:
        mine = F.col("field") == field
        write = F.struct("value", "is_clear", "edited_at")
        return F.max_by(F.when(mine, write), F.when(mine, order)).alias(field)

    return edits.groupBy("txn_id").agg(
        last("category"), last("ignored"), last("promotional"), F.max("edited_at").alias("edited_at")
    )


def apply_edits(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """``category`` may be cleared (an explicit marker, since NULL is a value)."""
    joined = ledger.join(latest_edits(edits), "txn_id", "left")

    def written(field: str, current: str, type_: str) -> Column:
        write = F.col(field)
        value = F.when(~write["is_clear"], write["value"].try_cast(type_))
        return F.when(write.isNotNull(), value).otherwise(F.col(current)).alias(current)

    changed = {
        "category_id": written("category", "category_id", "bigint"),
        "is_ignored": F.coalesce(written("ignored", "is_ignored", "boolean"), F.lit(False)),
        "is_promotional": F.coalesce(
            written("promotional", "is_promotional", "boolean"), F.lit(False)
        ),
        "updated_at": F.coalesce("edited_at", "updated_at"),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in ledger.columns])


def name_collisions(labels: DataFrame) -> DataFrame:
    """Label names that differ only in case or outer blanks."""
    return (
        labels.groupBy(F.lower(strip(F.col("name"))).alias("folded"))
        .agg(F.count("*").alias("labels"))
        .filter(F.col("labels") > 1)
    )


def label_id(folded: Column) -> Column:
    """A permanent id above the built-in range, derived from the folded name.

    No counter has to be read or ordered, so any number of requests can be numbered
    in parallel and a retried task numbers them the same way.
    """
    positive = F.xxhash64(folded).bitwiseAND(F.lit((1 << 62) - 1))
    return positive + F.lit(1_000)


def create_labels(labels: DataFrame, requests: DataFrame) -> DataFrame:
    """Custom labels for requested names (name, color_hex).

    Names are trimmed, must not be empty and must be new regardless of case; of
    several requests for one name the first by spelling wins.
    """
    wanted = (
        requests.select(strip(F.col("name")).alias("name"), "color_hex")
        .filter(F.length("name") > 0)
        .groupBy(F.lower("name").alias("folded"))
        .agg(F.min(F.struct("name", "color_hex")).alias("r"))
        .join(labels.select(F.lower("name").alias("folded")), "folded", "left_anti")
    )
    hex_code = F.substring(F.regexp_replace("r.color_hex", "^#", ""), 1, 6)
    fresh = wanted.select(
        label_id(F.col("folded")).alias("id"),
        F.col("r.name").alias("name"),
        F.when(F.length(hex_code) > 0, hex_code).otherwise(V.CUSTOM_LABEL_COLOR).alias("color_hex"),
        F.lit(False).alias("is_system_defined"),
        F.lit(V.CUSTOM_LABEL_SORT).alias("sort_order"),
    )
    return labels.unionByName(fresh)


def delete_custom_labels(
    labels: DataFrame, bridge: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Built-in labels stay; the bridge follows (cascade)."""
    doomed = (
        labels.filter(~F.col("is_system_defined"))
        .join(ids.select("id").distinct(), "id", "left_semi")
        .select("id")
    )
    kept = labels.join(doomed, "id", "left_anti")
    return kept, bridge.join(doomed.select(F.col("id").alias("label_id")), "label_id", "left_anti")


def set_labels(bridge: DataFrame, requests: DataFrame) -> DataFrame:
    """Attach / detach requests (txn_id, label_id, attached, requested_at): last wins."""
    keys = ["txn_id", "label_id"]
    last = requests.groupBy(*keys).agg(
        F.max_by("attached", F.struct("requested_at", "attached")).alias("attached")
    )
    untouched = bridge.join(last, keys, "left_anti")
    return untouched.unionByName(last.filter("attached").select(*keys))


def delete_transactions(
    ledger: DataFrame, sources: DataFrame, bridge: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove transactions; sources and label links follow."""
    gone = ids.select("txn_id").distinct()
    return tuple(t.join(gone, "txn_id", "left_anti") for t in (ledger, sources, bridge))


def clear_deleted_categories(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """A category that no longer exists leaves its transactions uncategorised."""
    known = categories.select(F.col("id").alias("category_id"), F.lit(True).alias("_known"))
    kept = ledger.join(known, "category_id", "left")
    category = F.when(F.col("_known"), F.col("category_id")).alias("category_id")
    return kept.select(*[category if c == "category_id" else F.col(c) for c in ledger.columns])
