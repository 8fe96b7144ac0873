"""Built-in dimension rows and their seeding (never overwrites what users changed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V

CATEGORY_SCHEMA = (
    "id bigint, name string, kind string, color_hex string, icon_key string, "
    "is_system_defined boolean, sort_order int"
)
LABEL_SCHEMA = (
    "id bigint, name string, color_hex string, is_system_defined boolean, sort_order int"
)


def default_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.DEFAULT_CATEGORIES, CATEGORY_SCHEMA)


def default_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.DEFAULT_LABELS, LABEL_SCHEMA)


def insert_missing(existing: DataFrame, incoming: DataFrame, *unique_keys: str) -> DataFrame:
    """Append incoming rows that collide with no existing row on any unique key."""
    fresh = incoming
    for key in unique_keys:
        fresh = fresh.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def seed_categories(existing: DataFrame, defaults: DataFrame) -> DataFrame:
    return insert_missing(existing, defaults, "id", "name")


def seed_labels(
    existing: DataFrame,
    defaults: DataFrame,
    bridge: DataFrame,
    stored_version: int,
    version: int = V.DEFAULT_LABELS_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """A newer built-in set replaces the old built-in rows and cascades to the bridge."""
    if stored_version < version:
        existing = existing.filter(~F.col("is_system_defined"))
        bridge = bridge.join(existing.select(F.col("id").alias("label_id")), "label_id", "left_semi")
    return insert_missing(existing, defaults, "id", "name"), bridge


def ordered_categories(categories: DataFrame) -> DataFrame:
    return categories.orderBy("sort_order")


def ordered_labels(labels: DataFrame) -> DataFrame:
    return labels.orderBy("sort_order", "name")
