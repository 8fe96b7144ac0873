"""Column contracts between jobs.

A source adapter is any function from an input DataFrame to a DataFrame with the
``parsed`` columns; ``union_parsed`` appends adapters' outputs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The parsed contract (name, type).
PARSED = [
    ("seq", "bigint"),
    ("amount_minor", "bigint"),
    ("currency_code", "string"),
    ("type", "string"),
    ("txn_ts", "timestamp_ntz"),
    ("description", "string"),
    ("merchant_name", "string"),
    ("reference_number", "string"),
    ("account_identifier", "string"),
    ("bank_name", "string"),
    ("payment_method", "string"),
    ("source", "string"),
    ("source_identifier", "string"),
    ("origin_label", "string"),
    ("parse_status", "string"),
    ("raw_payload", "string"),
    ("is_promotional", "boolean"),
]
PARSED_COLUMNS = [name for name, _ in PARSED]
PARSED_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in PARSED)
MESSAGES_SCHEMA = "id bigint, address string, body string, received_at timestamp_ntz"
TRAINING_SCHEMA = "body string, address string, label int"
BATCH_COLUMNS = [
    "file_name", "source", "total_parsed", "new_count", "merged_count", "duplicate_count",
    "failed_count", "status", "error_message",
]


def as_parsed(df: DataFrame) -> DataFrame:
    """Project onto the parsed contract; columns an adapter cannot know become NULL.

    An adapter with several rows under one ``seq`` may tell their order in ``place``.
    """
    have = set(df.columns)
    place = [F.col("place").cast("int").alias("place")] if "place" in have else []
    return df.select(
        *[
            (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
            for name, kind in PARSED
        ],
        *place,
    )


def union_parsed(*parsed: DataFrame) -> DataFrame:
    """Rows of several adapters; their ``seq`` may collide until ``arrival.numbered`` orders them."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (as_parsed(p) for p in parsed))
