"""Message inbox reads: full scan, keyset read, counts, newest message."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip


@dataclass(frozen=True)
class Cursor:
    """Progress boundary: everything up to (received_at, id) has been read."""

    received_at: dt.datetime
    id: int


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Whole inbox; bodies trimmed, empty ones dropped."""
    return with_body(spark.read.parquet(path))


def with_body(messages: DataFrame) -> DataFrame:
    return messages.withColumn("body", strip(F.col("body"))).filter(F.length("body") > 0)


def is_after(messages: DataFrame, cursor: Cursor) -> Column:
    """Whether a message lies after the cursor; one without time or id never does.

    The redundant lower bound is a plain conjunct, so it reaches the scan and skips
    row groups.
    """
    at = F.lit(cursor.received_at.isoformat(sep=" ")).cast(messages.schema["received_at"].dataType)
    received = F.col("received_at")
    later = (received > at) | ((received == at) & (F.col("id") > cursor.id))
    return (received >= at) & later


def read_after(messages: DataFrame, cursor: Cursor) -> DataFrame:
    """Messages after the cursor, oldest first."""
    return messages.filter(is_after(messages, cursor)).orderBy("received_at", "id")


def newest(messages: DataFrame) -> DataFrame:
    """(id, received_at) of the newest message: the next cursor."""
    return messages.agg(F.max(F.struct("received_at", "id")).alias("m")).select("m.id", "m.received_at")


def count_messages(messages: DataFrame, mailbox: Column) -> DataFrame:
    """Rows read and rows with a body, per mailbox."""
    return messages.groupBy(mailbox.alias("mailbox")).agg(
        F.count("*").alias("rows_read"), F.count_if(F.col("body").rlike(r"\S")).alias("with_body")
    )
