"""Live views: streaming aggregates and in-stream deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(messages: DataFrame, delay: str = "30 days") -> DataFrame:
    """Drop re-delivered messages while the watermark keeps their ids.

    Only for views: a message later than ``delay`` is not passed on. The ingest sink
    needs no such bound, since it knows every stored source id.
    """
    timed = messages.withColumn("event_time", F.col("received_at").cast("timestamp"))
    return (
        timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["id"]).drop("event_time")
    )


def daily_totals(parsed: DataFrame) -> DataFrame:
    """Running totals per local day, direction and currency of real payments.

    State is one row per calendar day, direction and currency, so it needs no
    watermark and a row of any age still reaches its day.
    """
    real = parsed.filter(~F.col("is_promotional") & (F.col("parse_status") != "FAILED"))
    return real.groupBy(F.col("txn_ts").cast("date").alias("day"), "type", "currency_code").agg(
        F.sum("amount_minor").alias("amount_minor"), F.count("*").alias("rows")
    )


def upsert_view(view: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every update of a live view as one directory per epoch (replay safe)."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        view.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_view(spark, path: str, *keys: str) -> DataFrame:
    """Latest value per key of an upserted view."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "epoch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v"))
    return latest.select(*keys, "v.*")
