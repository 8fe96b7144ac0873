"""Incremental ingest: message stream → extraction → resolve against the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom import fixed_values as V
from ledgerloom.operators import alerts, arrival, resolve
from ledgerloom.operators.normalise import normalise
from ledgerloom.schemas import BATCH_COLUMNS
from ledgerloom.session import spread, stage_table
from ledgerloom.sources.messages import with_body
from ledgerloom.sources.store import LedgerStore


def ingest(store: LedgerStore, parsed: DataFrame, run: str, epoch: int) -> bool:
    """Resolve one batch of parsed rows against the store and append it.

    The batch is normalised and written, then put in one arrival order; its numbers go on where the store's end, so a
    transaction id is never given twice. Rows whose reference is stored under an identity of another version
    adopt that. Only partitions of the store are read that the batch's keys fall in. Replays of a committed batch do nothing.
    """
    if store.is_committed(run, epoch):
        return False
    rows = normalise(parsed)
    older = store.older_identities()
    if not older.isEmpty():
        rows = resolve.with_reference_fallback(rows, older)
    rows = arrival.numbered(stage_table(rows, "batch"), store.next_seq())
    before = store.state(rows)
    result = resolve.with_outcomes_written(resolve.resolve(rows, before, numbered=True))
    messages = F.col("source") == "SMS"
    labelled = result.outcomes.withColumn(
        "file_name", F.when(messages, V.MESSAGES_BATCH_NAME).otherwise(F.col("origin_label"))
    )
    history = resolve.import_summary(labelled, "file_name", "source").select(*BATCH_COLUMNS)
    in_messages = F.col("source") == "SMS"
    worded = history.withColumn(
        "error_message",
        F.when(in_messages & (F.col("status") == "FAILED"), V.MESSAGES_BATCH_FAILED_MESSAGE)
        .when(
            in_messages & (F.col("status") == "PARTIAL"),
            F.format_string(V.MESSAGES_BATCH_PARTIAL_MESSAGE, "failed_count"),
        )
        .otherwise(F.col("error_message")),
    )
    return store.append(result, worded, run, epoch, before)


def ingest_messages(store: LedgerStore, batch: DataFrame, run: str, epoch: int, zone: str | None = None) -> bool:
    """Extract one batch of messages and ingest it; bodies are trimmed and empty ones left out."""
    return ingest(store, alerts.extract(spread(with_body(batch)), zone), run, epoch)


def start_ingest(
    messages: DataFrame, store: LedgerStore, checkpoint: str, zone: str | None = None
) -> StreamingQuery:
    """Run everything available as micro-batches and stop.

    Offsets are committed after the sink, and the sink recognises a batch it has
    committed, so a crash at any point neither loses nor doubles a message. A full
    rescan is the same call with a new checkpoint. Bodies are trimmed and empty ones left out; all rows read are counted.
    """
    scanned = messages.observe("scan", F.count("*").alias("scanned"), F.max("id").alias("newest_id"))

    def sink(batch: DataFrame, epoch: int) -> None:
        ingest_messages(store, batch, checkpoint, epoch, zone)

    return (
        scanned.writeStream.queryName("ledger-ingest")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )


def message_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
