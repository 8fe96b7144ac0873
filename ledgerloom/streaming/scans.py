"""Scans behind a strictly increasing (time, id) cursor, and what each of them counted.

The stream's own offsets find the files that arrived since the last scan, so nothing old is read again; the cursor
decides which of their messages are read. A message at or before the cursor is late: counted, never read. A scan
that finds nothing to read moves the cursor to its own time, so older messages that arrive afterwards are late too.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.messages import Cursor, is_after

SCANS_SCHEMA = (
    "scan bigint, kind string, run string, epoch bigint, scanned bigint, late bigint, parsed bigint, "
    "newest_id bigint, cursor_at timestamp_ntz, cursor_id bigint"
)
#: The id of a cursor set by the clock: every message of that very instant counts as read.
ANY_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Opened:
    """A scan under way: its number and where the cursor stood when it began."""

    number: int
    cursor: Cursor | None


class ScanLog:
    """Rows of scans: one when a scan begins, one per batch, one when it ends.

    A scan without its last row was cut short; the next one goes on under the same number and the same cursor, so
    a lost driver changes neither what is read nor what is counted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], SCANS_SCHEMA)
        return self.spark.read.schema(SCANS_SCHEMA).parquet(self.path)

    def write(self, scan: int, kind: str, cursor: Cursor | None, run=None, epoch=None, counts=(0, 0, 0), newest=None):
        at = (None, None) if cursor is None else (cursor.received_at, cursor.id)
        row = self.spark.createDataFrame([(scan, kind, run, epoch, *counts, newest, *at)], SCANS_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(self.path)

    def cursor(self, rows: DataFrame | None = None) -> Cursor | None:
        """The furthest point reached; it never goes back."""
        known = (self.rows() if rows is None else rows).filter(F.col("cursor_at").isNotNull())
        top = known.agg(F.max(F.struct("cursor_at", "cursor_id")).alias("c")).first()["c"]
        return None if top is None else Cursor(top["cursor_at"], top["cursor_id"])

    def begin(self, full: bool = False) -> Opened:
        """Open a scan, or go on with one that was cut short. A full scan starts without a cursor."""
        last = self.rows().groupBy("scan").agg(
            F.max_by(F.struct("cursor_at", "cursor_id"), F.col("kind") == "begin").alias("c"),
            F.bool_or(F.col("kind") == "end").alias("ended"),
        ).orderBy(F.desc("scan")).first()
        if last is not None and not last["ended"]:
            c = last["c"]
            return Opened(last["scan"], None if c["cursor_at"] is None else Cursor(c["cursor_at"], c["cursor_id"]))
        opened = Opened(1 if last is None else last["scan"] + 1, None if full else self.cursor())
        self.write(opened.number, "begin", opened.cursor)
        return opened

    def has_batch(self, run: str, epoch: int) -> bool:
        return not self.rows().filter((F.col("run") == run) & (F.col("epoch") == epoch)).isEmpty()

    def end(self, opened: Opened, now: dt.datetime) -> None:
        """Close a scan with the sums of its batches; with nothing read the clock moves the cursor on."""
        batches = self.rows().filter((F.col("scan") == opened.number) & (F.col("kind") == "batch"))
        sums = batches.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("scanned", "late", "parsed")], F.max("newest_id")).first()
        reached = self.cursor()
        if sums[0] == 0 and opened.cursor is not None:
            reached = max(reached, Cursor(now, ANY_ID), key=lambda c: (c.received_at, c.id))
        self.write(opened.number, "end", reached, counts=tuple(sums[:3]), newest=sums[3])


def scan(
    messages: DataFrame,
    log: ScanLog,
    checkpoint: str,
    consume: Callable[[DataFrame, int], int],
    now: dt.datetime | None = None,
    full: bool = False,
) -> int:
    """Read everything that arrived, batch by batch, and return the scan's number.

    ``consume`` takes the batch's messages after the cursor and its epoch and returns how many rows it made of them;
    it must leave a batch it has seen alone, since a batch whose row was not written yet is given to it again.
    All batches of a scan are held against the cursor it began with: files may arrive in any order within one scan.
    A full rescan is a call with ``full`` and a new checkpoint.
    """
    opened = log.begin(full)

    def sink(batch: DataFrame, epoch: int) -> None:
        if log.has_batch(checkpoint, epoch):
            return
        fresh = F.lit(True) if opened.cursor is None else F.coalesce(is_after(batch, opened.cursor), F.lit(False))
        place = F.when(fresh & F.col("received_at").isNotNull(), F.struct("received_at", "id"))
        told = batch.agg(
            F.count_if(fresh), F.count_if(~fresh), F.max(place), F.max(F.when(fresh, F.col("id")))
        ).first()
        parsed = consume(batch.filter(fresh), epoch) if told[0] else 0
        reached = None if told[2] is None else Cursor(told[2]["received_at"], told[2]["id"])
        log.write(opened.number, "batch", reached, checkpoint, epoch, (told[0], told[1], parsed), told[3])

    (
        messages.writeStream.queryName("message-scan").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    )
    log.end(opened, now or dt.datetime.now())
    return opened.number
