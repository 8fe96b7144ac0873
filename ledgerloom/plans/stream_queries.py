"""Streaming jobs, run to completion over the event table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import alerts, rescoring, tallies
from ledgerloom.plans.oracle_tables import MESSAGES, with_tables
from ledgerloom.plans.registry import query
from ledgerloom.plans.text_queries import _ALERTS, _LOGIT
from ledgerloom.session import shared_dir, stage_table
from ledgerloom.sources import driver_tables as D
from ledgerloom.sources.store import LedgerStore
from ledgerloom.streaming import ingest, live, scans


def _messages(spark, sf_dir):
    """The event file as a stream, rendered into messages."""
    schema = D.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return D.messages(spark, sf_dir, events)


def _ingested(spark, sf_dir) -> LedgerStore:
    store = LedgerStore(spark, shared_dir(spark, "store"))
    ingest.start_ingest(_messages(spark, sf_dir), store, shared_dir(spark, "offsets")).awaitTermination()
    return store


_IDENTIFIED = """
keyed AS (
  SELECT *, CASE WHEN reference_number IS NOT NULL THEN 'v1|REFERENCE|INR:' || amount_minor || '|' || type || '|' || reference_number
    ELSE 'v1|FIELDS|INR:' || amount_minor || '|' || type || '|' || strftime(txn_ts, '%Y-%m-%d') || '|'
      || replace(COALESCE(merchant_name, ''), '-', '') || '|' || COALESCE(right(account_identifier, 4), '') END AS payload FROM alerts),
stored AS (
  SELECT *, row_number() OVER (ORDER BY id) AS number, 'v1:' || sha256(payload) || CASE WHEN row_number() OVER (PARTITION BY payload ORDER BY id) > 1 THEN '+sms:' || id ELSE '' END AS fingerprint
  FROM keyed)"""


@query(
    "stream_ingest",
    with_tables(MESSAGES, _ALERTS, _IDENTIFIED)
    + """SELECT number AS txn_id, amount_minor, type, CAST(txn_ts AS VARCHAR) AS txn_ts, is_promotional, fingerprint, payment_method
         FROM stored""",
)
def stream_ingest(spark, sf_dir):
    return _ingested(spark, sf_dir).ledger().select(
        "txn_id", "amount_minor", "type", "txn_ts", "is_promotional", "fingerprint", "payment_method"
    )


def _in_batches(spark, sf_dir) -> LedgerStore:
    """The messages arriving in two micro-batches; a third repeats messages and retells payments under new ids."""
    store, inbox, offsets = (shared_dir(spark, n) for n in ("store", "inbox", "offsets"))
    store = LedgerStore(spark, store)
    rendered = stage_table(D.messages(spark, sf_dir), "rendered")
    again = rendered.filter(F.col("id") % 10 == 0)
    retold = rendered.filter(F.col("body").contains("UPI/P2M/")).withColumn("id", F.col("id") + 1_000_000_000)
    arrivals = [rendered.filter(F.col("id") % 2 == n) for n in range(2)] + [again.unionByName(retold)]
    for arrived in arrivals:
        arrived.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rendered.schema).parquet(inbox)
        ingest.start_ingest(stream, store, offsets).awaitTermination()
    return store


_BATCHES = """
numbered AS (
  SELECT *, row_number() OVER (ORDER BY id % 2, id) AS number, id % 2 AS batch, CAST(txn_ts AS DATE) AS day FROM alerts),
day_batch AS (
  SELECT day, type, currency_code, batch, SUM(SUM(amount_minor)) OVER (PARTITION BY day, type, currency_code ORDER BY batch) AS upto
  FROM numbered WHERE NOT is_promotional GROUP BY day, type, currency_code, batch)"""


@query(
    "today_alerts",
    with_tables(MESSAGES, _ALERTS, _BATCHES)
    + """SELECT number AS txn_id, CAST(n.day AS VARCHAR) AS day, n.type, amount_minor, CAST(upto AS BIGINT) AS day_total
         FROM numbered n JOIN day_batch d ON d.day = n.day AND d.type = n.type AND d.currency_code = n.currency_code AND d.batch = n.batch
         WHERE NOT is_promotional""",
)
def today_alerts(spark, sf_dir):
    """Three batches and a compaction: every created payment is told once, with its day's total by then."""
    store = _in_batches(spark, sf_dir)
    store.compact()
    return store.alerts().select("txn_id", "day", "type", "amount_minor", "day_total")


@query(
    "live_totals",
    with_tables(MESSAGES, _ALERTS, """
real AS (SELECT CAST(CAST(date_trunc('month', txn_ts) AS DATE) AS VARCHAR) AS month, * FROM alerts WHERE NOT is_promotional)""")
    + """SELECT CASE type WHEN 'CREDIT' THEN 'income' ELSE 'expenses' END AS part, month, currency_code,
         CAST(SUM(amount_minor) AS BIGINT) AS amount, COUNT(*) AS entries, CAST(NULL AS DOUBLE) AS share FROM real GROUP BY 1, 2, 3
       UNION ALL SELECT 'category none', month, currency_code, CAST(SUM(amount_minor) AS BIGINT), COUNT(*), 1.0 FROM real WHERE type = 'DEBIT' GROUP BY 2, 3
       UNION ALL SELECT 'all', NULL, NULL, NULL, COUNT(*), NULL FROM real""",
)
def live_totals(spark, sf_dir):
    """Month totals, categories and the count of payments, kept while batches arrive; merged and repeated messages count once."""
    kept = _in_batches(spark, sf_dir).tallies()
    months, none = tallies.month_totals(kept), F.lit(None)
    sides = [
        months.filter(F.col(f"{side}_count") > 0).select(
            F.lit(name).alias("part"), F.col("month").cast("string").alias("month"), "currency_code",
            F.col(name).alias("amount"), F.col(f"{side}_count").alias("entries"), none.cast("double").alias("share"),
        )
        for side, name in (("income", "income"), ("expense", "expenses"))
    ]
    by_category = tallies.category_totals(kept).select(
        F.concat(F.lit("category "), F.coalesce(F.col("category_id").cast("string"), F.lit("none"))),
        F.col("month").cast("string"), "currency_code", "amount", "transaction_count", "share",
    )
    count = tallies.total_count(kept).select(
        F.lit("all"), none.cast("string"), none.cast("string"), none.cast("bigint"), "transactions", none.cast("double")
    )
    return sides[0].union(sides[1]).union(by_category).union(count)


@query(
    "stream_daily",
    with_tables(MESSAGES, _ALERTS)
    + """SELECT CAST(CAST(txn_ts AS DATE) AS VARCHAR) AS day, type, currency_code, CAST(SUM(amount_minor) AS BIGINT) AS amount_minor,
         COUNT(*) AS rows FROM alerts WHERE NOT is_promotional GROUP BY 1, 2, 3""",
)
def stream_daily(spark, sf_dir):
    view = live.daily_totals(alerts.extract(_messages(spark, sf_dir)))
    path = shared_dir(spark, "view")
    live.upsert_view(view, path, shared_dir(spark, "offsets")).awaitTermination()
    return live.read_view(spark, path, "day", "type", "currency_code")


@query(
    "stream_dedup",
    with_tables(MESSAGES) + "SELECT address, COUNT(*) AS messages FROM messages GROUP BY address",
)
def stream_dedup(spark, sf_dir):
    """Every message delivered twice, kept once."""
    messages = _messages(spark, sf_dir)
    twice = messages.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    path = shared_dir(spark, "kept")
    (
        live.deduplicated(twice).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", shared_dir(spark, "offsets"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(path).groupBy("address").agg(F.count("*").alias("messages"))


def _scanned(spark, sf_dir, consume) -> scans.ScanLog:
    """Four scans: the first ten days; nothing new; the rest, with older messages told again; nothing new at an earlier clock."""
    inbox, offsets = shared_dir(spark, "inbox"), shared_dir(spark, "offsets")
    log = scans.ScanLog(spark, shared_dir(spark, "scans"))
    rendered = stage_table(D.messages(spark, sf_dir), "rendered")
    first = rendered.agg(F.date_trunc("day", F.min("received_at")).cast("timestamp_ntz")).first()[0] or dt.datetime(2024, 1, 1)
    border = first + dt.timedelta(days=10)
    early = F.col("received_at") < F.lit(border).cast("timestamp_ntz")
    arrivals = [rendered.filter(early), None, rendered.filter(~early | (F.col("id") % 10 == 0)), None]
    for arrived, days in zip(arrivals, (0, 2, 0, 1), strict=True):
        if arrived is not None:
            arrived.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rendered.schema).parquet(inbox)
        scans.scan(stream, log, offsets, lambda batch, epoch: consume(offsets, batch, epoch), border + dt.timedelta(days=days))
    return log


_SCANNED = """
border AS (SELECT date_trunc('day', MIN(received_at)) + INTERVAL 10 DAY AS edge FROM messages),
arrived AS (
  SELECT id, received_at, edge, CASE WHEN received_at < edge THEN 1 ELSE 3 END AS scan, received_at >= edge AND received_at <= edge + INTERVAL 2 DAY AS late FROM messages, border
  UNION ALL SELECT id, received_at, edge, 3, TRUE FROM messages, border WHERE id % 10 = 0 AND received_at < edge)"""


@query(
    "scan_counters",
    with_tables(MESSAGES, _ALERTS, _SCANNED)
    + """, counted AS (
      SELECT scan, COUNT(*) FILTER (WHERE NOT late) AS scanned, COUNT(*) FILTER (WHERE late) AS late,
             COUNT(*) FILTER (WHERE NOT late AND id IN (SELECT id FROM alerts)) AS parsed, MAX(id) FILTER (WHERE NOT late) AS newest_id,
             MAX(received_at) FILTER (WHERE NOT late) AS cursor_at, arg_max(id, received_at) FILTER (WHERE NOT late) AS cursor_id
      FROM arrived GROUP BY scan)
      SELECT * REPLACE (CAST(cursor_at AS VARCHAR) AS cursor_at) FROM counted, (VALUES ('batch'), ('end')) k(kind)
      UNION ALL SELECT 2, 0, 0, 0, NULL, CAST(edge + INTERVAL 2 DAY AS VARCHAR), 9223372036854775807, 'end' FROM border
      UNION ALL SELECT 4, 0, 0, 0, NULL, CAST(cursor_at AS VARCHAR), cursor_id, 'end' FROM counted WHERE scan = 3""",
)
def scan_counters(spark, sf_dir):
    """Per scan and batch: messages read, late ones, alerts made of them, newest id and the cursor reached."""
    log = _scanned(spark, sf_dir, lambda run, batch, epoch: alerts.extract(batch).count())
    return log.rows().filter(F.col("kind") != "begin").drop("run", "epoch")


@query(
    "strict_cursor",
    with_tables(MESSAGES, _ALERTS, _SCANNED)
    + """SELECT row_number() OVER (ORDER BY scan, id) AS txn_id, amount_minor, type, CAST(txn_ts AS VARCHAR) AS txn_ts, is_promotional
         FROM alerts JOIN arrived USING (id) WHERE NOT late""",
)
def strict_cursor(spark, sf_dir):
    """The ledger after scans with a strict cursor: late messages are never read."""
    store = LedgerStore(spark, shared_dir(spark, "store"))

    def consume(run, batch, epoch):
        ingest.ingest_messages(store, batch, run, epoch)
        return store.parsed_rows(run, epoch)

    _scanned(spark, sf_dir, consume)
    return store.ledger().select("txn_id", "amount_minor", "type", "txn_ts", "is_promotional")


@query(
    "rescore_store",
    with_tables(MESSAGES)
    + f"""SELECT row_number() OVER (ORDER BY id) AS txn_id, cents AS amount_minor,
          1.0 / (1.0 + exp(-CAST({_LOGIT} AS DOUBLE))) >= 0.72 AS is_promotional FROM messages WHERE event_type <> 'error'""",
)
def rescore_store(spark, sf_dir):
    """A stored ledger whose rows were all shown once, judged anew from its own texts."""
    store = _ingested(spark, sf_dir)
    shown = store.ledger().filter("is_promotional").withColumn("is_promotional", F.lit(False))
    store.amend(shown, "all-shown")
    rescoring.rescore_store(store, "rescore")
    return store.ledger().select("txn_id", "amount_minor", "is_promotional")
