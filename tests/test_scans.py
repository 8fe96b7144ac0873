"""Scans behind a cursor, amendments of a store, audits of keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, rescoring, tallies
from ledgerloom.schemas import MESSAGES_SCHEMA
from ledgerloom.sources.messages import Cursor
from ledgerloom.sources.store import LedgerStore
from ledgerloom.streaming import ingest, scans

DAY = dt.datetime(2026, 3, 1)


def _arrive(spark, path, *rows):
    made = [(i, "HDFCBK", f"Rs.{i}.00 debited from a/c XX1234", at) for i, at in rows]
    spark.createDataFrame(made, MESSAGES_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _scan(spark, tmp_path, seen, now=DAY, fail=False, **options):
    def consume(batch, epoch):
        if fail:
            raise RuntimeError("lost")
        ids = sorted(r["id"] for r in batch.collect())
        seen.append(ids)
        return len(ids)

    log = scans.ScanLog(spark, str(tmp_path / "log"))
    stream = spark.readStream.schema(MESSAGES_SCHEMA).parquet(str(tmp_path / "inbox"))
    scans.scan(stream, log, str(tmp_path / options.pop("offsets", "offsets")), consume, now, **options)
    return log


def test_cursor_is_strict_and_never_goes_back(spark, tmp_path):
    inbox, seen, hour = str(tmp_path / "inbox"), [], dt.timedelta(hours=1)
    _arrive(spark, inbox, (1, DAY), (2, DAY), (3, None))
    log = _scan(spark, tmp_path, seen)
    assert seen == [[1, 2, 3]] and log.cursor() == Cursor(DAY, 2)
    # The same instant: only a larger id is later; a message without a time never is.
    _arrive(spark, inbox, (2, DAY), (4, DAY), (5, None), (6, DAY - hour))
    _scan(spark, tmp_path, seen)
    assert seen[1:] == [[4]] and log.cursor() == Cursor(DAY, 4)
    _scan(spark, tmp_path, seen, now=DAY - hour)
    assert log.cursor() == Cursor(DAY, 4)
    _scan(spark, tmp_path, seen, now=DAY + hour)
    assert log.cursor() == Cursor(DAY + hour, scans.ANY_ID)
    _arrive(spark, inbox, (7, DAY + hour), (8, DAY + 2 * hour))
    _scan(spark, tmp_path, seen)
    assert seen[2:] == [[8]]
    ends = log.rows().filter("kind = 'end'").orderBy("scan").select("scanned", "late", "parsed", "newest_id").collect()
    assert [tuple(r) for r in ends] == [(3, 0, 3, 3), (1, 3, 1, 4), (0, 0, 0, None), (0, 0, 0, None), (1, 1, 1, 8)]
    _scan(spark, tmp_path, seen, full=True, offsets="anew")
    assert seen[3:] == [[1, 2, 2, 3, 4, 5, 6, 7, 8]]


def test_a_scan_cut_short_goes_on_with_its_cursor(spark, tmp_path):
    inbox, seen = str(tmp_path / "inbox"), []
    _arrive(spark, inbox, (1, DAY))
    _scan(spark, tmp_path, seen)
    _arrive(spark, inbox, (2, DAY + dt.timedelta(days=1)))
    with pytest.raises(Exception, match="lost"):
        _scan(spark, tmp_path, seen, fail=True)
    log = _scan(spark, tmp_path, seen)
    assert seen == [[1], [2]]
    assert sorted(r["scan"] for r in log.rows().filter("kind <> 'batch'").collect()) == [1, 1, 2, 2]


def test_an_inbox_without_messages_leaves_no_cursor(spark, tmp_path):
    _arrive(spark, str(tmp_path / "inbox"))
    assert _scan(spark, tmp_path, []).cursor() is None


def test_rescored_rows_change_ledger_and_totals(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"))
    texts = [
        (1, "HDFCBK", "Rs.540.00 debited from a/c XX1234 to VPA swiggy@icici UPI Ref 123456789012", DAY),
        (2, "LM-SWIGGY", "Grab Rs 150.00 off. Coupon SAVE150. Limited period offer.", DAY),
    ]
    ingest.ingest_messages(store, spark.createDataFrame(texts, MESSAGES_SCHEMA), "run", 0)
    assert store.parsed_rows("run", 0) == 2 and store.parsed_rows("run", 1) == 0
    shown = store.ledger().filter("is_promotional").withColumn("is_promotional", F.lit(False))
    assert store.amend(shown, "shown") is True and store.amend(shown, "shown") is False
    assert tallies.total_count(store.tallies()).first()[0] == 2
    summary = rescoring.rescore_store(store, "rescore").first()
    assert tuple(summary) == (2, 1)
    assert [r["txn_id"] for r in store.ledger().filter("is_promotional").collect()] == [2]
    assert tallies.total_count(store.tallies()).first()[0] == 1
    assert tuple(rescoring.rescore_store(store, "again").first()) == (1, 0)
    store.compact()
    assert store.ledger().filter("is_promotional").count() == 1 and store.parsed_rows("run", 0) == 0


def test_keys_with_missing_parts_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("ab", ""), ("a", None), ("a", None)], "x string, y string")
    empty = spark.createDataFrame([], "z bigint")
    found = audit.unique_keys((rows, {"pair": ["x", "y"], "x": ["x"]}), (empty, {"none": ["z"]}))
    assert {tuple(r) for r in found.collect()} == {("pair", 1, 2), ("x", 1, 4), ("none", 0, 0)}
