"""What must not grow on the driver, and cheap tests that decide before costly ones."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions import money, text
from ledgerloom.operators import alerts, arrival, resolve, statement_text, tallies
from ledgerloom.operators.normalise import normalise
from ledgerloom.schemas import PARSED_SCHEMA
from ledgerloom.session import stage_table
from ledgerloom.sources.store import LEDGER_SCHEMA, OUTCOMES_SCHEMA


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, n=6):
    at = dt.datetime(2026, 1, 2, 3, 4)
    rows = [
        (i, 100, "INR", "DEBIT", at, "d", "Shop", f"41234567890{i % 2}", None, None, "UPI", "SMS", f"sms:{i // 2}", "AX", "PARSED", None, False)
        for i in range(n)
    ]
    return stage_table(normalise(spark.createDataFrame(rows, PARSED_SCHEMA)), "rows")


def test_no_side_that_grows_is_gathered_on_the_driver(spark):
    rows = _rows(spark)
    tagged = stage_table(resolve.tag_rows(rows), "tagged")
    ledger = stage_table(spark.createDataFrame([], LEDGER_SCHEMA), "ledger")
    told = stage_table(spark.createDataFrame([], OUTCOMES_SCHEMA), "outcomes")
    created = tallies.alerts(told, ledger, tallies.summed(tallies.changes(ledger)))
    assert "LeftSemi" in _plan(created) and "BuildRight, false" not in _plan(created).split("LeftSemi")[1].split("\n")[0]
    for job in (resolve.tag_rows(rows), resolve.outcomes(tagged), resolve.fold(resolve._events(tagged, None))):
        assert "Broadcast" not in _plan(job)


def test_arrival_numbers_do_not_shuffle_the_rows_again(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        numbered = arrival.numbered(_rows(spark))
        assert "SortMergeJoin" not in _plan(numbered)
        assert sorted(r["seq"] for r in numbered.collect()) == [1, 2, 3, 4, 5, 6]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_line_is_dated_exactly_if_one_of_its_words_is(one_value):
    lines = [
        "17/09/2026 Paid", "x 2026-09-17,", ';"17-9-26"', "17092026", "a17092026", "117092026 1", "1 Sep 2026", "Sep 17, 2026",
        "17-Sep-2026", " 17/09/2026 ", "12/13/2026", "INR 1,200-00", "ref 412345678901", "", "17 / 09 / 2026", None,
        '"17092026"', "17/09/2026/1", "1/2 3/4", "٣/٤/٢٠٢٦",
    ]

    def plain(line):
        return F.exists(statement_text.tokens(line), statement_text._is_date)

    assert one_value(statement_text._has_date_token, lines) == one_value(plain, lines)


def test_text_that_no_repair_fits_is_left_and_other_text_repaired(one_value):
    raw = ["UPI TransactionID :9", "12:59pm", "PaidtoX", "upitransactionid:1 paidby", "plain", "", None, "Date&time", "UPI Transaction ID:  1"]
    fixed = [
        "UPI Transaction ID: 9", "12:59 pm", "Paid to X", "UPI Transaction ID: 1 Paid by ", "plain", "", None, "Date & time",
        "UPI Transaction ID: 1",
    ]
    assert one_value(statement_text.repair, raw) == fixed


def test_every_reference_passes_the_cheap_test(one_value):
    raw = ["AXIS1234", "AB12 34", "AB123X", "UTR: IMPS412345678901", "Shop XAB", "٣٤٥٦AB", None]
    maybe, real = one_value(text.may_hold_reference, raw), one_value(text.reference, raw)
    assert [m for m, r in zip(maybe, real, strict=True) if r is not None] == [True] * sum(r is not None for r in real)
    assert maybe[4] is False and maybe[6] is None


def test_amounts_without_a_digit_or_a_pattern(one_value):
    assert one_value(money.minor_units, ["Rs.", "rs.5", "--", "", None, "₹٣"]) == [None, 500, None, None, None, None]
    found = one_value(lambda b: F.transform(alerts.amount_hits(b), lambda h: h["minor"]), ["no amount", "Rs.5 or $7", "", None])
    assert found == [[], [500, 700], [], None]


def test_provenance_writes_its_rows_once_before_the_result(spark, sf_dir, monkeypatch):
    from ledgerloom.plans import identity_queries

    written, plain = [], identity_queries.stage_table
    monkeypatch.setattr(identity_queries, "stage_table", lambda df, purpose: written.append(purpose) or plain(df, purpose))
    assert identity_queries.provenance(spark, sf_dir).count() > 0
    assert written == ["normalised"]


def test_copies_share_what_an_order_tells(spark, sf_dir):
    from ledgerloom.sources import driver_tables as D

    plan = D.copies(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2  # the name and its handle, not one for every copy
