import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import audit, edits, reports, search
from ledgerloom.operators.ordered import previous_value, running_totals
from ledgerloom.sources import dims

LEDGER = (
    "txn_id long, amount_minor long, currency_code string, type string, txn_ts timestamp_ntz, "
    "category_id long, is_promotional boolean, is_ignored boolean, merchant_name string, "
    "description string, notes string, reference_number string, bank_name string, account_tail string"
)
SEP = dt.datetime(2026, 9, 17, 10)


def ledger(spark, *rows):
    full = []
    for i, r in enumerate(rows):
        base = dict(
            txn_id=i + 1, amount_minor=100, currency_code="INR", type="DEBIT", txn_ts=SEP, category_id=None,
            is_promotional=False, is_ignored=False, merchant_name="Shop", description=None, notes=None,
            reference_number=None, bank_name=None, account_tail="1234",
        )
        base.update(r)
        full.append(tuple(base.values()))
    return spark.createDataFrame(full, LEDGER)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_month_totals_and_change(spark):
    aug = SEP.replace(month=8)
    df = ledger(
        spark, dict(amount_minor=54000), dict(amount_minor=129900), dict(amount_minor=9500000, type="CREDIT"),
        dict(amount_minor=80000, txn_ts=aug), dict(amount_minor=5, is_promotional=True),
        dict(amount_minor=2500, currency_code="USD"),
    )
    [a, s] = reports.month_totals(df).orderBy("month").collect()
    assert (s["income"], s["expenses"], s["net"]) == (9500000, 183900, 9316100)
    assert (s["transaction_count"], s["income_count"], s["expense_count"]) == (4, 1, 2)
    got = {str(r["month"]): r for r in reports.month_over_month(df).collect()}
    assert got["2026-09-01"]["expense_change_ratio"] == round((183900 - 80000) / 80000, 6)
    assert got["2026-08-01"]["previous_expenses"] is None and got["2026-08-01"]["expense_change_ratio"] is None


def test_change_needs_the_calendar_month_before(spark):
    df = ledger(spark, dict(), dict(txn_ts=SEP.replace(month=7)))
    got = reports.month_over_month(df).orderBy("month").collect()
    assert [r["previous_expenses"] for r in got] == [None, None]


def test_category_breakdown(spark):
    df = ledger(
        spark, dict(amount_minor=30000, category_id=1), dict(amount_minor=20000, category_id=1),
        dict(amount_minor=150000, category_id=2), dict(amount_minor=7, category_id=3, currency_code="USD"),
    )
    b = reports.category_breakdown(df, dims.default_categories(spark))
    got = {r["category"]: (r["amount"], r["transaction_count"], r["share"], r["currency_code"]) for r in b.collect()}
    assert got == {
        "Food": (50000, 2, 0.25, "INR"), "Shopping": (150000, 1, 0.75, "INR"), "Transport": (7, 1, None, "USD")
    }
    top = reports.top_categories(b, 1).collect()
    assert [r["category"] for r in top] == ["Shopping"]


def test_uncategorised_and_credit_only_months(spark):
    cats = dims.default_categories(spark)
    assert rows_of(reports.category_breakdown(ledger(spark, dict(amount_minor=620)), cats), "category", "amount") == [(None, 620)]
    assert reports.category_breakdown(ledger(spark, dict(type="CREDIT")), cats).count() == 0


def test_daily_spending_has_every_day(spark):
    df = ledger(spark, dict(amount_minor=400), dict(amount_minor=600, txn_ts=SEP.replace(hour=23)))
    days = reports.daily_spending(df).collect()
    assert len(days) == 30
    assert {r["day"].day: r["amount"] for r in days if r["amount"]} == {17: 1000}
    assert reports.busiest_day(reports.daily_spending(df)).first()["day"] == dt.date(2026, 9, 17)


def test_rest_slice_appears_above_the_floor(spark):
    many = [dict(amount_minor=1000 - i, category_id=i + 1) for i in range(7)]
    slices = reports.top_categories_with_rest(reports.category_breakdown(ledger(spark, *many), dims.default_categories(spark)))
    assert [r["slot"] for r in slices.orderBy("slot").collect()] == [1, 2, 3, 4, 5, 6]
    small = [dict(amount_minor=100000, category_id=i + 1) for i in range(5)] + [dict(amount_minor=1, category_id=6)]
    slices = reports.top_categories_with_rest(reports.category_breakdown(ledger(spark, *small), dims.default_categories(spark)))
    assert slices.count() == 5


def test_day_and_month_groups(spark):
    df = ledger(
        spark, dict(amount_minor=100), dict(amount_minor=300, type="CREDIT", category_id=1),
        dict(amount_minor=999, is_promotional=True),
        dict(amount_minor=2500, currency_code="USD", txn_ts=SEP.replace(day=18)),
    )
    days = {str(r["day"]): r for r in reports.day_groups(df).collect()}
    d17, d18 = days["2026-09-17"], days["2026-09-18"]
    assert (d17["credit_total"], d17["debit_total"], d17["net"], d17["flag"]) == (300, 100, 200, "PROFIT")
    assert (d17["transaction_count"], d17["uncategorised_count"]) == (3, 2)
    assert (d18["debit_total"], d18["debit_currency"], d18["net"], d18["net_currency"]) == (2500, "USD", -2500, "USD")
    [m] = reports.month_groups(reports.day_groups(df)).collect()
    assert (m["debit_total"], m["debit_currency"], m["transaction_count"]) == (100, "INR", 4)


def test_day_order_and_recent(spark):
    df = ledger(spark, *[dict(amount_minor=a, txn_ts=SEP.replace(minute=m)) for a, m in ((5, 1), (9, 2), (5, 3))])
    ids = [r["txn_id"] for r in reports.day_entries(df, "AMOUNT_LOW_TO_HIGH").collect()]
    assert ids == [3, 1, 2]
    assert [r["txn_id"] for r in reports.day_entries(df).collect()] == [3, 2, 1]
    assert rows_of(reports.recent_by_month(df, 2), "position", "txn_id") == [(1, 3), (2, 2)]


def test_months_fall_back_to_today(spark):
    today = dt.date(2026, 12, 5)
    empty = ledger(spark, dict(is_ignored=True))
    assert rows_of(reports.months_with_data(empty, today), "month") == [(dt.date(2026, 12, 1),)]
    assert rows_of(reports.months_with_data(ledger(spark, dict()), today), "month") == [(dt.date(2026, 9, 1),)]


# --- filter: every subset of parameters against a plain Python predicate --------


FILTER_PARTS = {
    "search": ("ops%", lambda r: any("ops%" in (r[c] or "").lower() for c in search.SEARCHED)),
    "type": ("DEBIT", lambda r: r["type"] == "DEBIT"),
    "account_tail": ("1", lambda r: r["account_tail"] == "1"),
    "category_ids": (frozenset({1, 2}), lambda r: r["category_id"] in (1, 2)),
    "min_amount_minor": (20, lambda r: r["amount_minor"] >= 20),
    "max_amount_minor": (60, lambda r: r["amount_minor"] <= 60),
    "exclude_promotional": (True, lambda r: not r["is_promotional"]),
    "period": (search.Period.day(dt.date(2026, 9, 17)), lambda r: r["txn_ts"].day == 17),
}


def test_filter_subsets(spark):
    rng = random.Random(3)
    rows = [
        dict(
            amount_minor=rng.randint(1, 90), type=rng.choice(["DEBIT", "CREDIT"]), category_id=rng.choice([None, 1, 2, 3]),
            is_promotional=rng.random() < 0.3, is_ignored=rng.random() < 0.2, account_tail=rng.choice(["1", "2"]),
            merchant_name=rng.choice([None, "SHOPS% ltd", "opsx"]), notes=rng.choice([None, "x Ops% y"]),
            txn_ts=SEP.replace(day=rng.choice([17, 18])),
        )
        for _ in range(80)
    ]
    df = ledger(spark, *rows).cache()
    plain = [r.asDict() for r in df.collect()]
    names = list(FILTER_PARTS)
    subsets = [s for n in (0, 1, 2, len(names)) for s in itertools.combinations(names, n)]
    for subset in subsets:
        spec = search.LedgerFilter(**{n: FILTER_PARTS[n][0] for n in subset})
        want = {
            r["txn_id"] for r in plain
            if not r["is_ignored"] and all(FILTER_PARTS[n][1](r) for n in subset)
        }
        got = {r["txn_id"] for r in search.search(df, spec, ordered=False).select("txn_id").collect()}
        assert got == want, subset
        assert spec.is_active == bool(subset)
    assert search.LedgerFilter(include_ignored=True).is_active is False
    only = search.LedgerFilter(uncategorised_only=True, category_ids=frozenset({1}))
    assert all(r["category_id"] is None for r in search.search(df, only).collect())
    df.unpersist()


def test_amount_bound(spark):
    assert search.amount_bound(spark, " 1,299.5 ") == 129950
    assert search.amount_bound(spark, " ") is None and search.amount_bound(spark, "abc") is None


# --- ordered helpers against plain windows, with one group holding most rows ----


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_spanned_windows_equal_plain_windows(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.randint(0, 5), rng.random() < 0.5) for i in range(-5, 200)]
    df = spark.createDataFrame(rows, "g string, seq long, v long, f boolean")
    w = Window.partitionBy("g").orderBy("seq")
    want = rows_of(df.select("seq", F.sum("v").over(w).alias("t"), F.coalesce(F.lag("f").over(w).cast("string"), F.lit("-")).alias("p")), "seq", "t", "p")
    totals = running_totals(df, ["g"], "seq", {"t": F.col("v")}, span)
    lagged = previous_value(df, ["g"], "seq", "f", "p", span).select("seq", F.coalesce(F.col("p").cast("string"), F.lit("-")).alias("p"))
    assert rows_of(totals.join(lagged, "seq"), "seq", "t", "p") == want


# --- edits, dims, audits ----------------------------------------------------------


def test_edits_last_write_wins_and_clears(spark):
    df = ledger(spark, dict(category_id=1), dict(category_id=2), dict()).withColumn("updated_at", F.col("txn_ts"))
    at = lambda m: SEP.replace(minute=m)
    writes = spark.createDataFrame(
        [(1, "category", "5", False, at(1)), (1, "category", None, True, at(2)), (2, "ignored", "true", False, at(3)),
         (2, "ignored", "false", False, at(1)), (3, "promotional", "true", False, at(1))],
        "txn_id long, field string, value string, is_clear boolean, edited_at timestamp_ntz",
    )
    got = rows_of(edits.apply_edits(df, writes), "txn_id", "is_ignored", "is_promotional", "updated_at")
    assert got == [(1, False, False, at(2)), (2, True, False, at(3)), (3, False, True, at(1))]
    assert [r["category_id"] for r in edits.apply_edits(df, writes).orderBy("txn_id").collect()] == [None, 2, None]


def test_labels(spark):
    labels = dims.default_labels(spark)
    wanted = spark.createDataFrame([(" Gym ", "#123456FF"), ("gym", ""), ("FOOD", "1"), ("  ", "1"), ("Zoo", "#")], "name string, color_hex string")
    made = edits.create_labels(labels, wanted).filter("not is_system_defined")
    assert rows_of(made, "name", "color_hex", "sort_order") == [("Gym", "123456", 1000), ("Zoo", "90A4AE", 1000)]
    assert edits.name_collisions(made.union(made)).count() == 2
    bridge = spark.createDataFrame([(1, 1), (1, 2)], "txn_id long, label_id long")
    kept, linked = edits.delete_custom_labels(labels, bridge, labels.select("id"))
    assert kept.count() == 30 and linked.count() == 2
    ask = spark.createDataFrame(
        [(1, 1, False, SEP), (2, 3, True, SEP), (2, 3, False, SEP.replace(year=2025))],
        "txn_id long, label_id long, attached boolean, requested_at timestamp_ntz",
    )
    assert rows_of(edits.set_labels(bridge, ask), "txn_id", "label_id") == [(1, 2), (2, 3)]
    old = spark.createDataFrame([(1, "Pending", "1", True, 1), (99, "Mine", "1", False, 1000)], dims.LABEL_SCHEMA)
    seeded, cascaded = dims.seed_labels(old, labels, bridge, stored_version=1)
    assert seeded.count() == 31 and cascaded.count() == 0


def test_cascades_and_audits(spark):
    df = ledger(spark, dict(category_id=1), dict(category_id=77), dict(amount_minor=-1))
    for name in ("payment_method", "primary_source", "parse_status"):
        df = df.withColumn(name, F.lit("?"))
    cats = dims.default_categories(spark)
    assert [r["category_id"] for r in edits.clear_deleted_categories(df, cats).orderBy("txn_id").collect()] == [1, None, None]
    assert rows_of(audit.orphans(df, "category_id", cats, "id"), "key", "rows") == [(77, 1)]
    got = dict(rows_of(audit.domain_violations(df), "audit", "rows"))
    assert got["amount_minor"] == 1 and got["payment_method"] == 3 and got["type"] == 0
    pairs = spark.createDataFrame([("SMS", "1"), ("SMS", "1"), ("SMS", None), ("SMS", None)], "source string, id string")
    assert rows_of(audit.duplicate_keys(pairs, "source", "id"), "id", "rows") == [("1", 2)]
    l, s, b = edits.delete_transactions(df, df, df, df.filter("txn_id = 1"))
    assert (l.count(), s.count(), b.count()) == (2, 2, 2)
