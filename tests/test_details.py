import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import details

AT = dt.datetime(2026, 1, 1)
LEDGER = "txn_id long, amount_minor long, type string, parse_status string, category_id long"
SOURCES = "txn_id long, source string, source_identifier string, origin_label string, imported_at timestamp_ntz"


def detail(spark, ledger, sources, bridge, size):
    return details.full_detail(
        spark.createDataFrame(ledger, LEDGER),
        spark.createDataFrame([(1, "Food")], "id long, name string"),
        sources if not isinstance(sources, list) else spark.createDataFrame(sources, SOURCES),
        spark.createDataFrame(bridge, "txn_id long, label_id long"),
        spark.createDataFrame([(7, "home", 2), (8, "trip", 1)], "id long, name string, sort_order long"),
        size,
    )


def test_full_detail(spark):
    ledger = [(1, 500, "DEBIT", "PARSED", 1), (2, 600, "CREDIT", "FAILED", 99), (3, 700, "DEBIT", "PARSED", None)]
    sources = [
        (1, "SMS", "s2", None, AT + dt.timedelta(1)), (1, "CSV", "c1", "a.csv", AT), (1, "SMS", None, None, None),
        (1, "PDF", "p1", "b.pdf", AT), (9, "SMS", "gone", None, AT), (None, "SMS", "lost", None, AT),
    ]
    rows = detail(spark, ledger, sources, [(1, 7), (1, 8), (3, 7), (3, 5), (9, 7)], 3).orderBy("txn_id", "chunk").collect()
    assert [(r["txn_id"], r["chunk"], r["amount_minor"], r["parse_status"], r["category"]) for r in rows] == [
        (1, 0, 500, "PARSED", "Food"), (1, 1, 500, "PARSED", "Food"), (2, 0, 600, "FAILED", None), (3, 0, 700, "PARSED", None),
    ]
    assert [[s["source_identifier"] for s in r["sources"]] for r in rows] == [[None, "c1", "p1"], ["s2"], [], []]
    assert [[t["name"] for t in r["labels"]] for r in rows] == [["trip", "home"], [], [], ["home"]]


def test_a_payment_with_very_many_sources(spark):
    n = 100_000
    sources = spark.range(n + 50).select(
        F.when(F.col("id") < n, 1).otherwise(2).cast("long").alias("txn_id"), F.lit("SMS").alias("source"),
        F.lpad(F.col("id").cast("string"), 7, "0").alias("source_identifier"), F.lit("x").alias("origin_label"),
        F.lit(AT).cast("timestamp_ntz").alias("imported_at"),
    )
    got = detail(spark, [(1, 5, "DEBIT", "PARSED", 1), (2, 6, "DEBIT", "PARSED", 1)], sources, [], 1000)
    rows = got.select("txn_id", "chunk", F.size("sources").alias("n"), F.col("sources")[0]["source_identifier"].alias("first"))
    assert sorted(map(tuple, rows.collect())) == [(1, i, 1000, f"{i * 1000:07d}") for i in range(100)] + [(2, 0, 50, "0100000")]


def test_full_detail_of_nothing(spark):
    assert detail(spark, [], [], [], 3).count() == 0
