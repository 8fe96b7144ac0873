import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.operators import alerts, model
from ledgerloom.schemas import MESSAGES_SCHEMA
from ledgerloom.session import stage_table

AT = dt.datetime(2026, 9, 30, 8, 0)

# body, address, expected subset (None = no row)
CASES = [
    ("Canara Bank: Rs.84.50 debited from a/c XX5521 on 03-03-27 to VPA bakery@ybl UPI Ref 161803398874. Call us if unknown",
     "CANBNK", dict(amount_minor=8450, type="DEBIT", reference_number="161803398874", payment_method="UPI",
                    parse_status="PARSED", is_promotional=False, merchant_name="bakery@ybl")),
    ("INR 2,310.00 credited to your a/c XX5521 on 04-03-2027, UPI Ref No. 271828182845", "CANBNK",
     dict(amount_minor=231000, type="CREDIT", reference_number="271828182845", is_promotional=False)),
    ("INR 64.75 debited\nA/c no. XX4410\n05-03-27, 19:22:08\nUPI/P2M/577215664901/MIRA STATIONERS\nYour bank",
     "BZ-CANBNK", dict(amount_minor=6475, account_identifier="XX4410", merchant_name="MIRA STATIONERS",
                       txn_ts=dt.datetime(2027, 3, 5, 19, 22, 8), reference_number="577215664901")),
    ("Canara Bank Credit Card XX4410: available limit is INR 73,250.00", "BZ-CANBNK",
     dict(amount_minor=7325000, is_promotional=True, txn_ts=AT)),
    ("Rs.96.00 charged: thank you for using your Canara Bank Credit Card ending 4410 at BOOKBARN on 06-03-27. Available limit: Rs 73,154.00",
     "CANBNK", dict(amount_minor=9600, type="DEBIT", is_promotional=False)),
    ("USD 14.00 spent on your Canara Bank Credit Card XX4410 at LUMENHOST. Remaining limit for the card is 71,900 INR",
     "BZ-CANBNK", dict(amount_minor=1400, currency_code="USD", type="DEBIT", is_promotional=False)),
    ("Canara Bank Credit Card XX4410 Total Due: Rs 3,450.00. Min Due: Rs 175.00. Due Date 18-03-27", "CANBNK",
     dict(is_promotional=True)),
    ("The credit limit of your Canara Bank Credit Card has been increased to Rs 90,000", "CANBNK", dict(is_promotional=True)),
    ("Canara Bank: Rs.57.00 debited from a/c XX5521 on 07-03-27 to VPA ferry@upi UPI Ref 141421356237. Avl bal Rs 8,400.00.",
     "CANBNK", dict(amount_minor=5700, type="DEBIT", is_promotional=False)),
    ("Rs.612.00 spent on your Canara Bank Credit Card XX4410 at ORCHID. Avl limit Rs.70,000.00", "CANBNK",
     dict(amount_minor=61200, type="DEBIT", is_promotional=False)),
    ("Mira Stationers: Rs. 150 credited in your wallet till Sunday. Shop now to use the reward.",
     "LM-MIRAST", dict(amount_minor=15000, type="CREDIT", is_promotional=True)),
    ("719034 is your OTP for sign in. Do not share it.", "CANBNK", None),
    ("The unused limit of card XX4410 is Rs 70,000", "JD-CANBNK", dict(is_promotional=True)),
    ("Loan account: EMI of Rs 2,750 is due on 20-03-27", "VM-CANBNK", dict(is_promotional=True)),
    ("Water bill of Rs 415 is generated. Due date 22 Mar.", "AD-WATERS", dict(is_promotional=True)),
    ("A pre-approved loan of Rs 60,000 is waiting. Click to apply.", "AX-CANBNK", dict(is_promotional=True)),
    ("INR 31.00 debited A/c no. XX5521 UPI/P2M/173205080756/ORCHID Canara Bank", "BZ-CANBNK",
     dict(amount_minor=3100, is_promotional=False)),
    ("Debited INR 77.00 on 09Mar27 to ORCHID. UPI:223606797749. A/c X5521", "VK-CANBNK",
     dict(reference_number="223606797749", amount_minor=7700)),
]


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(i, a, b, AT) for i, (b, a, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, MESSAGES_SCHEMA)
    return {r["seq"]: r.asDict() for r in alerts.extract(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_alert_shapes(extracted, i):
    expected = CASES[i][2]
    if expected is None:
        assert i not in extracted
        return
    row = extracted[i]
    assert {k: row[k] for k in expected} == expected
    assert row["source_identifier"] == f"sms:{i}"


def test_amount_hits_report_positions(spark):
    body = "Rs.10 paid, 20 INR and $3 then debited 40"
    hits = spark.range(1).select(alerts.amount_hits(F.lit(body)).alias("h")).first()["h"]
    found = [(body[h["start"]:h["end"]], h["minor"], h["currency"]) for h in hits]
    assert ("Rs.10", 1000, "INR") in found and ("$3", 300, "USD") in found
    assert ("20 INR", 2000, "INR") in found and ("debited 40", 4000, "INR") in found
    assert [h["start"] for h in hits] == sorted(h["start"] for h in hits)


def test_classifier_verdicts(spark):
    rows = [
        (1, "AX-AXISBK", "The remaining credit limit for the card is 71,900 INR"),
        (2, "LM-AMAZON", "Rs 90 cashback on books. Offer valid till Sunday. Hurry up!"),
        (3, "AX-AXISBK", "INR 30.00 debited A/c no. XX4410 UPI/P2M/577215664901/MIRA STATIONERS Not you? Tell us"),
        (4, "JD-ICICIB", "Rs.612.00 spent on your Canara Bank Credit Card XX4410 at ORCHID. Avl limit Rs.70,000.00"),
    ]
    df = spark.createDataFrame(rows, "id long, address string, body string")
    got = {r["id"]: r["not_a_payment"] for r in model.score(df).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    assert len(model.FEATURE_NAMES) == 38


def test_training_separates_classes(spark):
    real = [(f"INR {i}.00 debited A/c no. XX4410 UPI/P2M/57721566{i:04d}/STORE", "AX-AXISBK", 0) for i in range(40)]
    fake = [(f"Grab Rs {i} off. Coupon SAVE{i}. Limited period offer.", "LM-X", 1) for i in range(40)]
    df = spark.createDataFrame(real + fake, "body string, address string, label int")
    table = model.augment(df)
    assert table.count() == 160
    fit, held = model.split_holdout(table)
    assert 0 < held.count() < 80
    learned = model.train(fit)
    report = {r["class"]: r for r in model.evaluate(table, learned).collect()}
    assert report["accuracy"]["recall"] == 1.0 and report["1"]["support"] == 80


def test_training_reads_the_texts_once(spark):
    rows = [(f"INR {i}.00 debited A/c no. XX4410 UPI/P2M/57721566{i:04d}/STORE", "AX-AXISBK", 0) for i in range(40)]
    rows += [(f"Grab Rs {i} off. Coupon SAVE{i}. Limited period offer.", "LM-X", 1) for i in range(40)]
    rows += [("Your OTP is 1", None, 1), ("Your OTP is 1", None, 0)] * 3
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "body string, address string, label int")
    seen = df.mapInArrow(counted, df.schema)
    table = stage_table(model.profiles(seen.withColumn("held", model.is_held_out())), "profiles")
    fit, held = model.split_holdout(table)
    learned = model.train(fit)
    reports = [{r["class"]: tuple(r) for r in model.evaluate(t, learned).collect()} for t in (held, table)]
    assert read.value == len(rows)
    # Counted rows give what the rows themselves give.
    fit, held = model.split_holdout(df)
    plain = model.train(fit)
    assert reports == [{r["class"]: tuple(r) for r in model.evaluate(t, plain).collect()} for t in (held, df)]
    # The weights of the same fit on single vectors.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    single = VectorAssembler(inputCols=model.FEATURE_NAMES, outputCol="features").transform(model.with_features(fit))
    fitted = LogisticRegression(
        maxIter=400, regParam=1.0 / (1.5 * fit.count()), standardization=False, tol=1e-8
    ).fit(single.select("features", F.col("label").cast("double").alias("label")))
    for name, weight in zip(model.FEATURE_NAMES, fitted.coefficients, strict=True):
        assert abs(learned.weights[name] - weight) < 1e-3
    assert abs(learned.bias - fitted.intercept) < 1e-3


def test_needed_texts_hide_no_match(spark):
    texts = [
        "upi  ref 1", "UTR", "rrn", "reference no", "txnn id", "a/c no. x*12", "acct **34", "account xxx77", "avl credit lim",
        "avail limit", "unused credit limit", "avbl balance", "min due", "due date", "reward point", "promotional", "voucher", "coupon",
        "promo", "offer", "pre-approved", "preapproved", "₹ 5", " ₹ ", "inr", "rs.", "usd 1 ₹2", "rs1inr2", "upi/a1/2", "until", "till",
        "valid", "expires", "limit  has been", "limit revised", "dollars", "usd", "unlock", "win", "grab", "hurry", "will be credited",
        "credit card", "not you", "payment of", "using your", "received from", "hdfc", "", "İNR", None,
    ] + [name.replace("_", " ") for name in model.FEATURE_NAMES]
    rows = spark.createDataFrame([(t, a) for t in texts for a in ("AX-X", None)], "body string, address string")
    plain = {n: F.lower("body").rlike(p).alias(n) for n, p, _ in V.CLASSIFIER_FEATURES}
    plain["two_amounts"] = (F.regexp_count(F.lower("body"), F.lit(dict((n, p) for n, p, _ in V.CLASSIFIER_FEATURES)["two_amounts"])) >= 2).alias("two_amounts")
    found = model.feature_flags(F.col("body"), F.col("address"))
    names = [n for n in model.FEATURE_NAMES if n != "sender_bank"]
    assert rows.select(*[plain[n] for n in names]).collect() == rows.select(*[found[n].alias(n) for n in names]).collect()
    hit = rows.agg(*[F.bool_or(found[n]).alias(n) for n in names]).first().asDict()
    assert all(hit.values()), hit


def test_rescore(spark):
    ledger = spark.createDataFrame(
        [
            (1, "m", "The unused limit of card XX4410 is Rs 70,000"),
            (2, "m", "INR 30.00 debited A/c no. XX4410 UPI/P2M/577215664901/MIRA STATIONERS"),
            (3, None, None),
            (4, "m", "INR 30.00 debited A/c no. XX4410 UPI/P2M/577215664901/MIRA STATIONERS"),
        ],
        "txn_id long, merchant_name string, description string",
    ).withColumns({"bank_name": F.lit(None).cast("string"), "notes": F.lit(None).cast("string")})
    sources = spark.createDataFrame(
        [(4, "SMS", "sms:4", "AX-AXISBK", "The unused limit of card XX4410 is Rs 70,000", AT),
         (1, "SMS", "sms:1", None, " ", AT), (3, "SMS", "sms:3", None, None, AT)],
        "txn_id long, source string, source_identifier string, origin_label string, raw_payload string, imported_at timestamp_ntz",
    )
    out = model.rescore(ledger, sources)
    assert {r["txn_id"]: r["hide"] for r in out.collect()} == {1: True, 2: False, 3: False, 4: True}
    assert tuple(model.rescore_summary(out).first()) == (4, 2)


def test_amounts_of_a_long_message_lie_where_they_are_printed(spark):
    parts = [(f"₹ gap {'x' * (i % 7)} Rs.", f"{i}.50") for i in range(1, 1500)]
    body = "".join(gap + printed for gap, printed in parts)
    row = spark.createDataFrame([(body,), ("none here",), ("",)], "body string")
    found = row.select(alerts.amount_hits(F.col("body")).alias("hits")).collect()
    assert [r["hits"] for r in found[1:]] == [[], []]
    hits, at = {(h["end"], h["minor"]) for h in found[0]["hits"]}, 0
    for i, (gap, printed) in enumerate(parts, 1):
        at += len(gap) + len(printed)
        assert (at, i * 100 + 50) in hits
