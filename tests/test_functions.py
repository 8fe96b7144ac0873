import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text


def test_reference(one_value):
    got = one_value(
        text.reference,
        [
            "UPI Ref: 123456789012", "1234-5678-9012", "UPI/123456789012/SWIGGY",
            "UTR: IMPS784512369874", "Ref 12", "UPI", "N/A", "", None,
            "Transaction ID 123456789012", "1234 5678 9012", "ABC 12345 DEFGH9876",
        ],
    )
    assert got == [
        "123456789012", "123456789012", "123456789012", "IMPS784512369874",
        None, None, None, None, None, "123456789012", "123456789012", "DEFGH9876",
    ]


def test_merchant_key_and_name(one_value):
    names = [
        "UPI/SWIGGY/123456789012", "swiggy@icici", "POS BIG BASKET", "123456789012",
        "UPI/Swiggy Instamart/Payment", None, "  ",
    ]
    assert one_value(text.merchant_key, names) == [
        "SWIGGY", "SWIGGY", "BIGBASKET", None, "SWIGGYINSTAMART", None, None,
    ]
    assert one_value(text.merchant_name, ["BIG BAZAAR", "123456789012", "SWIGGY LIMITED", " "]) == [
        "BIG Bazaar", "123456789012", "Swiggy", None,
    ]


def test_removed_words_leave_single_blanks(one_value):
    names = [" upi SHOP to  to X", "to", "SHOP TO", "A upi B ref C", "X 12 Y AB345678 Z", "", " ", "UPI", "upi-upi-Shop-upi", None]
    assert one_value(text.merchant_words, names) == ["SHOP X", "", "SHOP", "A B C", "X Y Z", "", "", "", "SHOP", None]


def test_account(one_value):
    assert one_value(text.account_tail, ["A/c XXXXXX1234", "50100123451234", "XX1", "savings", None]) == [
        "1234", "1234", None, None, None,
    ]
    assert one_value(text.account_masked, ["1234", "", None]) == ["••••1234", None, None]


def test_money(one_value):
    got = one_value(
        money.minor_units,
        ["1,299.00", "₹540", "540.50 Dr", "INR 540.", "540.575", "Rs.540", "none", "1-2", "-12.5", "540.565"],
    )
    assert got == [129900, 54000, 54050, 54000, 54058, 54000, None, None, -1250, 54056]
    assert one_value(lambda c: money.minor_units(c, "JPY"), ["500"]) == [500]
    assert one_value(lambda c: money.minor_units(c, "KWD"), ["1.2345"]) == [1234]


def test_net(spark):
    rows = [(100, "INR", 30, "INR"), (0, "INR", 2500, "USD"), (10, "USD", 0, "INR"), (5, "INR", 7, "USD")]
    df = spark.createDataFrame(rows, "c long, cc string, d long, dc string")
    cols = [F.col(x) for x in ("c", "cc", "d", "dc")]
    got = df.select(money.net_amount(*cols), money.net_currency(*cols)).collect()
    assert [tuple(r) for r in got] == [(70, "INR"), (-2500, "USD"), (10, "USD"), (5, "INR")]


def test_dates(one_value):
    raw = [
        "17/09/2026", "17-9-2026", "17/09/26", "2026-09-17", "17 Sep 2026", "02 Aug, 2026",
        "17-Sep-2026", "17 September 2026", "Sept 17, 2026", "July 4, 2026", "17092026",
        "31/02/2026", "32/01/2026", "12/13/2026", "12345678", "hello", "", None, "17 AUG 2026",
    ]
    day = dt.date(2026, 9, 17)
    assert one_value(dates.parse_date, raw) == [
        day, day, day, day, day, dt.date(2026, 8, 2), day, day, day, dt.date(2026, 7, 4), day,
        dt.date(2026, 2, 28), None, None, None, None, None, None, None,
    ]


def test_times(one_value):
    raw = ["09:51 pm", "12:59PM", "12:05 am", "9.30 AM", "20:41:05", "7:5", "25:00", "13:00 PM", "x"]
    assert one_value(dates.parse_time, raw) == [
        78660, 46740, 300, 34200, 74465, 25500, None, None, None,
    ]


def test_datetimes(one_value):
    raw = [
        "22-09-26, 20:41:05", "17/09/2026 15:14", "2026-09-17T10:11:12", "17 Sep 2026 08:30",
        "Sept 17, 2026 09:51 pm", "22-09-2026, 20:41:05", "22-09-2026 08:30 PM", "22-09-2026 08:30 IST",
        "17/09/2026", "junk",
    ]
    d = dt.datetime
    assert one_value(dates.parse_datetime, raw) == [
        d(2026, 9, 22, 20, 41, 5), d(2026, 9, 17, 15, 14), d(2026, 9, 17, 10, 11, 12),
        d(2026, 9, 17, 8, 30), d(2026, 9, 17, 21, 51), d(2026, 9, 22, 20, 41, 5),
        d(2026, 9, 22, 20, 30), d(2026, 9, 22, 8, 30), d(2026, 9, 17), None,
    ]


def test_date_and_time_columns(spark):
    df = spark.createDataFrame([("Sept 17, 2026", "09:51 pm")], "a string, b string")
    got = df.select(dates.parse_date_and_time(F.col("a"), F.col("b"))).first()[0]
    assert got == dt.datetime(2026, 9, 17, 21, 51)


def test_wall_clock_ignores_session_zone(spark):
    df = spark.sql("select timestamp_micros(1789638240000000) ts")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = df.select(dates.wall_clock(F.col("ts"), "Asia/Kolkata")).first()[0]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == dt.datetime(2026, 9, 17, 15, 14)
