"""Ledger-domain tables derived from the driver's parquet tables.

Every table is a plain projection or equi-join over whole inputs; nothing is
collected, cached or sampled. Column pruning keeps each query to the columns it
reads. Small dims are joined without hints: Spark broadcasts by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import shared_dir, spread
from ledgerloom.sources import statements


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(col: Column, factor: int = 100) -> Column:
    return F.round(col * factor).cast("bigint")


def grouped_amount(minor: Column) -> Column:
    """Minor units printed with thousands separators and two decimals."""
    return F.format_number(minor / 100, 2)


def reference_text(key: Column) -> Column:
    return F.lpad(key.cast("string"), 12, "0")


def tail_text(key: Column) -> Column:
    return F.right(F.lpad(key.cast("string"), 4, "0"), F.lit(4))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    amount = cents(F.col("o_totalprice"))
    tail = tail_text(F.col("o_custkey"))
    ref = reference_text(F.col("o_orderkey"))
    described = F.when(
        status == "P",
        F.concat(
            F.lit("Your Axis Bank Credit Card XX"), tail,
            F.lit(" available limit is INR "), grouped_amount(amount),
        ),
    ).when(
        status == "O",
        F.concat(
            F.lit("INR "), grouped_amount(amount), F.lit(" debited A/c no. XX"), tail,
            F.lit(" UPI/P2M/"), ref, F.lit("/"), F.col("c_name"),
        ),
    )
    method = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "CARD")
        .when(F.col("c_mktsegment") == "BUILDING", "UPI")
        .when(F.col("c_mktsegment") == "FURNITURE", "NEFT")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "CASH")
        .otherwise("UNKNOWN")
    )
    has_reference = priority != "1-URGENT"
    return joined.select(
        F.col("o_orderkey").alias("txn_id"),
        amount.alias("amount_minor"),
        F.when(F.col("n_regionkey") == 1, "USD").otherwise("INR").alias("currency_code"),
        F.when(status == "F", "CREDIT").otherwise("DEBIT").alias("type"),
        F.col("o_orderdate").alias("txn_ts"),
        described.alias("description"),
        F.when(priority != "3-MEDIUM", F.col("c_name")).alias("merchant_name"),
        F.when(has_reference, F.concat(F.lit("UPI Ref "), ref)).alias("reference_number"),
        F.when(has_reference, ref).alias("normalized_reference"),
        tail.alias("account_tail"),
        F.col("n_name").alias("bank_name"),
        F.when(priority == "2-HIGH", F.concat(F.lit("check with "), F.col("c_mktsegment"))).alias("notes"),
        F.when(priority != "4-NOT SPECIFIED", F.substring(priority, 1, 1).cast("bigint")).alias("category_id"),
        method.alias("payment_method"),
        F.when(status == "F", "SMS").when(status == "O", "CSV").otherwise("PDF").alias("primary_source"),
        F.when(status == "P", "PARTIALLY_PARSED").otherwise("PARSED").alias("parse_status"),
        ((status == "P") & (priority == "5-LOW")).alias("is_promotional"),
        (F.col("c_acctbal") < 0).alias("is_ignored"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    first_open = (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)
    return line.select(
        F.col("l_orderkey").alias("txn_id"),
        F.when(flag == "A", "SMS").when(flag == "N", "CSV").otherwise("PDF").alias("source"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_identifier"),
        F.when(F.col("l_linestatus") == "O", "AX-AXISBK").alias("origin_label"),
        F.when(
            first_open,
            F.concat(
                F.lit("EMI of Rs "), F.col("l_quantity").cast("bigint"),
                F.lit(" is due for your loan account"),
            ),
        ).alias("raw_payload"),
        F.col("l_shipdate").alias("imported_at"),
    )


def categories(spark: SparkSession) -> DataFrame:
    """The built-in category dim: fourteen fixed rows."""
    from ledgerloom.sources.dims import default_categories

    return default_categories(spark)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per part type, identified by its lowest part key."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_type").alias("name"))
        .agg(F.min("p_partkey").alias("id"))
        .select("id", "name", F.col("id").alias("sort_order"))
    )


def transaction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge (txn_id, label_id): which part types an order touches."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    typed = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    named = typed.select(F.col("l_orderkey").alias("txn_id"), F.col("p_type").alias("name")).distinct()
    return named.join(labels(spark, sf_dir), "name").select("txn_id", F.col("id").alias("label_id"))


def messages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Alert messages rendered from the event table, one per event."""
    ev = spread(table(spark, sf_dir, "events")) if events is None else events
    amount = cents(F.col("value"), 3700)
    kind, user, ts = F.col("event_type"), F.col("user_id"), F.col("ts")
    printed = grouped_amount(amount)
    tail = F.lpad(user.cast("string"), 4, "0")
    ref = reference_text(F.col("event_id") + 100000000)
    day = F.date_format(ts, "dd-MM-yy")
    upi_debit = F.concat(
        F.lit("INR "), printed, F.lit(" debited\nA/c no. XX"), tail, F.lit("\n"), day, F.lit(", "),
        F.date_format(ts, "HH:mm:ss"), F.lit("\nUPI/P2M/"), ref, F.lit("/STORE "), tail,
        F.lit("\nNot you? SMS BLOCKUPI\nAxis Bank"),
    )
    card_spend = F.concat(
        F.lit("Rs."), printed, F.lit(" spent on your ICICI Bank Credit Card XX"), tail,
        F.lit(" at ZOMATO. Avl limit Rs.80,000.00"),
    )
    credit = F.concat(
        F.lit("Your a/c XX"), tail, F.lit(" is credited with INR "), printed, F.lit(" on "), day,
        F.lit(" by UPI Ref No. "), ref,
    )
    offer = F.concat(F.lit("Grab Rs "), printed, F.lit(" off. Coupon SAVE150. Limited period offer."))
    limit = F.concat(
        F.lit("Your Axis Bank Credit Card XX"), tail, F.lit(" available limit is INR "), printed
    )
    code = F.concat(F.lit("Your OTP for login is "), user + 400000, F.lit(". Do not share with anyone."))
    body = (
        F.when((kind == "purchase") & (user < 75), upi_debit)
        .when(kind == "purchase", card_spend)
        .when(kind == "signup", credit)
        .when(kind == "click", offer)
        .when(kind == "view", limit)
        .otherwise(code)
    )
    address = (
        F.when(kind == "purchase", "AX-AXISBK")
        .when(kind == "signup", "VM-HDFCBK")
        .when(kind == "click", "LM-SWIGGY")
        .when(kind == "view", "AX-AXISBK")
        .otherwise("VK-SBIINB")
    )
    return ev.select(
        F.col("event_id").alias("id"), address.alias("address"), body.alias("body"), ts.alias("received_at")
    )


def shop_name(key: Column) -> Column:
    """A merchant name without digits, one per customer key."""
    return F.concat(F.lit("Shop X"), F.translate(key.cast("string"), "0123456789", "ABCDEFGHIJ"))


def _statement_orders(spark: SparkSession, sf_dir: str, prefix: str, suffix: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders"))
    priority = F.substring("o_orderpriority", 1, 1)
    order = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return orders.select(
        F.concat(F.lit(prefix), F.lower("o_orderstatus"), priority, F.lit(suffix)).alias("file_name"),
        (order * 8 + priority.cast("int")).cast("bigint").alias("file_seq"),
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate",
        cents(F.col("o_totalprice")).alias("amount"),
        shop_name(F.col("o_custkey")).alias("shop"),
        reference_text(F.col("o_orderkey") + 100000000).alias("ref"),
    )


def statement_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen statement files; column order, date format and quoting vary by file."""
    rows = _statement_orders(spark, sf_dir, "stmt-", ".csv")
    status = F.col("o_orderstatus")
    ref = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("ref")).otherwise("")
    plain = F.regexp_replace(grouped_amount(F.col("amount")), ",", "")
    grouped = grouped_amount(F.col("amount"))
    line = (
        F.when(
            status == "F",
            F.concat_ws(
                ",", F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.lit("Paid to "), "shop"), ref,
                plain, F.lit("DEBIT"),
            ),
        )
        .when(
            status == "O",
            F.concat(
                F.lit('"Received from '), "shop", F.lit('",'), F.date_format("o_orderdate", "yyyy-MM-dd"),
                F.lit(',"'), grouped, F.lit('",'), ref,
            ),
        )
        .otherwise(
            F.concat(
                F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(","), "shop", F.lit(',"'), grouped,
                F.lit('",0.00,"'), grouped_amount(F.col("amount") + 100000000), F.lit('"'),
            )
        )
    )
    note = F.when(F.col("o_orderpriority") == "5-LOW", "Disclaimer: computer generated")
    return rows.select(
        "file_name", "file_seq",
        F.posexplode(F.array_compact(F.array(line, note))).alias("at", "line"), "o_orderkey",
    ).select("file_name", "file_seq", (F.col("o_orderkey") * 2 + F.col("at") + 1).alias("line_no"), "line")


def statement_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen statement documents as text lines, in four layouts."""
    rows = _statement_orders(spark, sf_dir, "doc-", ".pdf")
    status = F.col("o_orderstatus")
    grouped = grouped_amount(F.col("amount"))
    slashed, spelled = F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "dd MMM, yyyy")
    wrapped = F.array(
        F.concat(slashed, F.lit(" Paid to "), "shop"), F.concat(F.lit("UPI Ref "), "ref"),
        F.concat(grouped, F.lit(" DR")),
    )
    single = F.array(
        F.concat(
            slashed, F.lit(" NEFT "), "shop", F.lit(" "), "ref", F.lit(" "), grouped, F.lit(" 9,000,000.00")
        ),
        F.lit("Page 1"),
    )
    stacked = F.array(
        spelled, F.lit("12:59PM"), F.concat(F.lit("Paidto"), "shop"),
        F.concat(F.lit("UPITransactionID:"), "ref"), F.lit("PaidbyAxisBank2073"),
        F.concat(F.lit("₹"), grouped),
    )
    layout = F.array(
        F.concat(spelled, F.lit("   Received from "), "shop", F.lit("    ₹"), grouped),
        F.concat(F.lit("10:05 AM   UPI Transaction ID: "), "ref"), F.lit("   Paid by Axis Bank 2073"),
    )
    lines = (
        F.when(status == "F", wrapped)
        .when(status == "O", single)
        .when(F.col("o_orderpriority") == "5-LOW", layout)
        .otherwise(stacked)
    )
    return rows.select("file_name", "file_seq", "o_orderkey", F.posexplode(lines).alias("at", "line")).select(
        "file_name", "file_seq", (F.col("o_orderkey") * 8 + F.col("at") + 1).alias("line_no"), "line"
    )


#: Orders whose lines share one written statement; more orders give more statements.
STATEMENT_ORDERS = 32768


def statement_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(files, lines)`` of statements written to the shared folder and read from there.

    All statement lines, cut into statements of at most ``STATEMENT_ORDERS`` orders each, plus one
    file without bytes. Some kinds are spoilt: stmt-f1 has an unknown suffix, stmt-o2 ends every
    line in a byte that is not UTF-8, stmt-p3 and doc-f2 are blank, stmt-f4 and doc-o3 hold no
    dates or amounts, and in stmt-o4 every line is boilerplate.
    """
    csv, text = statement_csv_lines(spark, sf_dir), statement_text_lines(spark, sf_dir)

    def cut(lines: DataFrame, per_order: int) -> DataFrame:
        block = F.floor((F.col("line_no") - 1) / (STATEMENT_ORDERS * per_order)).cast("string")
        return lines.select(
            F.regexp_extract("file_name", r"^(.*)\.", 1).alias("kind"), block.alias("block"), "line_no", "line"
        )

    both = cut(csv, 2).unionByName(cut(text, 8))
    kind = F.col("kind")
    suffix = F.when(kind == "stmt-f1", ".txt").when(kind.startswith("doc-"), ".pdf").otherwise(".csv")
    line = (
        F.when(kind.isin("stmt-p3", "doc-f2"), F.lit("   "))
        .when(kind.isin("stmt-f4", "doc-o3"), F.lit("see,branch"))
        .when(kind == "stmt-o2", F.concat("line", F.unhex(F.lit("FF")).cast("string")))
        .when(kind == "stmt-o4", F.concat(F.lit("Disclaimer: note,"), "line"))
        .otherwise(F.col("line"))
    )
    root = shared_dir(spark, "statement-files")
    named = both.select(F.concat("kind", F.lit("-"), "block", suffix).alias("statement"), "line_no", line.alias("value"))
    ordered = named.repartition("statement").sortWithinPartitions("statement", "line_no")
    ordered.select("statement", "value").write.partitionBy("statement").text(root)
    named.limit(0).select("value").write.text(f"{root}/statement=stmt-empty.csv")
    files = statements.list_files(
        spark, root, name=lambda path: F.regexp_extract(path, "/statement=([^/]+)/", 1)
    )
    return files, statements.read_lines(spark, root, files=files)


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each order of the statement files, with the very number its CSV line gets."""
    rows = _statement_orders(spark, sf_dir, "", "")
    line_number = F.col("file_seq") * (1 << 38) + (F.col("o_orderkey") * 2 + 1) * 64
    received = F.col("o_orderdate") + F.expr("INTERVAL '15:14' HOUR TO MINUTE")
    printed, tail = grouped_amount(F.col("amount")), tail_text(F.col("o_orderkey"))
    spent = F.concat(
        F.lit("INR "), printed, F.lit(" debited\nA/c no. XX"), tail, F.lit("\nUPI/P2M/"), "ref", F.lit("/STORE "), tail,
    )
    earned = F.concat(
        F.lit("Your a/c XX"), tail, F.lit(" is credited with INR "), printed, F.lit(" on "),
        F.date_format(received, "dd-MM-yy"), F.lit(" by UPI Ref No. "), "ref",
    )
    return rows.select(
        line_number.alias("id"), F.lit("AX-AXISBK").alias("address"),
        F.when(F.col("o_orderstatus") == "O", earned).otherwise(spent).alias("body"), received.alias("received_at"),
    )


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parsed`` rows: each order as told by a message, a CSV and a PDF statement, then
    the message again and a second message; wording, masks and times differ."""
    orders, customer = spread(table(spark, sf_dir, "orders")), table(spark, sf_dir, "customer")
    joined = orders.join(customer.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    name, printed = shop_name(F.col("o_custkey")), F.col("o_orderkey").cast("string")
    ref = F.when(F.col("o_orderpriority") != "1-URGENT", reference_text(F.col("o_orderkey") + 100000000))
    # What several copies tell is made once for an order.
    base = joined.select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate",
        cents(F.col("o_totalprice")).alias("amount"), name.alias("name"), F.concat(F.lower(name), F.lit("@icici")).alias("handle"),
        tail_text(F.col("o_custkey")).alias("tail"), ref.alias("ref"), F.concat(F.lit("UPI Ref: "), ref).alias("message_ref"),
        (F.col("o_orderdate") + F.expr("INTERVAL '15:14' HOUR TO MINUTE")).alias("timed"),
        F.when(F.col("o_orderstatus") == "F", "CREDIT").otherwise("DEBIT").alias("type"), printed.alias("printed"),
        F.concat(F.lit("sms:"), printed).alias("sms"), F.concat(F.lit("raw "), printed).alias("raw"),
    )
    status, priority, key = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")
    name, handle, tail, ref, message_ref = map(F.col, ("name", "handle", "tail", "ref", "message_ref"))
    midnight, timed, amount, sms = F.col("o_orderdate"), F.col("timed"), F.col("amount"), F.col("sms")
    masked = F.concat(F.lit("XX"), tail)
    nothing = F.lit(None).cast("string")

    def copy(k, source, identifier, merchant, reference, account, ts, method, bank, parse, promo, minor=amount):
        return F.struct(
            (key * 8 + k).alias("seq"), minor.alias("amount_minor"), F.lit("INR").alias("currency_code"),
            F.col("type"), ts.alias("txn_ts"),
            F.concat(F.lit(source + " "), F.col("printed")).alias("description"), merchant.alias("merchant_name"),
            reference.alias("reference_number"), account.alias("account_identifier"),
            bank.alias("bank_name"), F.lit(method).alias("payment_method"), F.lit(source).alias("source"),
            identifier.alias("source_identifier"),
            F.concat(F.lit(source.lower() + "-"), F.lower(status)).alias("origin_label"),
            parse.alias("parse_status"), F.col("raw").alias("raw_payload"),
            promo.alias("is_promotional"),
        )

    ok, partial = F.lit("PARSED"), F.when(status == "P", "PARTIALLY_PARSED").otherwise("PARSED")
    rejected = (status == "F") & (priority == "5-LOW")
    failed_pdf = (status == "O") & (priority == "3-MEDIUM")
    told = F.array(
        copy(0, "SMS", sms, handle, message_ref, masked, timed, "UPI", nothing, partial,
             (status == "P") & (priority == "5-LOW")),
        copy(1, "CSV", F.concat(F.lit("csv:"), "printed"), F.upper(name), ref, F.concat(F.lit("XXXXXXXX"), tail),
             midnight, "UNKNOWN", F.lit("HDFC"), F.when(rejected, "FAILED").otherwise(ok), F.lit(False),
             F.when(rejected, F.lit(0)).otherwise(amount)),
        copy(2, "PDF", F.when(priority != "2-HIGH", F.concat(F.lit("pdf:"), "printed")),
             F.concat(F.lit("UPI/"), name, F.lit("/"), F.coalesce(ref, F.lit("payment"))),
             F.concat(F.lit("Ref No "), ref), tail, midnight, "UNKNOWN", nothing,
             F.when(failed_pdf, "FAILED").otherwise(ok), F.lit(False)),
        copy(3, "SMS", sms, handle, message_ref, masked, timed, "UPI", nothing, ok, status == "P"),
        copy(4, "SMS", F.concat(sms, F.lit("b")), handle, message_ref, masked, timed, "UPI", nothing, ok, F.lit(False)),
    )
    return base.select(F.inline(told))
