"""Normalisation, extraction and classification over rendered text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions import dates, money, text
from ledgerloom.operators import alerts, cells, model, statement_files, statement_rows, statement_text
from ledgerloom.plans.oracle_tables import MESSAGES, with_tables
from ledgerloom.plans.registry import query
from ledgerloom.session import spread
from ledgerloom.sources import driver_tables as D
from ledgerloom.sources import messages as inbox


@query(
    "norm_reference",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'IMPS' || lpad(CAST(o_orderkey + 100000000 AS VARCHAR), 12, '0')
         WHEN o_orderpriority <> '5-LOW' THEN lpad(CAST(o_orderkey + 100000000 AS VARCHAR), 12, '0') END AS reference FROM orders""",
)
def norm_reference(spark, sf_dir):
    ref, priority = D.reference_text(F.col("o_orderkey") + 100000000), F.col("o_orderpriority")
    printed = (
        F.when(priority == "1-URGENT", F.concat(F.lit("UPI Ref: "), ref))
        .when(
            priority == "2-HIGH",
            F.concat_ws("-", F.substring(ref, 1, 4), F.substring(ref, 5, 4), F.substring(ref, 9, 4)),
        )
        .when(priority == "3-MEDIUM", F.concat(F.lit("UPI/"), ref, F.lit("/SWIGGY")))
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit("UTR: IMPS"), ref))
        .otherwise("Ref 12")
    )
    orders = spread(D.table(spark, sf_dir, "orders"))
    return orders.select("o_orderkey", text.reference(printed).alias("reference"))


_LETTERS = "translate(CAST({0} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"


@query(
    "norm_merchant",
    f"""SELECT c_custkey, 'SHOPX' || {_LETTERS.format('c_custkey')} AS merchant_key,
        'Shop ' || CASE WHEN length(l) <= 2 THEN 'X' || l ELSE 'X' || lower(l) END AS merchant_name
        FROM (SELECT c_custkey, {_LETTERS.format('c_custkey')} AS l FROM customer)""",
)
def norm_merchant(spark, sf_dir):
    customer = D.table(spark, sf_dir, "customer")
    shop, segment = D.shop_name(F.col("c_custkey")), F.col("c_mktsegment")
    printed = (
        F.when(segment == "AUTOMOBILE", F.concat(F.lit("UPI/"), shop, F.lit("/Payment")))
        .when(segment == "BUILDING", F.concat(F.lower(shop), F.lit("@icici")))
        .when(segment == "FURNITURE", F.concat(F.lit("POS "), F.upper(shop), F.lit(" 123456789012")))
        .when(segment == "HOUSEHOLD", F.concat(shop, F.lit(" PVT LTD, India")))
        .otherwise(shop)
    )
    return customer.select(
        "c_custkey", text.merchant_key(printed).alias("merchant_key"),
        text.merchant_name(printed).alias("merchant_name"),
    )


@query(
    "norm_account",
    """SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN right(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 4) END AS account_tail,
       CASE WHEN c_mktsegment <> 'MACHINERY' THEN '••••' || right(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 4) END AS masked FROM customer""",
)
def norm_account(spark, sf_dir):
    customer = D.table(spark, sf_dir, "customer")
    digits, segment = F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.col("c_mktsegment")
    printed = (
        F.when(segment == "AUTOMOBILE", F.concat(F.lit("A/c XXXXXX"), F.right(digits, F.lit(4))))
        .when(segment == "BUILDING", digits)
        .when(segment == "MACHINERY", "savings")
        .otherwise(F.concat(F.lit("****-"), digits))
    )
    tail = text.account_tail(printed)
    return customer.select("c_custkey", tail.alias("account_tail"), text.account_masked(tail).alias("masked"))


@query(
    "norm_amount",
    """SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
       CAST(round(o_totalprice) AS BIGINT) AS whole FROM orders""",
)
def norm_amount(spark, sf_dir):
    orders = spread(D.table(spark, sf_dir, "orders"))
    minor, priority = D.cents(F.col("o_totalprice")), F.col("o_orderpriority")
    grouped = D.grouped_amount(minor)
    printed = (
        F.when(priority == "1-URGENT", F.concat(F.lit("Rs."), grouped))
        .when(priority == "2-HIGH", F.concat(F.lit("₹ "), grouped))
        .when(priority == "3-MEDIUM", F.concat(grouped, F.lit(" Dr")))
        .otherwise(F.concat(F.lit("INR "), F.regexp_replace(grouped, ",", "")))
    )
    whole = F.round("o_totalprice").cast("bigint")
    return orders.select(
        "o_orderkey", money.minor_units(printed).alias("amount_minor"),
        money.minor_units(F.concat(F.lit("JPY "), F.format_number(whole, 0)), "JPY").alias("whole"),
    )


@query(
    "norm_date",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(date_trunc('second', ts) AS VARCHAR) AS stamp,
       hour(ts) * 3600 + minute(ts) * 60 AS clock FROM events""",
)
def norm_date(spark, sf_dir):
    events, kind, ts = spread(D.table(spark, sf_dir, "events")), F.col("event_type"), F.col("ts")
    day = (
        F.when(kind == "click", F.date_format(ts, "d/M/yyyy"))
        .when(kind == "view", F.date_format(ts, "dd-MM-yy"))
        .when(kind == "error", F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == "signup", F.date_format(ts, "MMMM d, yyyy"))
        .otherwise(F.date_format(ts, "dd MMM, yyyy"))
    )
    stamp = F.when(kind == "click", F.date_format(ts, "dd-MM-yy, HH:mm:ss")).when(
        kind == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(ts, "d/M/yyyy H:m:s"))
    clock = F.when(kind == "click", F.lower(F.date_format(ts, "hh:mma"))).otherwise(F.date_format(ts, "H:m"))
    return events.select(
        "event_id", dates.parse_date(day).alias("day"), dates.parse_datetime(stamp).alias("stamp"),
        dates.parse_time(clock).cast("bigint").alias("clock"),
    )


# --- messages -----------------------------------------------------------------

_ALERTS = """
alerts AS (
  SELECT id, address, body, cents AS amount_minor, 'INR' AS currency_code,
    CASE WHEN event_type = 'signup' THEN 'CREDIT' ELSE 'DEBIT' END AS type,
    CASE WHEN event_type = 'purchase' AND user_id < 75 THEN date_trunc('second', received_at) ELSE received_at END AS txn_ts,
    CASE WHEN event_type = 'purchase' AND user_id < 75 THEN 'STORE ' || tail WHEN event_type = 'purchase' THEN 'ZOMATO'
         WHEN event_type IN ('click', 'view') THEN address END AS merchant_name,
    CASE WHEN (event_type = 'purchase' AND user_id < 75) OR event_type = 'signup' THEN ref END AS reference_number,
    CASE WHEN (event_type = 'purchase' AND user_id < 75) OR event_type = 'signup' THEN 'XX' || tail END AS account_identifier,
    CASE WHEN (event_type = 'purchase' AND user_id < 75) OR event_type = 'signup' THEN 'UPI'
         WHEN event_type IN ('purchase', 'view') THEN 'CARD' ELSE 'UNKNOWN' END AS payment_method,
    event_type IN ('click', 'view') AS is_promotional, 'PARSED' AS parse_status,
    CASE WHEN event_type = 'view' THEN NULL ELSE cents END AS moved_minor
  FROM messages WHERE event_type <> 'error'
)"""


@query(
    "alerts_extract",
    with_tables(MESSAGES, _ALERTS)
    + """SELECT id AS seq, amount_minor, currency_code, type, CAST(txn_ts AS VARCHAR) AS txn_ts, merchant_name, reference_number,
         account_identifier, payment_method, parse_status, is_promotional, 'sms:' || CAST(id AS VARCHAR) AS source_identifier,
         address AS origin_label, left(body, 240) AS description FROM alerts""",
)
def alerts_extract(spark, sf_dir):
    return alerts.extract(D.messages(spark, sf_dir)).select(
        "seq", "amount_minor", "currency_code", "type", "txn_ts", "merchant_name", "reference_number",
        "account_identifier", "payment_method", "parse_status", "is_promotional", "source_identifier",
        "origin_label", "description",
    )


@query(
    "alert_amounts",
    with_tables(MESSAGES, _ALERTS)
    + """SELECT id, moved_minor, CASE WHEN moved_minor IS NOT NULL THEN 'INR' END AS currency,
         CAST(CASE WHEN payment_method = 'CARD' AND NOT is_promotional THEN 2 ELSE 1 END AS BIGINT) AS printed FROM alerts""",
)
def alert_amounts(spark, sf_dir):
    found = alerts.candidates(D.messages(spark, sf_dir)).withColumn("hits", alerts.amount_hits(F.col("body")))
    moved = found.withColumn("moved", alerts.moved_amount(F.col("body"), F.col("hits")))
    places = F.size(F.array_distinct(F.transform("hits", lambda h: h["start"]))).cast("bigint")
    return moved.select(
        "id", F.col("moved.minor").alias("moved_minor"), F.col("moved.currency").alias("currency"),
        places.alias("printed"),
    )


@query(
    "alert_flags",
    with_tables(MESSAGES, _ALERTS)
    + "SELECT address, type, is_promotional, parse_status, COUNT(*) AS messages FROM alerts GROUP BY ALL",
)
def alert_flags(spark, sf_dir):
    rows = alerts.extract(D.messages(spark, sf_dir))
    keys = [F.col("origin_label").alias("address"), "type", "is_promotional", "parse_status"]
    return rows.groupBy(*keys).agg(F.count("*").alias("messages"))


@query(
    "source_counts",
    with_tables(MESSAGES)
    + "SELECT address AS mailbox, COUNT(*) AS rows_read, COUNT(CASE WHEN event_type <> 'error' THEN 1 END) AS with_body FROM messages GROUP BY address",
)
def source_counts(spark, sf_dir):
    rendered = D.messages(spark, sf_dir)
    blanked = F.when(F.col("address") == "VK-SBIINB", F.lit("  \n")).otherwise(F.col("body"))
    return inbox.count_messages(rendered.withColumn("body", blanked), F.col("address"))


@query(
    "messages_after",
    with_tables(MESSAGES)
    + """SELECT id, address, CAST(received_at AS VARCHAR) AS received_at FROM messages
         WHERE received_at > TIMESTAMP '2024-01-15 12:00:00' OR (received_at = TIMESTAMP '2024-01-15 12:00:00' AND id > 10)""",
)
def messages_after(spark, sf_dir):
    import datetime as dt

    after = inbox.read_after(D.messages(spark, sf_dir), inbox.Cursor(dt.datetime(2024, 1, 15, 12), 10))
    return after.select("id", "address", "received_at")


@query(
    "newest_message",
    with_tables(MESSAGES)
    + "SELECT id, CAST(received_at AS VARCHAR) AS received_at FROM messages ORDER BY received_at DESC, id DESC LIMIT 1",
)
def newest_message(spark, sf_dir):
    return inbox.newest(D.messages(spark, sf_dir))


def _flag_sql(name: str, pattern: str) -> str:
    literal = "'" + pattern.replace("'", "''") + "'"
    if name == "two_amounts":
        return f"len(regexp_extract_all(lower(body), {literal})) >= 2"
    if name == "sender_bank":
        return f"(regexp_matches(lower(address), {literal}) OR regexp_matches(lower(body), {literal}))"
    return f"regexp_matches(lower(body), {literal})"


_FLAGS = {name: _flag_sql(name, pattern) for name, pattern, _ in V.CLASSIFIER_FEATURES}
_LOGIT = f"{V.NOT_A_PAYMENT_BIAS} + " + " + ".join(
    f"CASE WHEN {_FLAGS[name]} THEN {weight} ELSE 0 END" for name, _, weight in V.CLASSIFIER_FEATURES
)


@query(
    "features",
    with_tables(MESSAGES)
    + "SELECT id, "
    + " || ".join(f"CASE WHEN {flag} THEN '1' ELSE '0' END" for flag in _FLAGS.values())
    + " AS flags FROM messages",
)
def features(spark, sf_dir):
    table = model.with_features(D.messages(spark, sf_dir))
    bits = [F.col(n).cast("int").cast("string") for n in model.FEATURE_NAMES]
    return table.select("id", F.concat(*bits).alias("flags"))


@query(
    "score",
    with_tables(MESSAGES, f"scored AS (SELECT id, CAST({_LOGIT} AS DOUBLE) AS logit FROM messages)")
    + "SELECT id, round(1.0 / (1.0 + exp(-logit)), 6) AS probability, 1.0 / (1.0 + exp(-logit)) >= 0.72 AS not_a_payment FROM scored",
)
def score(spark, sf_dir):
    scored = model.score(D.messages(spark, sf_dir))
    return scored.select("id", F.round("probability", 6).alias("probability"), "not_a_payment")


# --- statements ---------------------------------------------------------------

_STATEMENTS = """
stmt AS (
  SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, CAST(o_orderdate AS DATE) AS day, o_orderdate AS ts,
         lower(o_orderstatus) || left(o_orderpriority, 1) AS code,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         format('{:,.2f}', CAST(round(o_totalprice * 100) AS BIGINT) / 100) AS grouped,
         'Shop X' || translate(CAST(o_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS shop,
         lpad(CAST(o_orderkey + 100000000 AS VARCHAR), 12, '0') AS ref
  FROM orders),
csv AS (
  SELECT *, 'stmt-' || code || '.csv' AS file_name, pr <> '1-URGENT' AND st <> 'P' AS has_ref,
    row_number() OVER (PARTITION BY code ORDER BY o_orderkey) - 1 AS idx,
    CASE st WHEN 'F' THEN strftime(day, '%d/%m/%Y') || ',Paid to ' || shop || ',' || CASE WHEN pr <> '1-URGENT' THEN ref ELSE '' END
                          || ',' || replace(grouped, ',', '') || ',DEBIT'
            WHEN 'O' THEN '"Received from ' || shop || '",' || strftime(day, '%Y-%m-%d') || ',"' || grouped || '",'
                          || CASE WHEN pr <> '1-URGENT' THEN ref ELSE '' END
            ELSE strftime(day, '%d %b %Y') || ',' || shop || ',"' || grouped || '",0.00,"'
                          || format('{:,.2f}', (cents + 100000000) / 100) || '"' END AS line
  FROM stmt)"""


@query(
    "statement_rows",
    with_tables(_STATEMENTS)
    + """SELECT file_name AS origin_label, cents AS amount_minor, CASE WHEN st = 'O' THEN 'CREDIT' ELSE 'DEBIT' END AS type,
         CAST(ts AS VARCHAR) AS txn_ts, shop AS merchant_name, CASE WHEN has_ref THEN ref END AS reference_number,
         CASE WHEN has_ref THEN 'csv-ref:' || ref
              ELSE 'csv-' || file_name || '-r' || CAST(idx AS VARCHAR) || '-' || left(sha256(line), 16) END AS source_identifier,
         CASE WHEN has_ref THEN 'PARSED' ELSE 'PARTIALLY_PARSED' END AS parse_status,
         CASE WHEN has_ref THEN 'UPI' ELSE 'UNKNOWN' END AS payment_method,
         CASE WHEN NOT has_ref THEN line END AS raw_payload FROM csv""",
)
def statement_rows_query(spark, sf_dir):
    parsed = statement_rows.extract(D.statement_csv_lines(spark, sf_dir))
    return parsed.select(
        "origin_label", "amount_minor", "type", "txn_ts", "merchant_name", "reference_number",
        "source_identifier", "parse_status", "payment_method", "raw_payload",
    )


@query(
    "cell_kinds",
    with_tables(_STATEMENTS)
    + """, kinds AS (
      SELECT file_name, unnest(CASE st
        WHEN 'F' THEN ['DATE', 'NARRATIVE', CASE WHEN has_ref THEN 'REFERENCE' ELSE 'NOISE' END, 'MONEY', 'TYPE_SIGNAL']
        WHEN 'O' THEN ['NARRATIVE', 'DATE', 'MONEY', CASE WHEN has_ref THEN 'REFERENCE' ELSE 'NOISE' END]
        ELSE ['DATE', 'NARRATIVE', 'MONEY', 'MONEY', 'MONEY'] END) AS kind FROM csv)
      SELECT file_name, kind, COUNT(*) AS cells FROM kinds GROUP BY file_name, kind""",
)
def cell_kinds(spark, sf_dir):
    lines = statement_rows.data_lines(D.statement_csv_lines(spark, sf_dir))
    fields = statement_rows.classified(lines).select("file_name", F.explode("fields.kind").alias("kind"))
    return fields.groupBy("file_name", "kind").agg(F.count("*").alias("cells"))


@query(
    "file_status",
    with_tables(_STATEMENTS) + "SELECT file_name, TRUE AS recognised, COUNT(*) AS rows FROM csv GROUP BY file_name",
)
def file_status(spark, sf_dir):
    return statement_rows.file_status(D.statement_csv_lines(spark, sf_dir)).select(
        "file_name", "recognised", "rows"
    )


_DOCUMENTS = """
doc AS (
  SELECT *, 'doc-' || code || '.pdf' AS file_name,
    CASE WHEN st = 'P' AND pr = '5-LOW' THEN ts + INTERVAL 605 MINUTE WHEN st = 'P' THEN ts + INTERVAL 779 MINUTE ELSE ts END AS told_at,
    CASE st WHEN 'F' THEN 'Paid to ' || shop || ' UPI Ref' WHEN 'O' THEN 'NEFT ' || shop
            ELSE CASE WHEN pr = '5-LOW' THEN 'Received from ' ELSE 'Paid to ' END || shop END AS description,
    CASE st WHEN 'O' THEN 'NEFT ' || shop ELSE shop END AS merchant
  FROM stmt)"""
_DOC_COLUMNS = """file_name AS origin_label, cents AS amount_minor,
  CASE WHEN st = 'P' AND pr = '5-LOW' THEN 'CREDIT' ELSE 'DEBIT' END AS type, CAST(told_at AS VARCHAR) AS txn_ts,
  description, merchant AS merchant_name, ref AS reference_number,
  CASE WHEN st = 'P' THEN 'gpay-pdf:' ELSE 'pdf-ref:' END || ref AS source_identifier, 'PARSED' AS parse_status"""
_TEXT_COLUMNS = [
    "origin_label", "amount_minor", "type", "txn_ts", "description", "merchant_name",
    "reference_number", "source_identifier", "parse_status",
]


@query("statement_text", with_tables(_STATEMENTS, _DOCUMENTS) + f"SELECT {_DOC_COLUMNS} FROM doc")
def statement_text_query(spark, sf_dir):
    return statement_text.extract(D.statement_text_lines(spark, sf_dir)).select(*_TEXT_COLUMNS)


@query(
    "wallet_layout", with_tables(_STATEMENTS, _DOCUMENTS) + f"SELECT {_DOC_COLUMNS} FROM doc WHERE st = 'P'"
)
def wallet_layout(spark, sf_dir):
    lines = D.statement_text_lines(spark, sf_dir)
    numbered = statement_text.number_entries(lines)
    matches = statement_text.wallet_matches(numbered, statement_text.wallet_files(numbered))
    return statement_text.wallet_rows(matches).select(*_TEXT_COLUMNS)


@query(
    "statement_blocks",
    with_tables(_STATEMENTS)
    + """SELECT 'doc-' || code || '.pdf' AS file_name, row_number() OVER (PARTITION BY code ORDER BY o_orderkey) AS block_no,
         CASE st WHEN 'F' THEN strftime(day, '%d/%m/%Y') || ' Paid to ' || shop || ' UPI Ref ' || ref || ' ' || grouped || ' DR'
              ELSE strftime(day, '%d/%m/%Y') || ' NEFT ' || shop || ' ' || ref || ' ' || grouped || ' 9,000,000.00' END AS body
         FROM stmt WHERE st <> 'P'""",
)
def statement_blocks(spark, sf_dir):
    lines = D.statement_text_lines(spark, sf_dir)
    numbered = statement_text.number_entries(lines)
    blocks = statement_text.dated_blocks(numbered, statement_text.wallet_files(numbered))
    return blocks.select("file_name", "block_no", "body")


@query(
    "document_status",
    with_tables(_STATEMENTS, _DOCUMENTS)
    + "SELECT file_name, TRUE AS recognised, COUNT(*) AS rows FROM doc GROUP BY file_name",
)
def document_status(spark, sf_dir):
    lines = D.statement_text_lines(spark, sf_dir)
    return statement_text.file_status(lines, statement_text.extract(lines)).select(
        "file_name", "recognised", "rows"
    )


_FILES = f"""
kept_kind AS (
  SELECT 'stmt-' || code AS kind, o_orderkey // {D.STATEMENT_ORDERS} AS block, 'CSV' AS source,
         CASE WHEN pr = '5-LOW' THEN 2 ELSE 1 END AS n FROM stmt
  UNION ALL
  SELECT 'doc-' || code, o_orderkey // {D.STATEMENT_ORDERS}, 'PDF',
         CASE st WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE CASE WHEN pr = '5-LOW' THEN 3 ELSE 6 END END FROM stmt),
written AS (
  SELECT kind, kind || '-' || block || CASE WHEN kind = 'stmt-f1' THEN '.txt' WHEN source = 'PDF' THEN '.pdf' ELSE '.csv' END AS file_name,
         CASE WHEN kind <> 'stmt-f1' THEN source END AS source,
         CASE WHEN kind = 'stmt-f1' THEN 0 ELSE SUM(n) END AS lines, COUNT(*) AS orders
  FROM kept_kind GROUP BY kind, block, source
  UNION ALL SELECT 'empty', 'stmt-empty.csv', 'CSV', 0, 0),
judged AS (
  SELECT *, CASE WHEN kind = 'stmt-f1' THEN '{V.FILE_UNSUPPORTED_MESSAGE}'
                 WHEN kind IN ('empty', 'stmt-p3', 'stmt-f4') THEN '{V.CSV_UNRECOGNISED_MESSAGE}'
                 WHEN kind = 'stmt-o4' THEN '{V.BATCH_FAILED_MESSAGE}'
                 WHEN kind = 'doc-f2' THEN '{V.TEXT_BLANK_MESSAGE}'
                 WHEN kind = 'doc-o3' THEN '{V.TEXT_UNRECOGNISED_MESSAGE}' END AS message
  FROM written)"""


@query(
    "statement_files",
    with_tables(_STATEMENTS, _FILES)
    + """SELECT file_name, row_number() OVER (ORDER BY file_name) - 1 AS file_seq, source, CAST(lines AS BIGINT) AS lines,
           CASE WHEN kind = 'stmt-o2' THEN CAST(lines AS BIGINT) ELSE 0 END AS repaired_lines,
           CASE WHEN message IS NULL THEN orders ELSE 0 END AS rows,
           CASE WHEN message IS NULL THEN 'READ' ELSE 'FAILED' END AS status, message,
           CASE WHEN kind = 'stmt-o4' THEN 'csv-empty-' || left(sha256(file_name), 12) END AS stub
         FROM judged""",
)
def statement_files_query(spark, sf_dir):
    imported = statement_files.import_files(*D.statement_files(spark, sf_dir))
    stubs = imported.parsed.filter(F.col("parse_status") == "FAILED").select(
        F.col("origin_label").alias("file_name"), F.col("source_identifier").alias("stub")
    )
    return imported.files.join(stubs, "file_name", "left")


@query(
    "split_cells",
    with_tables(_STATEMENTS)
    + """SELECT file_name, o_orderkey * 2 + 1 AS line_no, CASE st WHEN 'O' THEN 4 ELSE 5 END AS cells,
         CASE st WHEN 'F' THEN 'Paid to ' || shop WHEN 'O' THEN 'Received from ' || shop ELSE shop END AS narrative FROM csv""",
)
def split_cells(spark, sf_dir):
    lines = statement_rows.data_lines(D.statement_csv_lines(spark, sf_dir))
    split = lines.withColumn("cells", cells.split_line(F.col("line")))
    told = F.when(F.col("file_name").startswith("stmt-o"), F.get("cells", 0)).otherwise(F.get("cells", 1))
    return split.select("file_name", "line_no", F.size("cells").alias("cells"), told.alias("narrative"))
