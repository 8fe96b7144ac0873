"""Dashboard and listing reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.operators import reports as R
from ledgerloom.plans.oracle_tables import COUNTED, LEDGER, REPORTING, SOURCES, with_tables
from ledgerloom.plans.registry import query
from ledgerloom.sources import driver_tables as D

MONTHLY = with_tables(LEDGER, COUNTED, REPORTING)

MONTH_TOTALS = """
totals AS (
  SELECT c.month, r.reporting AS currency_code,
         CAST(COALESCE(SUM(CASE WHEN c.currency_code = r.reporting AND type = 'CREDIT' THEN amount_minor END), 0) AS BIGINT) AS income,
         CAST(COALESCE(SUM(CASE WHEN c.currency_code = r.reporting AND type = 'DEBIT' THEN amount_minor END), 0) AS BIGINT) AS expenses,
         COUNT(*) AS transaction_count,
         COUNT(CASE WHEN c.currency_code = r.reporting AND type = 'CREDIT' THEN 1 END) AS income_count,
         COUNT(CASE WHEN c.currency_code = r.reporting AND type = 'DEBIT' THEN 1 END) AS expense_count
  FROM counted c JOIN reporting r ON c.month = r.month GROUP BY c.month, r.reporting
)"""


@query(
    "month_totals",
    with_tables(LEDGER, COUNTED, REPORTING, MONTH_TOTALS)
    + """SELECT CAST(month AS VARCHAR) AS month, currency_code, income, expenses, income - expenses AS net,
         transaction_count, income_count, expense_count FROM totals""",
)
def month_totals(spark, sf_dir):
    return R.month_totals(D.ledger(spark, sf_dir))


@query(
    "month_over_month",
    with_tables(LEDGER, COUNTED, REPORTING, MONTH_TOTALS)
    + """, prev AS (
      SELECT t.month,
             CASE WHEN COUNT(c.txn_id) > 0 THEN CAST(COALESCE(SUM(CASE WHEN c.currency_code = t.currency_code AND c.type = 'CREDIT' THEN c.amount_minor END), 0) AS BIGINT) END AS previous_income,
             CASE WHEN COUNT(c.txn_id) > 0 THEN CAST(COALESCE(SUM(CASE WHEN c.currency_code = t.currency_code AND c.type = 'DEBIT' THEN c.amount_minor END), 0) AS BIGINT) END AS previous_expenses
      FROM totals t LEFT JOIN counted c ON c.month = t.month - INTERVAL 1 MONTH GROUP BY t.month)
    SELECT CAST(t.month AS VARCHAR) AS month, currency_code, income, expenses, transaction_count, previous_income, previous_expenses,
           round(CASE WHEN previous_expenses <> 0 THEN CAST(expenses - previous_expenses AS DOUBLE) / CAST(previous_expenses AS DOUBLE) END, 6) AS expense_change_ratio
    FROM totals t JOIN prev p ON t.month = p.month""",
)
def month_over_month(spark, sf_dir):
    return R.month_over_month(D.ledger(spark, sf_dir))


CATEGORY_VALUES = ", ".join(f"({row[0]}, '{row[1]}')" for row in V.DEFAULT_CATEGORIES)
BREAKDOWN = f"""
debits AS (SELECT c.*, r.reporting FROM counted c JOIN reporting r ON c.month = r.month WHERE type = 'DEBIT'),
expense_total AS (
  SELECT month, SUM(CASE WHEN currency_code = reporting THEN amount_minor ELSE 0 END) AS total FROM debits GROUP BY month),
picked AS (
  SELECT month, category_id, reporting,
         CASE WHEN bool_or(currency_code = reporting) THEN reporting
              ELSE max(CASE WHEN rn = 1 THEN currency_code END) END AS picked
  FROM (SELECT *, row_number() OVER (PARTITION BY month, category_id ORDER BY txn_ts, txn_id) AS rn FROM debits)
  GROUP BY month, category_id, reporting),
breakdown AS (
  SELECT d.month, d.category_id, k.name AS category, p.picked AS currency_code,
         CAST(SUM(CASE WHEN d.currency_code = p.picked THEN amount_minor END) AS BIGINT) AS amount,
         COUNT(*) AS transaction_count,
         CASE WHEN p.picked = p.reporting THEN CASE WHEN max(t.total) = 0 THEN 0.0 ELSE
              round(CAST(SUM(CASE WHEN d.currency_code = p.picked THEN amount_minor END) AS DOUBLE) / CAST(max(t.total) AS DOUBLE), 6) END END AS share,
         min(txn_ts) AS first_ts, min(d.txn_id + epoch(txn_ts) * 10000000000) AS first_at
  FROM debits d JOIN picked p ON d.month = p.month AND d.category_id IS NOT DISTINCT FROM p.category_id
       JOIN expense_total t ON t.month = d.month
       LEFT JOIN (VALUES {CATEGORY_VALUES}) k(id, name) ON k.id = d.category_id
  GROUP BY d.month, d.category_id, k.name, p.picked, p.reporting),
ranked AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY amount DESC, first_at) AS position FROM breakdown)"""
BREAKDOWN_TABLES = with_tables(LEDGER, COUNTED, REPORTING, BREAKDOWN)


def _breakdown(spark, sf_dir):
    return R.category_breakdown(D.ledger(spark, sf_dir), D.categories(spark))


@query(
    "category_breakdown",
    BREAKDOWN_TABLES
    + """SELECT CAST(month AS VARCHAR) AS month, category_id, category, currency_code, amount, transaction_count, share
         FROM breakdown""",
)
def category_breakdown(spark, sf_dir):
    return _breakdown(spark, sf_dir).drop("first")


@query(
    "top_categories",
    BREAKDOWN_TABLES
    + """SELECT CAST(month AS VARCHAR) AS month, category, amount, CAST(position AS INTEGER) AS position
         FROM ranked WHERE position <= 4""",
)
def top_categories(spark, sf_dir):
    return R.top_categories(_breakdown(spark, sf_dir)).select("month", "category", "amount", "position")


@query(
    "top_categories_rest",
    BREAKDOWN_TABLES
    + """SELECT CAST(month AS VARCHAR) AS month, CAST(least(position, 6) AS INTEGER) AS slot,
           max(CASE WHEN position <= 5 THEN COALESCE(category, '') ELSE '' END) AS label,
           round(COALESCE(SUM(share), 0.0), 6) AS share
         FROM ranked GROUP BY month, least(position, 6)
         HAVING least(position, 6) <= 5 OR round(COALESCE(SUM(share), 0.0), 6) > 0.01""",
)
def top_categories_rest(spark, sf_dir):
    return R.top_categories_with_rest(_breakdown(spark, sf_dir))


DAILY = """
day_pick AS (
  SELECT month, day, reporting,
         CASE WHEN bool_or(currency_code = reporting) THEN reporting ELSE max(CASE WHEN rn = 1 THEN currency_code END) END AS picked
  FROM (SELECT c.*, r.reporting, row_number() OVER (PARTITION BY day ORDER BY txn_ts, txn_id) AS rn
        FROM counted c JOIN reporting r ON c.month = r.month WHERE type = 'DEBIT')
  GROUP BY month, day, reporting),
spent AS (
  SELECT p.day, p.picked, CAST(SUM(amount_minor) AS BIGINT) AS amount
  FROM counted c JOIN day_pick p ON c.day = p.day AND c.currency_code = p.picked WHERE type = 'DEBIT' GROUP BY p.day, p.picked),
spine AS (
  SELECT month, reporting, CAST(unnest(generate_series(month, last_day(month), INTERVAL 1 DAY)) AS DATE) AS day FROM reporting),
daily AS (
  SELECT s.month, s.day, COALESCE(p.picked, s.reporting) AS currency_code, COALESCE(p.amount, 0) AS amount
  FROM spine s LEFT JOIN spent p ON s.day = p.day)"""
DAILY_TABLES = with_tables(LEDGER, COUNTED, REPORTING, DAILY)


@query(
    "daily_spending",
    DAILY_TABLES
    + "SELECT CAST(month AS VARCHAR) AS month, CAST(day AS VARCHAR) AS day, currency_code, amount FROM daily",
)
def daily_spending(spark, sf_dir):
    return R.daily_spending(D.ledger(spark, sf_dir))


@query(
    "busiest_day",
    DAILY_TABLES
    + """SELECT CAST(month AS VARCHAR) AS month, CAST(day AS VARCHAR) AS day, amount
         FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY amount DESC, day) AS rn FROM daily) WHERE rn = 1""",
)
def busiest_day(spark, sf_dir):
    return R.busiest_day(R.daily_spending(D.ledger(spark, sf_dir)))


@query(
    "recent_by_month",
    with_tables(LEDGER)
    + """SELECT CAST(month AS VARCHAR) AS month, CAST(position AS INTEGER) AS position, txn_id, amount_minor
         FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY txn_ts DESC, txn_id DESC) AS position
               FROM ledger WHERE NOT is_ignored) WHERE position <= 8""",
)
def recent_by_month(spark, sf_dir):
    return R.recent_by_month(D.ledger(spark, sf_dir)).select("month", "position", "txn_id", "amount_minor")


@query(
    "day_sorted_entries",
    with_tables(LEDGER)
    + "SELECT CAST(day AS VARCHAR) AS day, txn_id, type, amount_minor FROM ledger ORDER BY day DESC, amount_minor DESC, txn_ts DESC, txn_id DESC",
)
def day_sorted_entries(spark, sf_dir):
    rows = R.day_entries(D.ledger(spark, sf_dir), "AMOUNT_HIGH_TO_LOW")
    return rows.select("day", "txn_id", "type", "amount_minor")


def _sides(preferred: str) -> str:
    """Per-day sides in SQL; ``preferred`` is a currency expression per day."""
    parts = []
    for side, kind in (("credit", "CREDIT"), ("debit", "DEBIT")):
        parts.append(
            f"""{side}_pick AS (
  SELECT day, CASE WHEN bool_or(currency_code = preferred) THEN max(preferred)
                   ELSE max(CASE WHEN rn = 1 THEN currency_code END) END AS ccy
  FROM (SELECT l.day, l.currency_code, d.preferred,
               row_number() OVER (PARTITION BY l.day ORDER BY txn_ts DESC, txn_id DESC) AS rn
        FROM shown l JOIN days d ON l.day = d.day WHERE type = '{kind}' AND NOT is_promotional AND NOT is_ignored) GROUP BY day),
{side}_sum AS (
  SELECT p.day, p.ccy, CAST(SUM(amount_minor) AS BIGINT) AS amount
  FROM shown l JOIN {side}_pick p ON l.day = p.day AND l.currency_code = p.ccy
  WHERE type = '{kind}' AND NOT is_promotional AND NOT is_ignored GROUP BY p.day, p.ccy)"""
        )
    return f"""
days AS (SELECT day, {preferred} AS preferred, COUNT(*) AS transaction_count,
                COUNT(CASE WHEN category_id IS NULL THEN 1 END) AS uncategorised_count FROM shown GROUP BY day),
{", ".join(parts)},
day_sides AS (
  SELECT d.day, COALESCE(c.amount, 0) AS credit_total, COALESCE(c.ccy, preferred) AS credit_currency,
         COALESCE(b.amount, 0) AS debit_total, COALESCE(b.ccy, preferred) AS debit_currency,
         transaction_count, uncategorised_count
  FROM days d LEFT JOIN credit_sum c ON c.day = d.day LEFT JOIN debit_sum b ON b.day = d.day)"""


NET = """CASE WHEN credit_currency = debit_currency THEN credit_total - debit_total
              WHEN credit_total = 0 THEN -debit_total ELSE credit_total END"""
NET_COLUMNS = f"""{NET} AS net,
  CASE WHEN credit_total = 0 AND credit_currency <> debit_currency THEN debit_currency ELSE credit_currency END AS net_currency,
  CASE WHEN {NET} > 0 THEN 'PROFIT' WHEN {NET} < 0 THEN 'LOSS' ELSE 'EVEN' END AS flag"""
SHOWN_ALL = "shown AS (SELECT * FROM ledger)"
SHOWN_VISIBLE = "shown AS (SELECT * FROM ledger WHERE NOT is_ignored)"


@query(
    "day_groups",
    with_tables(LEDGER, SHOWN_ALL, _sides("'INR'"))
    + f"""SELECT CAST(day AS VARCHAR) AS day, credit_total, credit_currency, debit_total, debit_currency,
          transaction_count, uncategorised_count, {NET_COLUMNS} FROM day_sides""",
)
def day_groups(spark, sf_dir):
    return R.day_groups(D.ledger(spark, sf_dir))


MONTH_SIDES = """
month_pick AS (
  SELECT date_trunc('month', day) AS month,
         CASE WHEN bool_or(credit_currency = 'INR') THEN 'INR' ELSE arg_max(credit_currency, day) END AS cc,
         CASE WHEN bool_or(debit_currency = 'INR') THEN 'INR' ELSE arg_max(debit_currency, day) END AS dc
  FROM day_sides GROUP BY 1),
month_sides AS (
  SELECT p.month, CAST(SUM(CASE WHEN credit_currency = cc THEN credit_total END) AS BIGINT) AS credit_total, cc AS credit_currency,
         CAST(SUM(CASE WHEN debit_currency = dc THEN debit_total END) AS BIGINT) AS debit_total, dc AS debit_currency,
         CAST(SUM(transaction_count) AS BIGINT) AS transaction_count, CAST(SUM(uncategorised_count) AS BIGINT) AS uncategorised_count
  FROM day_sides s JOIN month_pick p ON date_trunc('month', s.day) = p.month GROUP BY p.month, cc, dc)"""
_SHARED = "credit_total, credit_currency, debit_total, debit_currency, transaction_count, uncategorised_count"


@query(
    "month_day_rollup",
    with_tables(LEDGER, SHOWN_ALL, _sides("'INR'"), MONTH_SIDES)
    + f"""SELECT 'DAY' AS level, CAST(day AS VARCHAR) AS period, {_SHARED}, {NET_COLUMNS} FROM day_sides
          UNION ALL SELECT 'MONTH', CAST(CAST(month AS DATE) AS VARCHAR), {_SHARED}, {NET_COLUMNS} FROM month_sides""",
)
def month_day_rollup(spark, sf_dir):
    return R.month_day_rollup(D.ledger(spark, sf_dir))


@query(
    "direction_totals",
    with_tables(
        LEDGER, SHOWN_VISIBLE,
        _sides("max(currency_code) FILTER (WHERE rn_day = 1)").replace(
            "FROM shown GROUP BY day)",
            "FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY txn_ts DESC, txn_id DESC) AS rn_day FROM shown) GROUP BY day)",
            1,
        ),
    )
    + """SELECT CAST(day AS VARCHAR) AS day, credit_total, credit_currency, debit_total, debit_currency, transaction_count
         FROM day_sides""",
)
def direction_totals(spark, sf_dir):
    return R.direction_totals(D.ledger(spark, sf_dir))


@query(
    "date_bounds",
    with_tables(LEDGER)
    + "SELECT CAST(min(txn_ts) AS VARCHAR) AS earliest, CAST(max(txn_ts) AS VARCHAR) AS latest FROM ledger",
)
def date_bounds(spark, sf_dir):
    return R.date_bounds(D.ledger(spark, sf_dir))


@query(
    "accounts",
    with_tables(LEDGER)
    + "SELECT DISTINCT account_tail FROM ledger WHERE NOT is_ignored AND account_tail IS NOT NULL ORDER BY 1",
)
def accounts(spark, sf_dir):
    return R.account_tails(D.ledger(spark, sf_dir))


@query(
    "months_with_data",
    with_tables(LEDGER, COUNTED) + "SELECT DISTINCT CAST(month AS VARCHAR) AS month FROM counted ORDER BY 1 DESC",
)
def months_with_data(spark, sf_dir):
    return R.months_with_data(D.ledger(spark, sf_dir))


@query("total_count", with_tables(LEDGER) + "SELECT COUNT(*) AS transactions FROM ledger")
def total_count(spark, sf_dir):
    return R.total_count(D.ledger(spark, sf_dir))


@query(
    "count_by_source",
    with_tables(LEDGER, SOURCES)
    + """SELECT source, COUNT(DISTINCT s.txn_id) AS transactions FROM sources s JOIN ledger l ON s.txn_id = l.txn_id
         GROUP BY source""",
)
def count_by_source(spark, sf_dir):
    return R.count_by_source(D.ledger(spark, sf_dir), D.sources(spark, sf_dir))


@query(
    "source_sets",
    with_tables(SOURCES)
    + "SELECT txn_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM sources GROUP BY txn_id",
)
def source_sets(spark, sf_dir):
    sets = R.source_sets(D.sources(spark, sf_dir))
    return sets.select("txn_id", F.array_join("sources", ",").alias("sources"))


@query(
    "summaries",
    with_tables(LEDGER, COUNTED)
    + """SELECT CAST(txn_ts AS VARCHAR) AS txn_ts, type, amount_minor, currency_code, category_id, txn_id FROM counted
         WHERE txn_ts >= TIMESTAMP '1996-01-01' AND txn_ts < TIMESTAMP '1999-01-01'""",
)
def summaries(spark, sf_dir):
    import datetime as dt

    return R.summaries(D.ledger(spark, sf_dir), dt.datetime(1996, 1, 1), dt.datetime(1999, 1, 1))


@query(
    "display_title",
    with_tables(LEDGER)
    + """SELECT txn_id, COALESCE(merchant_name, description, bank_name, 'Unlabelled transaction') AS title,
         NOT is_promotional AND NOT is_ignored AS counts FROM ledger""",
)
def display_title(spark, sf_dir):
    return D.ledger(spark, sf_dir).select(
        "txn_id", R.display_title().alias("title"), R.counts_toward_totals().alias("counts")
    )
