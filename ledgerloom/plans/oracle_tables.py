"""The derived tables once more, as SQL common table expressions for the oracle."""

from __future__ import annotations

LEDGER = """
ledger AS (
  SELECT o_orderkey AS txn_id,
         CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
         CASE WHEN n_regionkey = 1 THEN 'USD' ELSE 'INR' END AS currency_code,
         CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS type,
         o_orderdate AS txn_ts,
         CAST(o_orderdate AS DATE) AS day,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CASE WHEN o_orderstatus = 'P'
                THEN 'Your Axis Bank Credit Card XX' || right(lpad(CAST(o_custkey AS VARCHAR), 4, '0'), 4)
                     || ' available limit is INR ' || format('{:,.2f}', CAST(round(o_totalprice * 100) AS BIGINT) / 100)
              WHEN o_orderstatus = 'O'
                THEN 'INR ' || format('{:,.2f}', CAST(round(o_totalprice * 100) AS BIGINT) / 100)
                     || ' debited A/c no. XX' || right(lpad(CAST(o_custkey AS VARCHAR), 4, '0'), 4)
                     || ' UPI/P2M/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '/' || c_name
         END AS description,
         CASE WHEN o_orderpriority <> '3-MEDIUM' THEN c_name END AS merchant_name,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN 'UPI Ref ' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END AS reference_number,
         right(lpad(CAST(o_custkey AS VARCHAR), 4, '0'), 4) AS account_tail,
         n_name AS bank_name,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 'check with ' || c_mktsegment END AS notes,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(left(o_orderpriority, 1) AS BIGINT) END AS category_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CARD' WHEN 'BUILDING' THEN 'UPI' WHEN 'FURNITURE' THEN 'NEFT'
              WHEN 'HOUSEHOLD' THEN 'CASH' ELSE 'UNKNOWN' END AS payment_method,
         CASE o_orderstatus WHEN 'F' THEN 'SMS' WHEN 'O' THEN 'CSV' ELSE 'PDF' END AS primary_source,
         o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AS is_promotional,
         c_acctbal < 0 AS is_ignored
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

COUNTED = "counted AS (SELECT * FROM ledger WHERE NOT is_promotional AND NOT is_ignored)"

REPORTING = """
reporting AS (
  SELECT month, currency_code AS reporting
  FROM (SELECT month, currency_code, row_number() OVER (PARTITION BY month ORDER BY txn_ts, txn_id) AS rn FROM counted)
  WHERE rn = 1
)"""

SOURCES = """
sources AS (
  SELECT l_orderkey AS txn_id,
         CASE l_returnflag WHEN 'A' THEN 'SMS' WHEN 'N' THEN 'CSV' ELSE 'PDF' END AS source,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS source_identifier,
         CASE WHEN l_linestatus = 'O' THEN 'AX-AXISBK' END AS origin_label,
         CASE WHEN l_linestatus = 'O' AND l_linenumber = 1
              THEN 'EMI of Rs ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' is due for your loan account' END AS raw_payload,
         l_shipdate AS imported_at
  FROM lineitem
)"""

LABELS = "label_dim AS (SELECT min(p_partkey) AS id, p_type AS name FROM part GROUP BY p_type)"

BRIDGE = """
bridge AS (
  SELECT DISTINCT l_orderkey AS txn_id, d.id AS label_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN label_dim d ON d.name = p_type
)"""

MESSAGES = """
messages AS (
  SELECT event_id AS id, event_type, user_id, ts AS received_at,
         CAST(round(value * 3700) AS BIGINT) AS cents,
         lpad(CAST(event_id + 100000000 AS VARCHAR), 12, '0') AS ref,
         lpad(CAST(user_id AS VARCHAR), 4, '0') AS tail,
         CASE event_type WHEN 'purchase' THEN 'AX-AXISBK' WHEN 'signup' THEN 'VM-HDFCBK' WHEN 'click' THEN 'LM-SWIGGY'
              WHEN 'view' THEN 'AX-AXISBK' ELSE 'VK-SBIINB' END AS address,
         CASE
           WHEN event_type = 'purchase' AND user_id < 75
             THEN 'INR ' || format('{:,.2f}', CAST(round(value * 3700) AS BIGINT) / 100) || ' debited' || chr(10)
                  || 'A/c no. XX' || lpad(CAST(user_id AS VARCHAR), 4, '0') || chr(10) || strftime(ts, '%d-%m-%y, %H:%M:%S') || chr(10)
                  || 'UPI/P2M/' || lpad(CAST(event_id + 100000000 AS VARCHAR), 12, '0') || '/STORE ' || lpad(CAST(user_id AS VARCHAR), 4, '0') || chr(10)
                  || 'Not you? SMS BLOCKUPI' || chr(10) || 'Axis Bank'
           WHEN event_type = 'purchase'
             THEN 'Rs.' || format('{:,.2f}', CAST(round(value * 3700) AS BIGINT) / 100) || ' spent on your ICICI Bank Credit Card XX'
                  || lpad(CAST(user_id AS VARCHAR), 4, '0') || ' at ZOMATO. Avl limit Rs.80,000.00'
           WHEN event_type = 'signup'
             THEN 'Your a/c XX' || lpad(CAST(user_id AS VARCHAR), 4, '0') || ' is credited with INR '
                  || format('{:,.2f}', CAST(round(value * 3700) AS BIGINT) / 100) || ' on ' || strftime(ts, '%d-%m-%y')
                  || ' by UPI Ref No. ' || lpad(CAST(event_id + 100000000 AS VARCHAR), 12, '0')
           WHEN event_type = 'click'
             THEN 'Grab Rs ' || format('{:,.2f}', CAST(round(value * 3700) AS BIGINT) / 100) || ' off. Coupon SAVE150. Limited period offer.'
           WHEN event_type = 'view'
             THEN 'Your Axis Bank Credit Card XX' || lpad(CAST(user_id AS VARCHAR), 4, '0') || ' available limit is INR '
                  || format('{:,.2f}', CAST(round(value * 3700) AS BIGINT) / 100)
           ELSE 'Your OTP for login is ' || CAST(user_id + 400000 AS VARCHAR) || '. Do not share with anyone.'
         END AS body
  FROM events
)"""


def with_tables(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
