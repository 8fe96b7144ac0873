"""Search, joins, edits, dims and audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.operators import audit, details, edits, search
from ledgerloom.plans.oracle_tables import BRIDGE, LABELS, LEDGER, SOURCES, with_tables
from ledgerloom.plans.registry import query
from ledgerloom.sources import dims
from ledgerloom.sources import driver_tables as D

_ROW = "txn_id, CAST(txn_ts AS VARCHAR) AS txn_ts, type, amount_minor, account_tail"
_ROW_COLUMNS = ["txn_id", "txn_ts", "type", "amount_minor", "account_tail"]


def _search(spark, sf_dir, spec, with_sources=False):
    sources = D.sources(spark, sf_dir) if with_sources else None
    return search.search(D.ledger(spark, sf_dir), spec, sources).select(*_ROW_COLUMNS)


@query(
    "ledger_search",
    with_tables(LEDGER)
    + f"""SELECT {_ROW} FROM ledger WHERE NOT is_ignored AND (
      merchant_name ILIKE '%er#00000001%' OR description ILIKE '%er#00000001%' OR notes ILIKE '%er#00000001%'
      OR reference_number ILIKE '%er#00000001%' OR bank_name ILIKE '%er#00000001%')""",
)
def ledger_search(spark, sf_dir):
    return _search(spark, sf_dir, search.LedgerFilter(search=" ER#00000001 "))


@query(
    "ledger_search_literal",
    with_tables(LEDGER)
    + f"""SELECT {_ROW} FROM ledger WHERE NOT is_ignored AND NOT is_promotional AND (
      contains(lower(bank_name), 'nation_1') OR contains(lower(notes), 'nation_1') OR contains(lower(description), 'nation_1'))""",
)
def ledger_search_literal(spark, sf_dir):
    return _search(spark, sf_dir, search.LedgerFilter(search="nation_1", exclude_promotional=True))


@query(
    "ledger_filter_all",
    with_tables(LEDGER, SOURCES)
    + f"""SELECT {_ROW} FROM ledger l
      WHERE txn_ts >= TIMESTAMP '1996-01-01' AND txn_ts < TIMESTAMP '1999-01-01' AND type = 'DEBIT'
        AND category_id IN (1, 2, 3) AND amount_minor BETWEEN 1000000 AND 40000000 AND NOT is_promotional
        AND (merchant_name ILIKE '%customer%' OR description ILIKE '%customer%' OR notes ILIKE '%customer%'
             OR reference_number ILIKE '%customer%' OR bank_name ILIKE '%customer%')
        AND EXISTS (SELECT 1 FROM sources s WHERE s.txn_id = l.txn_id AND s.source = 'SMS')""",
)
def ledger_filter_all(spark, sf_dir):
    spec = search.LedgerFilter(
        search="customer", period=search.Period.months(dt.date(1996, 1, 1), dt.date(1998, 12, 1)),
        type="DEBIT", source="SMS", category_ids=frozenset({1, 2, 3}),
        min_amount_minor=1_000_000, max_amount_minor=40_000_000, exclude_promotional=True,
        include_ignored=True,
    )
    return _search(spark, sf_dir, spec, with_sources=True)


@query(
    "uncategorised",
    with_tables(LEDGER)
    + f"SELECT {_ROW} FROM ledger WHERE category_id IS NULL AND NOT is_ignored AND NOT is_promotional",
)
def uncategorised(spark, sf_dir):
    spec = search.LedgerFilter(
        uncategorised_only=True, category_ids=frozenset({1}), exclude_promotional=True
    )
    return _search(spark, sf_dir, spec)


@query(
    "amount_band",
    with_tables(LEDGER)
    + f"SELECT {_ROW} FROM ledger WHERE amount_minor BETWEEN 500000 AND 2000050 AND NOT is_ignored",
)
def amount_band(spark, sf_dir):
    spec = search.LedgerFilter(
        min_amount_minor=search.amount_bound(spark, " 5,000 "),
        max_amount_minor=search.amount_bound(spark, "₹20000.50"),
    )
    return _search(spark, sf_dir, spec)


@query(
    "account_entries",
    with_tables(LEDGER)
    + f"""SELECT {_ROW} FROM ledger WHERE account_tail = '0042' AND type = 'CREDIT' AND NOT is_ignored
          AND txn_ts >= TIMESTAMP '1995-01-01' AND txn_ts < TIMESTAMP '2002-01-01'""",
)
def account_entries(spark, sf_dir):
    spec = search.LedgerFilter(
        account_tail="0042", type="CREDIT",
        period=search.Period.months(dt.date(1995, 1, 1), dt.date(2001, 12, 1)),
    )
    return _search(spark, sf_dir, spec)


@query(
    "by_source_semi",
    with_tables(LEDGER, SOURCES)
    + f"""SELECT {_ROW} FROM ledger l WHERE NOT is_ignored
          AND EXISTS (SELECT 1 FROM sources s WHERE s.txn_id = l.txn_id AND s.source = 'CSV')""",
)
def by_source_semi(spark, sf_dir):
    return _search(spark, sf_dir, search.LedgerFilter(source="CSV"), with_sources=True)


@query(
    "rescore_candidates",
    with_tables(LEDGER, SOURCES)
    + """SELECT txn_id, primary_source FROM ledger l WHERE NOT is_promotional AND NOT is_ignored AND (primary_source = 'SMS'
         OR EXISTS (SELECT 1 FROM sources s WHERE s.txn_id = l.txn_id AND s.source = 'SMS'))""",
)
def rescore_candidates(spark, sf_dir):
    found = search.rescore_candidates(D.ledger(spark, sf_dir), D.sources(spark, sf_dir))
    return found.select("txn_id", "primary_source")


@query(
    "key_lookup",
    with_tables(LEDGER, SOURCES)
    + """SELECT txn_id, source, source_identifier FROM sources s
         WHERE EXISTS (SELECT 1 FROM ledger l WHERE l.txn_id = s.txn_id AND l.category_id IS NULL)""",
)
def key_lookup(spark, sf_dir):
    keys = D.ledger(spark, sf_dir).filter(F.col("category_id").isNull())
    return search.lookup(D.sources(spark, sf_dir), keys, "txn_id").select(
        "txn_id", "source", "source_identifier"
    )


@query(
    "txn_labels",
    with_tables(LABELS, BRIDGE)
    + """SELECT txn_id, label_id, name, id AS sort_order FROM bridge JOIN label_dim ON id = label_id""",
)
def txn_labels(spark, sf_dir):
    return details.transaction_labels(D.transaction_labels(spark, sf_dir), D.labels(spark, sf_dir))


_CATEGORY_VALUES = ", ".join(f"({row[0]}, '{row[1]}')" for row in V.DEFAULT_CATEGORIES)


@query(
    "txn_detail",
    with_tables(LEDGER, SOURCES, LABELS, BRIDGE)
    + f"""SELECT txn_id, 'TRANSACTION' AS item, merchant_name AS value, k.name AS extra, CAST(txn_ts AS VARCHAR) AS at
          FROM ledger LEFT JOIN (VALUES {_CATEGORY_VALUES}) k(id, name) ON k.id = category_id
          UNION ALL
          SELECT txn_id, 'SOURCE', source || ':' || source_identifier, origin_label, CAST(imported_at AS VARCHAR)
          FROM sources WHERE txn_id IN (SELECT txn_id FROM ledger)
          UNION ALL
          SELECT txn_id, 'LABEL', name, NULL, NULL FROM bridge JOIN label_dim ON id = label_id
          WHERE txn_id IN (SELECT txn_id FROM ledger)""",
)
def txn_detail(spark, sf_dir):
    rows = details.transaction_detail(
        D.ledger(spark, sf_dir), D.categories(spark), D.sources(spark, sf_dir),
        D.transaction_labels(spark, sf_dir), D.labels(spark, sf_dir),
    )
    return rows.select("txn_id", "item", "value", "extra", "at")


# Orders have seven lines at most, so lists of three make payments with several chunks.
@query(
    "txn_full_detail",
    with_tables(LEDGER, SOURCES, LABELS, BRIDGE)
    + f""", listed AS (
          SELECT txn_id, (row_number() OVER (PARTITION BY txn_id ORDER BY imported_at, source, source_identifier, origin_label NULLS FIRST) - 1) // 3 AS chunk,
                 imported_at, source, source_identifier, origin_label FROM sources),
        tagged AS (
          SELECT txn_id, (row_number() OVER (PARTITION BY txn_id ORDER BY id, name) - 1) // 3 AS chunk, id, name
          FROM bridge JOIN label_dim ON id = label_id),
        source_lists AS (
          SELECT txn_id, chunk, string_agg(source || ':' || source_identifier || '@' || COALESCE(origin_label, ''), ' '
                 ORDER BY imported_at, source, source_identifier, origin_label NULLS FIRST) AS sources FROM listed GROUP BY ALL),
        label_lists AS (SELECT txn_id, chunk, string_agg(name, '/' ORDER BY id, name) AS labels FROM tagged GROUP BY ALL),
        lists AS (
          SELECT COALESCE(s.txn_id, t.txn_id) AS txn_id, COALESCE(s.chunk, t.chunk) AS chunk, sources, labels
          FROM source_lists s FULL JOIN label_lists t ON s.txn_id = t.txn_id AND s.chunk = t.chunk)
        SELECT l.txn_id, amount_minor, currency_code, type, CAST(txn_ts AS VARCHAR) AS txn_ts, description, merchant_name,
               reference_number, account_tail, bank_name, notes, category_id, k.name AS category, payment_method, primary_source,
               CASE WHEN primary_source = 'PDF' THEN 'PARTIALLY_PARSED' ELSE 'PARSED' END AS parse_status,
               is_promotional, is_ignored, COALESCE(chunk, 0) AS chunk, COALESCE(sources, '') AS sources, COALESCE(labels, '') AS labels
        FROM ledger l LEFT JOIN (VALUES {_CATEGORY_VALUES}) k(id, name) ON k.id = category_id
        LEFT JOIN lists x ON x.txn_id = l.txn_id""",
)
def txn_full_detail(spark, sf_dir):
    rows = details.full_detail(
        D.ledger(spark, sf_dir), D.categories(spark), D.sources(spark, sf_dir),
        D.transaction_labels(spark, sf_dir), D.labels(spark, sf_dir), size=3,
    )

    def told(x):
        return F.concat(x["source"], F.lit(":"), x["source_identifier"], F.lit("@"), F.coalesce(x["origin_label"], F.lit("")))

    return rows.select(
        "txn_id", "amount_minor", "currency_code", "type", "txn_ts", "description", "merchant_name", "reference_number",
        "account_tail", "bank_name", "notes", "category_id", "category", "payment_method", "primary_source", "parse_status",
        "is_promotional", "is_ignored", "chunk",
        F.array_join(F.transform("sources", told), " ").alias("sources"),
        F.array_join(F.transform("labels", lambda x: x["name"]), "/").alias("labels"),
    )


def _edits(spark, sf_dir):
    line = D.table(spark, sf_dir, "lineitem")
    flag, category = F.col("l_returnflag"), F.col("l_returnflag") == "A"
    return line.select(
        F.col("l_orderkey").alias("txn_id"),
        F.when(category, "category").when(flag == "N", "ignored").otherwise("promotional").alias("field"),
        F.when(category, F.col("l_linenumber").cast("string"))
        .otherwise((F.col("l_linestatus") == "O").cast("string")).alias("value"),
        (category & (F.col("l_linenumber") == 7)).alias("is_clear"),
        F.col("l_shipdate").alias("edited_at"),
    )


_EDIT_SQL = """
edits AS (
  SELECT l_orderkey AS txn_id,
         CASE l_returnflag WHEN 'A' THEN 'category' WHEN 'N' THEN 'ignored' ELSE 'promotional' END AS field,
         CASE l_returnflag WHEN 'A' THEN CAST(l_linenumber AS VARCHAR) WHEN 'N' THEN CAST(l_linestatus = 'O' AS VARCHAR)
              ELSE CAST(l_linestatus = 'O' AS VARCHAR) END AS value,
         l_returnflag = 'A' AND l_linenumber = 7 AS is_clear, l_shipdate AS edited_at
  FROM lineitem),
last_edit AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id, field ORDER BY edited_at DESC, is_clear DESC, value DESC) AS rn FROM edits)
  WHERE rn = 1),
stamp AS (SELECT txn_id, max(edited_at) AS edited_at FROM edits GROUP BY txn_id)"""


@query(
    "apply_edits",
    with_tables(LEDGER, _EDIT_SQL)
    + """SELECT l.txn_id,
           CASE WHEN c.txn_id IS NOT NULL THEN CASE WHEN NOT c.is_clear THEN CAST(c.value AS BIGINT) END ELSE category_id END AS category_id,
           COALESCE(CAST(i.value AS BOOLEAN), is_ignored) AS is_ignored,
           COALESCE(CAST(p.value AS BOOLEAN), is_promotional) AS is_promotional,
           CAST(COALESCE(s.edited_at, txn_ts) AS VARCHAR) AS updated_at
         FROM ledger l LEFT JOIN last_edit c ON c.txn_id = l.txn_id AND c.field = 'category'
           LEFT JOIN last_edit i ON i.txn_id = l.txn_id AND i.field = 'ignored'
           LEFT JOIN last_edit p ON p.txn_id = l.txn_id AND p.field = 'promotional'
           LEFT JOIN stamp s ON s.txn_id = l.txn_id""",
)
def apply_edits(spark, sf_dir):
    edited = edits.apply_edits(D.ledger(spark, sf_dir), _edits(spark, sf_dir))
    return edited.select("txn_id", "category_id", "is_ignored", "is_promotional", "updated_at")


def _label_dim(spark, sf_dir):
    return D.labels(spark, sf_dir).select(
        "id", "name", F.lit("90A4AE").alias("color_hex"),
        F.col("name").isin("PROMO", "SMALL").alias("is_system_defined"),
        F.col("sort_order").cast("int").alias("sort_order"),
    )


@query(
    "label_admin",
    with_tables(LABELS, BRIDGE)
    + """, kept AS (SELECT * FROM label_dim WHERE name NOT IN ('LARGE', 'ECONOMY')),
      cascaded AS (SELECT * FROM bridge WHERE label_id IN (SELECT id FROM kept)),
      requests AS (SELECT l_orderkey AS txn_id, id AS label_id, l_linestatus = 'O' AS attached, l_shipdate AS requested
                   FROM lineitem JOIN part ON l_partkey = p_partkey JOIN kept ON name = p_type),
      last_request AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id, label_id ORDER BY requested DESC, attached DESC) AS rn
                       FROM requests) WHERE rn = 1),
      final AS (
        SELECT c.txn_id, c.label_id FROM cascaded c LEFT JOIN last_request r ON r.txn_id = c.txn_id AND r.label_id = c.label_id WHERE r.txn_id IS NULL
        UNION ALL SELECT txn_id, label_id FROM last_request WHERE attached)
      SELECT k.name, COUNT(f.txn_id) AS transactions FROM kept k LEFT JOIN final f ON f.label_id = k.id GROUP BY k.name""",
)
def label_admin(spark, sf_dir):
    """Delete custom labels (cascading), then attach / detach labels in bulk."""
    labels, bridge = _label_dim(spark, sf_dir), D.transaction_labels(spark, sf_dir)
    doomed = labels.filter(F.col("name").isin("LARGE", "ECONOMY", "PROMO")).select("id")
    kept, cascaded = edits.delete_custom_labels(labels, bridge, doomed)
    line, part = D.table(spark, sf_dir, "lineitem"), D.table(spark, sf_dir, "part")
    requests = (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("txn_id"), F.col("p_type").alias("name"),
            (F.col("l_linestatus") == "O").alias("attached"), F.col("l_shipdate").alias("requested_at"),
        )
        .join(kept.select("name", F.col("id").alias("label_id")), "name")
        .drop("name")
    )
    linked = edits.set_labels(cascaded, requests).groupBy(F.col("label_id").alias("id")).agg(
        F.count("*").alias("n")
    )
    return kept.join(linked, "id", "left").select(
        "name", F.coalesce("n", F.lit(0)).alias("transactions")
    )


@query(
    "create_labels",
    with_tables(LABELS)
    + """SELECT name, '90A4AE' AS color_hex, CAST(id AS INTEGER) AS sort_order FROM label_dim
         UNION ALL
         SELECT min(name), '12AB34', 1000 FROM (SELECT DISTINCT trim(CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END) AS name FROM customer
                UNION SELECT 'Small Things') GROUP BY lower(name)""",
)
def create_labels(spark, sf_dir):
    customer = D.table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    named = F.when(F.col("c_acctbal") < 0, F.concat(F.lit(" "), F.lower(segment))).otherwise(segment)
    wanted = F.explode(F.array(named, F.lit("Small Things "), F.lit("small"), F.lit("  ")))
    requests = customer.select(wanted.alias("name"), F.lit("#12AB34FF").alias("color_hex"))
    made = edits.create_labels(_label_dim(spark, sf_dir), requests)
    return made.select("name", "color_hex", "sort_order")


@query(
    "label_collisions",
    """SELECT lower(p_type) AS folded, COUNT(*) AS labels FROM
       (SELECT DISTINCT CASE WHEN p_size < 25 THEN lower(p_type) ELSE p_type END AS p_type FROM part)
       GROUP BY lower(p_type) HAVING COUNT(*) > 1""",
)
def label_collisions(spark, sf_dir):
    part = D.table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") < 25, F.lower("p_type")).otherwise(F.col("p_type"))
    return edits.name_collisions(part.select(name.alias("name")).distinct())


_LABEL_VALUES = ", ".join(f"({r[0]}, '{r[1]}', {r[4]})" for r in V.DEFAULT_LABELS)


@query(
    "seed_dims",
    with_tables(LABELS)
    + f"""SELECT id, name, CAST(id AS INTEGER) AS sort_order FROM label_dim
          UNION ALL SELECT id, name, sort_order FROM (VALUES {_LABEL_VALUES}) v(id, name, sort_order)
          WHERE id NOT IN (SELECT id FROM label_dim) AND name NOT IN (SELECT name FROM label_dim)""",
)
def seed_dims(spark, sf_dir):
    existing = _label_dim(spark, sf_dir)
    bridge = D.transaction_labels(spark, sf_dir)
    seeded, _ = dims.seed_labels(existing, dims.default_labels(spark), bridge, V.DEFAULT_LABELS_VERSION)
    return dims.ordered_labels(seeded).select("id", "name", "sort_order")


@query(
    "audit_unique",
    with_tables(LEDGER, SOURCES)
    + """, d AS (SELECT COUNT(*) AS n FROM sources GROUP BY source, source_identifier HAVING COUNT(*) > 1)
      SELECT 'source_identifier' AS audit, COUNT(*) AS keys, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS rows FROM d
      UNION ALL SELECT 'txn_id', COUNT(*), CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM ledger GROUP BY txn_id HAVING COUNT(*) > 1)""",
)
def audit_unique(spark, sf_dir):
    sources, ledger = D.sources(spark, sf_dir), D.ledger(spark, sf_dir)
    return audit.duplicate_summary(
        "source_identifier", sources, "source", "source_identifier"
    ).unionByName(audit.duplicate_summary("txn_id", ledger, "txn_id"))


# Planted clashes: every tenth payment told again, lines that share an id, label names and pairs told twice.
@query(
    "audit_keys",
    with_tables(LEDGER, SOURCES, LABELS, BRIDGE)
    + """, told AS (SELECT * FROM ledger UNION ALL SELECT * FROM ledger WHERE txn_id % 10 = 0),
      lines AS (SELECT source, CASE WHEN txn_id % 7 = 0 THEN txn_id || '-' ELSE source_identifier END AS id FROM sources WHERE txn_id % 11 > 0),
      names AS (SELECT lower(split_part(name, ' ', 1)) AS name FROM label_dim),
      pairs AS (SELECT txn_id, label_id FROM bridge UNION ALL SELECT txn_id, label_id FROM bridge WHERE label_id % 3 = 0),
      keys AS (
        SELECT 'fingerprint' AS audit, currency_code || amount_minor || '/' || reference_number AS key FROM told
        UNION ALL SELECT 'txn_id', CAST(txn_id AS VARCHAR) FROM told
        UNION ALL SELECT 'source id', source || ' ' || id FROM lines
        UNION ALL SELECT 'label name', name FROM names
        UNION ALL SELECT 'label pair', txn_id || ' ' || label_id FROM pairs),
      counted AS (SELECT audit, COUNT(*) AS n FROM keys WHERE key IS NOT NULL GROUP BY audit, key)
      SELECT audit, COUNT(*) FILTER (WHERE n > 1) AS keys, CAST(COALESCE(SUM(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows FROM counted GROUP BY audit
      UNION ALL SELECT 'category name', 0, 0""",
)
def audit_keys(spark, sf_dir):
    ledger, lines, pairs = D.ledger(spark, sf_dir), D.sources(spark, sf_dir), D.transaction_labels(spark, sf_dir)
    own = F.concat(F.col("currency_code"), F.col("amount_minor"), F.lit("/"), F.col("reference_number"))
    told = ledger.unionByName(ledger.filter(F.col("txn_id") % 10 == 0)).withColumn("fingerprint", own)
    shared = F.when(F.col("txn_id") % 7 == 0, F.concat("txn_id", F.lit("-"))).otherwise(F.col("source_identifier"))
    named = D.labels(spark, sf_dir).select(F.lower(F.split_part("name", F.lit(" "), F.lit(1))).alias("name"))
    lines = lines.withColumn("source_identifier", F.when(F.col("txn_id") % 11 > 0, shared))
    return audit.unique_keys(
        (told, {"fingerprint": ["fingerprint"], "txn_id": ["txn_id"]}),
        (lines, {"source id": ["source", "source_identifier"]}),
        (named, {"label name": ["name"]}),
        (D.categories(spark), {"category name": ["name"]}),
        (pairs.unionByName(pairs.filter(F.col("label_id") % 3 == 0)), {"label pair": ["txn_id", "label_id"]}),
    )


@query(
    "audit_domain",
    with_tables(LEDGER, SOURCES)
    + f"""SELECT 'type' AS audit, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 'payment_method', 0 UNION ALL SELECT 'primary_source', 0
      UNION ALL SELECT 'parse_status', 0
      UNION ALL SELECT 'amount_minor', COUNT(*) FILTER (WHERE amount_minor < 0) FROM ledger
      UNION ALL SELECT 'currency_code', COUNT(*) FILTER (WHERE length(currency_code) <> 3) FROM ledger
      UNION ALL SELECT 'sources.txn_id', COUNT(*) FROM sources WHERE txn_id NOT IN (SELECT txn_id FROM ledger)
      UNION ALL SELECT 'lineitem.l_partkey', COUNT(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""",
)
def audit_domain(spark, sf_dir):
    ledger, sources = D.ledger(spark, sf_dir), D.sources(spark, sf_dir)
    line, part = D.table(spark, sf_dir, "lineitem"), D.table(spark, sf_dir, "part")
    return (
        audit.domain_violations(ledger)
        .unionByName(audit.orphan_summary("sources.txn_id", sources, "txn_id", ledger, "txn_id"))
        .unionByName(audit.orphan_summary("lineitem.l_partkey", line, "l_partkey", part, "p_partkey"))
    )
