"""Fingerprints, entity resolution, provenance, run history, store jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import alerts, arrival, model, reports, resolve, search, statement_rows, statement_text
from ledgerloom.operators.normalise import normalise
from ledgerloom.plans.oracle_tables import LEDGER, MESSAGES, SOURCES, with_tables
from ledgerloom.plans.registry import query
from ledgerloom.plans.text_queries import _DOCUMENTS, _LOGIT, _STATEMENTS
from ledgerloom.schemas import union_parsed
from ledgerloom.session import Scratch, shared_dir, stage_table, staged_in_passes
from ledgerloom.sources import driver_tables as D
from ledgerloom.sources import store as S

_BASE = """
base AS MATERIALIZED (
  SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         o_orderdate AS midnight, o_orderdate + INTERVAL 914 MINUTE AS timed,
         translate(CAST(o_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS letters,
         right(lpad(CAST(o_custkey AS VARCHAR), 4, '0'), 4) AS tail,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN lpad(CAST(o_orderkey + 100000000 AS VARCHAR), 12, '0') END AS ref,
         CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS type
  FROM orders JOIN customer ON o_custkey = c_custkey),
told AS (
  SELECT k * 8 AS seq, 'SMS' AS source, 'sms:' || k AS sid, timed AS ts, cents AS amount, 'UPI' AS method, NULL AS bank,
         CASE WHEN st = 'P' THEN 'PARTIALLY_PARSED' ELSE 'PARSED' END AS status, st = 'P' AND pr = '5-LOW' AS promo, 'UPI Ref: ' || ref AS printed, * FROM base
  UNION ALL
  SELECT k * 8 + 1, 'CSV', 'csv:' || k, midnight, CASE WHEN st = 'F' AND pr = '5-LOW' THEN 0 ELSE cents END, 'UNKNOWN', 'HDFC',
         CASE WHEN st = 'F' AND pr = '5-LOW' THEN 'FAILED' ELSE 'PARSED' END, FALSE, ref, * FROM base
  UNION ALL
  SELECT k * 8 + 2, 'PDF', CASE WHEN pr <> '2-HIGH' THEN 'pdf:' || k END, midnight, cents, 'UNKNOWN', NULL,
         CASE WHEN st = 'O' AND pr = '3-MEDIUM' THEN 'FAILED' ELSE 'PARSED' END, FALSE, 'Ref No ' || ref, * FROM base
  UNION ALL
  SELECT k * 8 + 3, 'SMS', 'sms:' || k, timed, cents, 'UPI', NULL, 'PARSED', st = 'P', 'UPI Ref: ' || ref, * FROM base
  UNION ALL
  SELECT k * 8 + 4, 'SMS', 'sms:' || k || 'b', timed, cents, 'UPI', NULL, 'PARSED', FALSE, 'UPI Ref: ' || ref, * FROM base),
copies AS MATERIALIZED (
  SELECT *, lower(source) || '-' || lower(st) AS origin,
    CASE WHEN ref IS NOT NULL THEN 'REFERENCE' ELSE 'FIELDS' END AS strategy,
    'Shop ' || CASE WHEN length(letters) <= 2 THEN 'X' || letters ELSE 'X' || lower(letters) END AS merchant_name,
    'v1:' || sha256(CASE WHEN ref IS NOT NULL THEN 'v1|REFERENCE|INR:' || amount || '|' || type || '|' || ref
      ELSE 'v1|FIELDS|INR:' || amount || '|' || type || '|' || strftime(midnight, '%Y-%m-%d') || '|SHOPX' || letters || '|' || tail END) AS fp
  FROM told)"""

# The same rules once more, as windows over the whole event list.
_RESOLVED = """
live AS (SELECT * FROM copies WHERE NOT (status = 'FAILED' AND amount = 0)),
reg AS MATERIALIZED (SELECT *, sid IS NULL OR row_number() OVER (PARTITION BY source, sid ORDER BY seq) = 1 AS registers FROM live),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY fp ORDER BY seq) AS pos, source = 'SMS' AND sid IS NOT NULL AS sms_id
  FROM reg WHERE registers),
held AS (
  SELECT *, COALESCE(SUM(CASE WHEN sms_id AND (status <> 'FAILED' OR pos = 1) THEN 1 ELSE 0 END)
     OVER (PARTITION BY fp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM placed),
roles AS (
  SELECT *, CASE WHEN pos = 1 THEN 'OPEN' WHEN status = 'FAILED' THEN 'OWN'
                 WHEN strategy = 'FIELDS' AND sms_id AND prior > 0 THEN 'OWN' ELSE 'JOIN' END AS role FROM held),
tagged AS MATERIALIZED (
  SELECT *, CASE WHEN role = 'OWN' THEN fp || '+' || COALESCE(sid, CAST(seq AS VARCHAR)) ELSE fp END AS gk FROM roles),
repeats AS (
  SELECT r.*, t.gk FROM reg r JOIN tagged t ON t.source = r.source AND t.sid = r.sid WHERE NOT r.registers),
flags AS MATERIALIZED (
  SELECT seq, gk, promo, FALSE AS is_repeat FROM tagged WHERE role IN ('OPEN', 'OWN') OR source = 'SMS' OR NOT promo
  UNION ALL SELECT seq, gk, promo, TRUE FROM repeats),
flagged AS (SELECT *, lag(promo) OVER (PARTITION BY gk ORDER BY seq) AS before FROM flags),
outcome AS (
  SELECT seq, source, origin, 'FAILED' AS outcome FROM copies WHERE status = 'FAILED' AND amount = 0
  UNION ALL SELECT seq, source, origin, CASE WHEN role = 'JOIN' THEN 'MERGED' WHEN status = 'FAILED' THEN 'FAILED' ELSE 'CREATED' END FROM tagged
  UNION ALL SELECT r.seq, r.source, r.origin, CASE WHEN f.before IS DISTINCT FROM r.promo THEN 'MERGED' ELSE 'DUPLICATE_SKIPPED' END
            FROM repeats r JOIN flagged f ON f.seq = r.seq),
merged AS (
  SELECT gk AS fingerprint, min(seq) AS txn_id, arg_min(amount, seq) AS amount_minor, arg_min(type, seq) AS type,
         COALESCE(arg_min(ts, seq) FILTER (WHERE ts <> midnight), arg_min(ts, seq)) AS txn_ts,
         arg_min(merchant_name, seq) AS merchant_name, arg_min(printed, seq) FILTER (WHERE printed IS NOT NULL) AS reference_number,
         arg_min(ref, seq) FILTER (WHERE ref IS NOT NULL) AS normalized_reference, arg_min(tail, seq) AS account_tail,
         arg_min(bank, seq) FILTER (WHERE bank IS NOT NULL) AS bank_name,
         COALESCE(arg_min(method, seq) FILTER (WHERE method <> 'UNKNOWN'), 'UNKNOWN') AS payment_method,
         arg_min(source, seq) AS primary_source,
         CASE min(CASE status WHEN 'PARSED' THEN 0 WHEN 'PARTIALLY_PARSED' THEN 1 ELSE 2 END) WHEN 0 THEN 'PARSED' WHEN 1 THEN 'PARTIALLY_PARSED' ELSE 'FAILED' END AS parse_status
  FROM tagged GROUP BY gk),
current_flag AS (SELECT gk, arg_max(promo, seq) AS is_promotional FROM flags GROUP BY gk)"""
_COPIES = with_tables(_BASE)
_ALL = with_tables(_BASE, _RESOLVED)


def _normalised(spark, sf_dir, stage=stage_table):
    """Normalised copies, written once: resolving reads them for keys and contents."""
    return stage(normalise(D.copies(spark, sf_dir)).drop("merchant_key"), "normalised")


def _imported(spark, sf_dir, scratch):
    """A store with all copies appended to it in one run, and the run's history."""
    store = S.LedgerStore(spark, shared_dir(spark, "store"))
    result = resolve.resolve(_normalised(spark, sf_dir, scratch.stage), store.state(), stage=scratch.stage)
    scratch.discard("normalised", "flags")
    result = resolve.with_outcomes_written(result, scratch.stage)
    history = resolve.import_summary(
        result.outcomes.withColumnRenamed("origin_label", "file_name"), "file_name", "source"
    )
    store.append(result, history, "import", 0)
    return store


#: What roles and outcomes are told by; contents stay out of what is written and shuffled.
_TOLD_BY = ["seq", "fingerprint", "strategy", "source", "source_identifier", "origin_label", "parse_status", "amount_minor", "is_promotional"]


def _to_tag(spark, sf_dir, *contents):
    return stage_table(normalise(D.copies(spark, sf_dir)).select(*_TOLD_BY, *contents), "normalised")


def _tagged(spark, sf_dir):
    return stage_table(resolve.tag_rows(_to_tag(spark, sf_dir)), "tagged")


@query(
    "fingerprints",
    _COPIES + "SELECT seq, fp AS fingerprint, strategy, merchant_name, tail AS account_tail, ref AS normalized_reference FROM copies",
)
def fingerprints(spark, sf_dir):
    return normalise(D.copies(spark, sf_dir)).select(
        "seq", "fingerprint", "strategy", "merchant_name", "account_tail", "normalized_reference"
    )


@query("resolve_outcomes", _ALL + "SELECT seq, source, origin AS origin_label, outcome FROM outcome")
def resolve_outcomes(spark, sf_dir):
    return resolve.outcomes(_tagged(spark, sf_dir))


_MERGED = """m.fingerprint, txn_id, amount_minor, type, CAST(txn_ts AS VARCHAR) AS txn_ts, merchant_name, reference_number,
  normalized_reference, account_tail, bank_name, payment_method, primary_source, parse_status, is_promotional"""


@query(
    "resolved_ledger",
    _ALL + f"SELECT {_MERGED} FROM merged m JOIN current_flag c ON c.gk = m.fingerprint",
)
def resolved_ledger(spark, sf_dir):
    scratch = Scratch(spark)
    result = resolve.resolve(_normalised(spark, sf_dir, scratch.stage), stage=scratch.stage)
    scratch.discard("normalised", "flags")
    ledger = result.ledger
    if result.passes > 1:
        ledger = staged_in_passes(ledger, "ledger", "fingerprint", result.passes)
        scratch.discard("tagged")
    return ledger.select(
        "fingerprint", "txn_id", "amount_minor", "type", "txn_ts", "merchant_name", "reference_number",
        "normalized_reference", "account_tail", "bank_name", "payment_method", "primary_source",
        "parse_status", "is_promotional",
    )


@query(
    "provenance",
    _ALL
    + """SELECT gk AS fingerprint, source, sid AS source_identifier, origin AS origin_label, seq,
         CASE WHEN status <> 'PARSED' THEN 'raw ' || k END AS raw_payload FROM tagged""",
)
def provenance(spark, sf_dir):
    # Read once, so the tagged rows are not written first.
    return resolve.provenance(resolve.tag_rows(_to_tag(spark, sf_dir, "raw_payload")))


_SUMMARY = """
summary AS (
  SELECT origin, source, COUNT(*) AS total_parsed, COUNT(CASE WHEN outcome = 'CREATED' THEN 1 END) AS new_count,
         COUNT(CASE WHEN outcome = 'MERGED' THEN 1 END) AS merged_count,
         COUNT(CASE WHEN outcome = 'DUPLICATE_SKIPPED' THEN 1 END) AS duplicate_count,
         COUNT(CASE WHEN outcome = 'FAILED' THEN 1 END) AS failed_count
  FROM outcome GROUP BY origin, source)"""
_SUMMARY_SELECT = """SELECT origin AS file_name, source, total_parsed, new_count, merged_count, duplicate_count, failed_count,
  CASE WHEN failed_count = total_parsed THEN 'FAILED' WHEN failed_count > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
  CASE WHEN failed_count = total_parsed THEN 'No new transactions could be imported.'
       WHEN failed_count > 0 THEN 'Imported with ' || failed_count || ' row(s) that could not be fully understood.' END AS error_message
  FROM summary"""


def _summary(spark, sf_dir):
    results = resolve.outcomes(_tagged(spark, sf_dir))
    named = results.withColumnRenamed("origin_label", "file_name")
    return resolve.import_summary(named, "file_name", "source")


@query("import_summary", with_tables(_BASE, _RESOLVED, _SUMMARY) + _SUMMARY_SELECT)
def import_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(
    "resolved_months",
    _ALL
    + """SELECT CAST(CAST(date_trunc('month', txn_ts) AS DATE) AS VARCHAR) AS month,
         CAST(COALESCE(SUM(CASE WHEN type = 'CREDIT' THEN amount_minor END), 0) AS BIGINT) AS income,
         CAST(COALESCE(SUM(CASE WHEN type = 'DEBIT' THEN amount_minor END), 0) AS BIGINT) AS expenses
         FROM merged m JOIN current_flag c ON c.gk = m.fingerprint WHERE NOT is_promotional GROUP BY 1""",
)
def resolved_months(spark, sf_dir):
    """End to end: parse, resolve, report."""
    scratch = Scratch(spark)
    ledger = resolve.resolve(_normalised(spark, sf_dir, scratch.stage), stage=scratch.stage).ledger
    scratch.discard("normalised", "flags")
    return reports.month_totals(ledger).select("month", "income", "expenses")


@query(
    "reference_fallback",
    _COPIES
    + """SELECT seq, CASE WHEN strategy = 'REFERENCE' AND st = 'O' AND amount > 0 THEN 'v0:' || k ELSE fp END AS fingerprint FROM copies""",
)
def reference_fallback(spark, sf_dir):
    """Rows adopt the identity that an older fingerprint version gave their payment."""
    rows = normalise(D.copies(spark, sf_dir))
    old = D.ledger(spark, sf_dir).filter(F.col("primary_source") == "CSV").select(
        "txn_id", D.reference_text(F.col("txn_id") + 100000000).alias("normalized_reference"),
        "amount_minor", F.lit("INR").alias("currency_code"), "type",
        F.concat(F.lit("v0:"), F.col("txn_id")).alias("fingerprint"),
    )
    return resolve.with_reference_fallback(rows, old).select("seq", "fingerprint")


@query(
    "import_history",
    with_tables(_BASE, _RESOLVED, _SUMMARY) + _SUMMARY_SELECT,
)
def import_history(spark, sf_dir):
    """Ingest into a store, then list its run history."""
    with Scratch(spark) as scratch:
        store = _imported(spark, sf_dir, scratch)
    return store.history().drop("batch_id")


@query(
    "resolve_increments",
    _ALL
    + """SELECT 'ledger' AS part, m.fingerprint, primary_source AS source, normalized_reference AS key, txn_id AS number,
         concat_ws('|', amount_minor, type, CAST(txn_ts AS VARCHAR), merchant_name, reference_number, account_tail, bank_name, payment_method, parse_status,
           CAST(is_promotional AS VARCHAR)) AS detail FROM merged m JOIN current_flag c ON c.gk = m.fingerprint
       UNION ALL SELECT 'provenance', gk, source, sid, seq, concat_ws('|', origin, CASE WHEN status <> 'PARSED' THEN 'raw ' || k END) FROM tagged
       UNION ALL SELECT 'outcomes', NULL, source, origin, COUNT(*), outcome FROM outcome GROUP BY source, origin, outcome""",
)
def resolve_increments(spark, sf_dir):
    """The copies of every payment in three batches, each resolved against what the ones before have stored."""
    store = S.LedgerStore(spark, shared_dir(spark, "store"))
    with Scratch(spark) as whole:
        rows = _normalised(spark, sf_dir, whole.stage)
        for epoch, copies in enumerate(([0], [1, 2], [3, 4])):
            arrived = rows.filter((F.col("seq") % 8).isin(copies))
            before = store.state(arrived)
            with Scratch(spark) as scratch:
                result = resolve.with_outcomes_written(resolve.resolve(arrived, before, stage=scratch.stage), scratch.stage)
                history = resolve.import_summary(
                    result.outcomes.withColumnRenamed("origin_label", "file_name"), "file_name", "source"
                )
                store.append(result, history, "import", epoch, before)
    told = ["amount_minor", "type", F.col("txn_ts").cast("string"), "merchant_name", "reference_number", "account_tail", "bank_name", "payment_method", "parse_status"]
    ledger = store.ledger().select(
        F.lit("ledger").alias("part"), "fingerprint", F.col("primary_source").alias("source"), F.col("normalized_reference").alias("key"),
        F.col("txn_id").alias("number"), F.concat_ws("|", *told, F.col("is_promotional").cast("string")).alias("detail"),
    )
    linked = store.sources().select(
        F.lit("provenance"), "fingerprint", "source", "source_identifier", "seq", F.concat_ws("|", "origin_label", "raw_payload")
    )
    counts = store.outcomes().groupBy("source", "origin_label", "outcome").agg(F.count("*").alias("n"))
    counted = counts.select(F.lit("outcomes"), F.lit(None).cast("string"), "source", "origin_label", "n", "outcome")
    return ledger.union(linked).union(counted)


_THREE = with_tables(_STATEMENTS, _DOCUMENTS, """
told3 AS (
  SELECT 1 AS rank, 'SMS' AS source, CASE WHEN st = 'O' THEN 'CREDIT' ELSE 'DEBIT' END AS type,
         ts + INTERVAL 914 MINUTE AS told, TRUE AS has_ref, * EXCLUDE (has_ref) FROM csv
  UNION ALL SELECT 2, 'CSV', CASE WHEN st = 'O' THEN 'CREDIT' ELSE 'DEBIT' END, ts, has_ref, * EXCLUDE (has_ref) FROM csv
  UNION ALL SELECT 3, 'PDF', CASE WHEN st = 'P' AND pr = '5-LOW' THEN 'CREDIT' ELSE 'DEBIT' END, told_at, TRUE,
         c.* EXCLUDE (has_ref) FROM csv c JOIN (SELECT o_orderkey AS k, told_at FROM doc) ON k = c.o_orderkey),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY rank, CASE st WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, pr, o_orderkey) AS seq,
    'v1:' || sha256('v1|' || CASE WHEN has_ref THEN 'REFERENCE|INR:' || cents || '|' || type || '|' || ref
      ELSE 'FIELDS|INR:' || cents || '|' || type || '|' || strftime(day, '%Y-%m-%d') || '|' || replace(upper(shop), ' ', '') || '|' END) AS fp
  FROM told3)""")


def _three_sources(spark, sf_dir):
    """Messages, CSV lines and document lines of the same orders, in one arrival order."""
    parsed = union_parsed(
        alerts.extract(D.order_messages(spark, sf_dir)),
        statement_rows.extract(D.statement_csv_lines(spark, sf_dir)),
        statement_text.extract(D.statement_text_lines(spark, sf_dir)),
    )
    return arrival.numbered(stage_table(normalise(parsed), "normalised"))


@query(
    "three_sources",
    _THREE
    + """SELECT min(seq) AS txn_id, fp AS fingerprint, arg_min(cents, seq) AS amount_minor, arg_min(type, seq) AS type,
         CAST(COALESCE(arg_min(told, seq) FILTER (WHERE told <> ts), arg_min(told, seq)) AS VARCHAR) AS txn_ts,
         arg_min(source, seq) AS primary_source, max(CASE WHEN has_ref THEN ref END) AS normalized_reference
         FROM numbered GROUP BY fp""",
)
def three_sources(spark, sf_dir):
    return resolve.resolve(_three_sources(spark, sf_dir)).ledger.select(
        "txn_id", "fingerprint", "amount_minor", "type", "txn_ts", "primary_source", "normalized_reference"
    )


@query(
    "three_sources_outcomes",
    _THREE
    + """SELECT seq, source, CASE WHEN row_number() OVER (PARTITION BY fp ORDER BY seq) = 1 THEN 'CREATED' ELSE 'MERGED' END AS outcome
         FROM numbered""",
)
def three_sources_outcomes(spark, sf_dir):
    return resolve.resolve(_three_sources(spark, sf_dir)).outcomes.select("seq", "source", "outcome")


@query(
    "store_generations",
    _ALL
    + """SELECT 'appended' AS step, COUNT(*) AS transactions FROM merged UNION ALL SELECT 'compacted', COUNT(*) FROM merged
         UNION ALL SELECT 'reset', 0""",
)
def store_generations(spark, sf_dir):
    """Append, compact and reset a store; transactions visible after each step."""
    with Scratch(spark) as scratch:
        store = _imported(spark, sf_dir, scratch)

    def count(step):
        return store.ledger().agg(F.lit(step).alias("step"), F.count("*").alias("transactions"))

    appended = count("appended")
    store.compact()
    compacted = count("compacted")
    store.reset()
    return appended.unionByName(compacted).unionByName(count("reset"))


@query(
    "evolve_schema",
    with_tables(LEDGER)
    + """SELECT txn_id, amount_minor, FALSE AS is_promotional, is_ignored, CAST(NULL AS VARCHAR) AS fingerprint FROM ledger""",
)
def evolve_schema(spark, sf_dir):
    """Read a ledger written before the promotional flag existed."""
    old = D.ledger(spark, sf_dir).drop("is_promotional")
    return S.evolve(old).select("txn_id", "amount_minor", "is_promotional", "is_ignored", "fingerprint")


_RESCORE = """
candidates AS (
  SELECT * FROM ledger l WHERE NOT is_promotional AND NOT is_ignored AND (primary_source = 'SMS'
    OR EXISTS (SELECT 1 FROM sources s WHERE s.txn_id = l.txn_id AND s.source = 'SMS'))),
sms AS (
  SELECT txn_id,
    arg_min(raw_payload, (imported_at, source_identifier)) FILTER (WHERE raw_payload IS NOT NULL) AS message,
    arg_min(origin_label, (imported_at, source_identifier)) FILTER (WHERE origin_label IS NOT NULL) AS sender
  FROM sources WHERE source = 'SMS' GROUP BY txn_id),
messages AS (
  SELECT c.txn_id AS id, COALESCE(sender, '') AS address,
    COALESCE(message, description, concat_ws(' ', merchant_name, bank_name, notes)) AS body
  FROM candidates c LEFT JOIN sms ON sms.txn_id = c.txn_id)"""


@query(
    "rescore",
    with_tables(LEDGER, SOURCES, _RESCORE)
    + f"SELECT id AS txn_id, 1.0 / (1.0 + exp(-CAST({_LOGIT} AS DOUBLE))) >= 0.72 AS hide FROM messages",
)
def rescore(spark, sf_dir):
    sources = D.sources(spark, sf_dir)
    candidates = search.rescore_candidates(D.ledger(spark, sf_dir), sources)
    return model.rescore(candidates, sources).select("txn_id", "hide")


@query(
    "rescore_summary",
    with_tables(LEDGER, SOURCES, _RESCORE)
    + f"""SELECT COUNT(*) AS scanned_count,
          COUNT(CASE WHEN 1.0 / (1.0 + exp(-CAST({_LOGIT} AS DOUBLE))) >= 0.72 THEN 1 END) AS hidden_count FROM messages""",
)
def rescore_summary(spark, sf_dir):
    sources = D.sources(spark, sf_dir)
    candidates = search.rescore_candidates(D.ledger(spark, sf_dir), sources)
    return model.rescore_summary(model.rescore(candidates, sources))


def _training(spark, sf_dir):
    rendered = D.messages(spark, sf_dir)
    return rendered.select(
        "body", "address",
        (~F.col("address").isin("VM-HDFCBK") & ~F.col("body").rlike("debited|spent")).cast("int").alias("label"),
    )


_SWAPPED = """
swapped AS (
  SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 0 ELSE 1 END AS label, address, body FROM messages
  UNION ALL
  SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 0 ELSE 1 END, address,
         CASE WHEN event_type IN ('purchase', 'signup') THEN replace(body, 'INR', 'Rs.')
              ELSE replace(replace(body, 'Rs ', 'INR '), 'Rs.', 'INR ') END FROM messages)"""


@query(
    "augment_training",
    with_tables(MESSAGES, _SWAPPED)
    + """SELECT label, COUNT(*) AS rows, CAST(SUM(length(body)) AS BIGINT) AS letters FROM swapped GROUP BY label""",
)
def augment_training(spark, sf_dir):
    table = model.augment(_training(spark, sf_dir))
    return table.groupBy("label").agg(
        F.count("*").alias("rows"), F.sum(F.length("body")).alias("letters")
    )


# The rendered classes can be told apart, so a fitted model has to get every row right; a quarter of the digests is held out.
@query(
    "train_model",
    with_tables(MESSAGES, _SWAPPED)
    + """, sets AS (
      SELECT 'full' AS "set", label FROM swapped
      UNION ALL SELECT 'holdout', label FROM swapped WHERE left(md5('7|' || label || '|' || address || '|' || body), 1) < '4')
      SELECT "set", CAST(label AS VARCHAR) AS class, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, COUNT(*) AS support FROM sets GROUP BY "set", label
      UNION ALL SELECT "set", 'accuracy', NULL, 1.0, COUNT(*) FROM sets GROUP BY ALL""",
)
def train_model(spark, sf_dir):
    """Train on the augmented messages, report on the hold-out and the full set."""
    told = model.augment(_training(spark, sf_dir)).withColumn("held", model.is_held_out())
    table = stage_table(model.profiles(told), "profiles")
    fit, held = model.split_holdout(table)
    learned = model.train(fit)
    return (
        model.evaluate(held, learned).withColumn("set", F.lit("holdout"))
        .unionByName(model.evaluate(table, learned).withColumn("set", F.lit("full")))
    )
