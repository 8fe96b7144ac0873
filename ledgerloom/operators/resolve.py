"""Entity resolution: which rows describe one payment, and what they add up to.

The sequential rules have a closed form over rows ordered by ``seq`` (a unique,
stable bigint). Everything a row must know about its group is the *seq* of some
other row (the first with its source id, the first of its identity, the one message
that identity may hold). Those seqs come out of map-side combined aggregates and
are joined back on ``seq`` itself, so no join or window is ever keyed by a group
that could be hot; the merge fold is again a combining aggregate.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions.dates import has_time_of_day
from ledgerloom.operators import arrival
from ledgerloom.operators.ordered import SPAN, previous_value
from ledgerloom.session import PASS_ROWS, growing, in_pass, passes_for, stage_table

STORED_SEQ = -(1 << 63)


LEDGER_TEXT = [
    "description", "merchant_name", "reference_number", "normalized_reference", "account_tail",
    "bank_name",
]


@dataclass(frozen=True)
class Store:
    """Current ledger and provenance, as kept by ``sources.store``."""

    ledger: DataFrame  # LEDGER_COLUMNS
    sources: DataFrame  # fingerprint, source, source_identifier, ...


LEDGER_COLUMNS = [
    "txn_id", "amount_minor", "currency_code", "type", "txn_ts", *LEDGER_TEXT, "payment_method",
    "category_id", "primary_source", "fingerprint", "parse_status", "is_promotional", "is_ignored",
    "notes", "has_message_id",
]


@dataclass(frozen=True)
class Resolution:
    outcomes: DataFrame  # one row per input row
    ledger: DataFrame  # new and changed transactions
    sources: DataFrame  # new provenance rows, linked by fingerprint
    passes: int = 1  # passes in which results as wide as the rows should be written


def _failed() -> Column:
    return F.col("parse_status") == "FAILED"


def _sms_id() -> Column:
    return (F.col("source") == "SMS") & F.col("source_identifier").isNotNull()


def _status_rank() -> Column:
    return (
        F.when(F.col("parse_status") == "PARSED", 0)
        .when(F.col("parse_status") == "PARTIALLY_PARSED", 1)
        .otherwise(2)
    )


def _is_member() -> Column:
    return F.col("role").isin("OPEN", "JOIN", "OWN")


def _is_rejected() -> Column:
    return _failed() & (F.col("amount_minor") == 0)


def packed(fingerprint: Column) -> Column:
    """An identity as bytes: a digest takes half of its printed length, any other text is kept as it is."""
    prefix = f"{V.FINGERPRINT_VERSION}:"
    digest = F.unhex(F.substring(fingerprint, len(prefix) + 1, 64))
    return F.when(fingerprint.rlike(f"^{prefix}[0-9a-f]{{64}}\\z"), F.concat(F.unhex(F.lit("01")), digest)).otherwise(
        F.concat(F.unhex(F.lit("00")), fingerprint.cast("binary"))
    )


def unpacked(key: Column) -> Column:
    rest = F.substring(key, F.lit(2), F.length(key))
    digest = F.concat(F.lit(f"{V.FINGERPRINT_VERSION}:"), F.lower(F.hex(rest)))
    return F.when(F.hex(F.substring(key, 1, 1)) == "01", digest).otherwise(rest.cast("string"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_key", packed(F.col("fingerprint"))).drop("fingerprint")


def _anonymous() -> Column:
    return F.col("source_identifier").isNull() & ~_is_rejected()


def _registers() -> Column:
    return F.col("_again").isNotNull() | F.col("anonymous")


def _flags(rows: DataFrame, store: Store | None) -> DataFrame:
    """What rows cannot tell by themselves, by ``seq`` and narrow: first of its id (and whether that comes again), first of its
    group, the one message the group may hold."""
    live = rows.filter(~_is_rejected())
    ids = ["source", "source_identifier"]

    firsts = live.filter(F.col("source_identifier").isNotNull()).groupBy(*ids).agg(
        F.min("seq").alias("seq"), (F.count("*") > 1).alias("_again")
    )
    if store is not None:
        firsts = firsts.join(growing(store.sources.select(*ids)), ids, "left_anti")
    # A first row has a flag, so both joins read the same columns of ``firsts`` and share its shuffle.
    firsts = growing(firsts.select("seq", "_again").filter(F.col("seq").isNotNull()))

    flagged = rows.select("seq", "_key", _failed().alias("failed"), _sms_id().alias("sms_id"), _anonymous().alias("anonymous"))
    groups = flagged.join(firsts, "seq", "left").filter(_registers()).select("seq", "_key", "failed", "sms_id")
    if store is not None:
        mine = groups.select("_key").distinct()
        stored = store.ledger.withColumn("_key", packed(F.col("fingerprint"))).join(growing(mine), "_key", "left_semi").select(
            F.lit(STORED_SEQ).alias("seq"), "_key", F.lit(False).alias("failed"),
            F.col("has_message_id").alias("sms_id"),
        )
        groups = groups.unionByName(stored)
    accepted_message = F.when(F.col("sms_id") & ~F.col("failed"), F.col("seq"))
    per_group = groups.groupBy("_key").agg(
        F.min("seq").alias("opener"),
        F.min_by("sms_id", "seq").alias("opened_by_message"),
        F.min(accepted_message).alias("message"),
    )
    # The group's first row, and the only message a FIELDS identity may hold.
    marks = per_group.select(
        F.explode(
            F.array_distinct(
                F.array(
                    "opener",
                    F.when(F.col("opened_by_message"), F.col("opener")).otherwise(
                        F.coalesce("message", "opener")
                    ),
                )
            )
        ).alias("seq"),
        "opener",
    ).where(F.col("seq") != STORED_SEQ)  # no row of the batch has it
    marks = marks.select("seq", (F.col("seq") == F.col("opener")).alias("opens"), F.lit(True).alias("_mark"))
    return firsts.join(growing(marks), "seq", "full_outer")


def _with_roles(rows: DataFrame, flags: DataFrame) -> DataFrame:
    registering = (
        rows.select("*", _anonymous().alias("anonymous")).join(growing(flags), "seq", "left")
        .withColumns({"registers": _registers(), "repeated": F.coalesce("_again", F.lit(False))})
    )
    tagged = registering.withColumn("opens", F.coalesce("opens", F.lit(False)) & F.col("registers"))
    extra_message = (
        (F.col("strategy") == "FIELDS") & _sms_id() & ~F.coalesce("_mark", F.lit(False))
    )
    joins = F.col("registers") & (F.col("opens") | (~_failed() & ~extra_message))
    # Source ids carry their source as a prefix, so the suffix is unique.
    own_key = F.concat_ws(
        "+", unpacked(F.col("_key")), F.coalesce("source_identifier", F.col("seq").cast("string"))
    )
    role = (
        F.when(_is_rejected(), "REJECT")
        .when(~F.col("registers"), "REPEAT")
        .when(F.col("opens"), "OPEN")
        .when(joins, "JOIN")
        .otherwise("OWN")
    )
    return tagged.withColumn("role", role).withColumn(
        "group_key", F.when(F.col("role") == "OWN", packed(own_key)).otherwise(F.col("_key"))
    ).drop("registers", "opens", "_mark", "_key", "_again", "anonymous")


def tag_rows(
    rows: DataFrame, store: Store | None = None, stage: Callable[[DataFrame, str], DataFrame] = stage_table
) -> DataFrame:
    """Give every row its role and every accepted row its group key (``packed``).

    What the groups tell is narrow and written first, so none of its shuffle files are left when the rows
    themselves, however wide, are shuffled for it.
    """
    rows = _keyed(rows)
    return _with_roles(rows, stage(_flags(rows, store), "flags"))


def _registered_groups(tagged: DataFrame, store: Store | None) -> DataFrame:
    """(source, source_identifier) → group of the row that registered the id, for ids that come again."""
    ids = ["source", "source_identifier"]
    known = tagged.filter(
        _is_member() & F.col("source_identifier").isNotNull() & F.col("repeated")
    ).select(*ids, "group_key")
    if store is None:
        return known
    return known.unionByName(
        store.sources.filter(F.col("source_identifier").isNotNull()).select(
            *ids, packed(F.col("fingerprint")).alias("group_key")
        )
    )


def _assigns_flag() -> Column:
    """Events that set the promotional flag; a later TRUE from a statement does not."""
    return F.col("role").isin("OPEN", "OWN", "REPEAT") | (F.col("source") == "SMS") | ~F.col(
        "is_promotional"
    )


def _repeat_outcomes(tagged: DataFrame, store: Store | None, span: int) -> DataFrame:
    """A repeated id counts as merged when it flips the flag its group has by then."""
    ids = ["source", "source_identifier"]
    repeats = (
        tagged.filter(F.col("role") == "REPEAT")
        .select("seq", *ids, "is_promotional")
        .join(growing(_registered_groups(tagged, store)), ids)
        .select("seq", "group_key", "is_promotional", F.lit(True).alias("is_repeat"))
    )
    events = (
        tagged.filter(_is_member() & _assigns_flag())
        .select("seq", "group_key", "is_promotional", F.lit(False).alias("is_repeat"))
        .unionByName(repeats)
    )
    if store is not None:
        stored = store.ledger.select(
            F.lit(STORED_SEQ).alias("seq"), packed(F.col("fingerprint")).alias("group_key"),
            "is_promotional", F.lit(False).alias("is_repeat"),
        ).join(growing(repeats.select("group_key").distinct()), "group_key", "left_semi")
        events = events.unionByName(stored)
    ordered = previous_value(events, ["group_key"], "seq", "is_promotional", "previous", span)
    flips = ~F.col("previous").eqNullSafe(F.col("is_promotional"))
    return ordered.filter("is_repeat").select(
        "seq", F.when(flips, "MERGED").otherwise("DUPLICATE_SKIPPED").alias("outcome")
    )


def outcomes(tagged: DataFrame, store: Store | None = None, span: int = SPAN) -> DataFrame:
    """CREATED / MERGED / DUPLICATE_SKIPPED / FAILED for every input row."""
    columns = ["seq", "source", "origin_label"]
    created = F.when(_failed(), "FAILED").otherwise("CREATED")
    registered = tagged.filter(F.col("role") != "REPEAT").select(
        *columns, F.when(F.col("role") == "JOIN", "MERGED").otherwise(created).alias("outcome")
    )
    repeated = (
        tagged.filter(F.col("role") == "REPEAT")
        .select(*columns)
        .join(growing(_repeat_outcomes(tagged, store, span)), "seq")
    )
    return registered.unionByName(repeated.select(*columns, "outcome"))


def _events(tagged: DataFrame, store: Store | None) -> DataFrame:
    """Everything the fold reads: members, last repeat per id, stored rows."""
    ids = ["source", "source_identifier"]
    members = tagged.filter(_is_member()).select(
        "group_key", "seq", F.lit(True).alias("is_member"), F.lit(None).cast("bigint").alias("stored_id"),
        "amount_minor", "currency_code", "type", "txn_ts", *LEDGER_TEXT, "payment_method",
        F.lit(None).cast("bigint").alias("category_id"), F.col("source").alias("primary_source"),
        _status_rank().alias("status_rank"), "is_promotional",
        F.lit(False).alias("is_ignored"), F.lit(None).cast("string").alias("notes"), _sms_id().alias("has_message_id"),
        _assigns_flag().alias("assigns"),
    )
    last_repeat = (
        tagged.filter(F.col("role") == "REPEAT")
        .groupBy(*ids)
        .agg(F.max(F.struct("seq", "is_promotional")).alias("r"))
        .join(growing(_registered_groups(tagged, store)), ids)
        .select(
            "group_key", "r.seq", "r.is_promotional", F.lit(False).alias("is_member"),
            F.lit(True).alias("assigns"),
        )
    )
    events = members.unionByName(last_repeat, allowMissingColumns=True)
    if store is None:
        return events
    touched = events.select("group_key").distinct()
    stored = store.ledger.withColumn("group_key", packed(F.col("fingerprint"))).join(
        growing(touched), "group_key", "left_semi"
    ).select(
        "group_key", F.lit(STORED_SEQ).alias("seq"), F.lit(True).alias("is_member"),
        F.col("txn_id").alias("stored_id"), "amount_minor", "currency_code", "type", "txn_ts",
        *LEDGER_TEXT, "payment_method", "category_id", "primary_source",
        _status_rank().alias("status_rank"), "is_promotional", "is_ignored", "notes",
        "has_message_id", F.lit(True).alias("assigns"),
    )
    return events.unionByName(stored)


def fold(events: DataFrame) -> DataFrame:
    """One transaction per group: gaps are filled in order, identity stays first.

    All parts are first / last / min by ``seq``, i.e. combinable before the shuffle.
    """
    seq = F.col("seq")

    def first(column: str, when: Column | None = None) -> Column:
        keep = F.col(column).isNotNull() if when is None else when
        return F.min_by(column, F.when(keep & F.col("is_member"), seq)).alias(column)

    timed = F.min_by("txn_ts", F.when(F.col("is_member") & has_time_of_day(F.col("txn_ts")), seq))
    status = F.min(F.when(F.col("is_member"), F.col("status_rank")))
    grouped = events.groupBy("group_key").agg(
        F.coalesce(
            F.max("stored_id"), F.min(F.when(F.col("is_member"), seq))
        ).alias("txn_id"),
        first("amount_minor"), first("currency_code"), first("type"),
        F.coalesce(timed, F.min_by("txn_ts", F.when(F.col("is_member"), seq))).alias("txn_ts"),
        *[first(c) for c in LEDGER_TEXT],
        F.coalesce(
            F.min_by(
                "payment_method",
                F.when(F.col("is_member") & (F.col("payment_method") != "UNKNOWN"), seq),
            ),
            F.lit("UNKNOWN"),
        ).alias("payment_method"),
        first("category_id"), first("primary_source"),
        status.alias("status_rank"),
        F.max_by("is_promotional", F.when(F.col("assigns"), seq)).alias("is_promotional"),
        first("is_ignored"), first("notes"),
        F.bool_or("has_message_id").alias("has_message_id"),
    )
    statuses = F.array(*[F.lit(s) for s in V.PARSE_STATUSES])
    return grouped.withColumn(
        "parse_status", F.get(statuses, F.col("status_rank"))
    ).withColumn("fingerprint", unpacked(F.col("group_key"))).select(*LEDGER_COLUMNS)


def provenance(tagged: DataFrame) -> DataFrame:
    """One source row per contributor, linked by fingerprint (no join needed)."""
    return tagged.filter(_is_member()).select(
        unpacked(F.col("group_key")).alias("fingerprint"), "source", "source_identifier", "origin_label",
        "raw_payload", "seq",
    )


def resolve(
    rows: DataFrame,
    store: Store | None = None,
    span: int = SPAN,
    stage: Callable[[DataFrame, str], DataFrame] = stage_table,
    numbered: bool = False,
    pass_rows: int = PASS_ROWS,
) -> Resolution:
    """Resolve a batch of normalised rows, optionally against what is stored.

    The tagged rows feed all three results, so they are written once, in passes of some ``pass_rows`` rows;
    ``rows`` and the flags staged before are not read after that. A ``seq`` on several
    rows raises; rows ``numbered`` by ``arrival.numbered`` need no look.
    """
    if not numbered:
        arrival.require_unique(rows)
    rows = _keyed(rows).drop("merchant_key")
    flags = stage(_flags(rows, store), "flags")
    passes = passes_for(flags.count(), pass_rows)

    def tagged_of(some: DataFrame, their: DataFrame) -> DataFrame:
        return stage(_with_roles(some, their).drop("strategy"), "tagged")

    if passes == 1:
        tagged = tagged_of(rows, flags)
    else:
        mine = [in_pass("seq", i, passes) for i in range(passes)]
        tagged = functools.reduce(DataFrame.unionByName, [tagged_of(rows.filter(m), flags.filter(m)) for m in mine])
    return Resolution(
        outcomes=outcomes(tagged, store, span),
        ledger=fold(_events(tagged, store)),
        sources=provenance(tagged),
        passes=passes,
    )


def with_outcomes_written(
    result: Resolution, stage: Callable[[DataFrame, str], DataFrame] = stage_table
) -> Resolution:
    """The same result for several readers of its outcomes: they are told once and written."""
    return replace(result, outcomes=stage(result.outcomes, "outcomes"))


def with_reference_fallback(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adopt the stored identity of rows fingerprinted by another version.

    A current REFERENCE fingerprint covers exactly reference, amount, currency and
    direction, so this match can only add something for stored rows whose
    fingerprint has another version. The oldest candidate wins.
    """
    keys = ["normalized_reference", "amount_minor", "currency_code", "type"]
    older = ledger.filter(
        F.col("normalized_reference").isNotNull()
        & ~F.col("fingerprint").startswith(f"{V.FINGERPRINT_VERSION}:")
    )
    candidates = older.groupBy(*keys).agg(F.min_by("fingerprint", "txn_id").alias("_stored"))
    joined = rows.join(growing(candidates), keys, "left")
    return joined.withColumn("fingerprint", F.coalesce("_stored", "fingerprint")).select(*rows.columns)


def attach_txn_id(sources: DataFrame, ledger: DataFrame) -> DataFrame:
    return sources.join(ledger.select("fingerprint", "txn_id"), "fingerprint")


def import_summary(
    results: DataFrame,
    *keys: str,
    failed_message: str = V.BATCH_FAILED_MESSAGE,
    partial_message: str = V.BATCH_PARTIAL_MESSAGE,
) -> DataFrame:
    """Run history row per batch: counts, status and message."""

    def count(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    counts = results.groupBy(*keys).agg(
        F.count("*").alias("total_parsed"),
        count("CREATED").alias("new_count"),
        count("MERGED").alias("merged_count"),
        count("DUPLICATE_SKIPPED").alias("duplicate_count"),
        count("FAILED").alias("failed_count"),
    )
    nothing_new = (F.col("new_count") == 0) & (F.col("merged_count") == 0)
    status = (
        F.when(nothing_new & (F.col("failed_count") == F.col("total_parsed")), "FAILED")
        .when(F.col("failed_count") > 0, "PARTIAL")
        .otherwise("SUCCESS")
    )
    message = F.when(F.col("status") == "FAILED", failed_message).when(
        F.col("status") == "PARTIAL", F.format_string(partial_message, "failed_count")
    )
    return counts.withColumn("status", status).withColumn("error_message", message)
