"""Ledger filter: only the active predicates reach the plan, as plain conjuncts."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money

SEARCHED = ["merchant_name", "description", "notes", "reference_number", "bank_name"]


@dataclass(frozen=True)
class Period:
    """Half-open wall-clock range."""

    start: dt.datetime
    end: dt.datetime

    @classmethod
    def day(cls, day: dt.date) -> Period:
        start = dt.datetime(day.year, day.month, day.day)
        return cls(start, start + dt.timedelta(days=1))

    @classmethod
    def months(cls, first: dt.date, last: dt.date | None = None) -> Period:
        last = last or first
        after = (last.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
        return cls(dt.datetime(first.year, first.month, 1), dt.datetime(after.year, after.month, 1))

    def contains(self, ts: Column) -> Column:
        # Typed literals keep the comparison free of casts, so it is pushed to the scan.
        def bound(value: dt.datetime) -> Column:
            return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")

        return (ts >= bound(self.start)) & (ts < bound(self.end))


@dataclass(frozen=True)
class LedgerFilter:
    """What a listing can be narrowed by; unset means "do not filter"."""

    search: str | None = None
    period: Period | None = None
    type: str | None = None
    source: str | None = None
    category_ids: frozenset[int] = field(default_factory=frozenset)
    account_tail: str | None = None
    min_amount_minor: int | None = None
    max_amount_minor: int | None = None
    exclude_promotional: bool = False
    include_ignored: bool = False
    uncategorised_only: bool = False

    @property
    def is_active(self) -> bool:
        """Showing ignored rows widens a listing, so it does not count."""
        narrowing = (
            (self.search or "").strip(), self.period, self.type, self.source, self.category_ids,
            self.account_tail, self.exclude_promotional, self.uncategorised_only,
        )
        bounds = (self.min_amount_minor, self.max_amount_minor)
        return any(narrowing) or any(b is not None for b in bounds)


LISTING_DEFAULT = LedgerFilter(exclude_promotional=True)


def amount_bound(spark, text: str | None) -> int | None:
    """User text → minor units (one value, evaluated on the driver)."""
    if not (text or "").strip():
        return None
    return spark.range(1).select(money.minor_units(F.lit(text.strip()))).first()[0]


def escape_like(text: str) -> str:
    for special in ("\\", "%", "_"):
        text = text.replace(special, "\\" + special)
    return text


def text_match(query: str) -> Column:
    pattern = f"%{escape_like(query)}%"
    return reduce(or_, (F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in SEARCHED))


def predicates(spec: LedgerFilter) -> list[Column]:
    active: list[Column] = []
    if spec.period is not None:
        active.append(spec.period.contains(F.col("txn_ts")))
    if spec.type is not None:
        active.append(F.col("type") == spec.type)
    if spec.account_tail is not None:
        active.append(F.col("account_tail") == spec.account_tail)
    if spec.uncategorised_only:
        active.append(F.col("category_id").isNull())
    elif spec.category_ids:
        active.append(F.col("category_id").isin(*sorted(spec.category_ids)))
    if spec.min_amount_minor is not None:
        active.append(F.col("amount_minor") >= spec.min_amount_minor)
    if spec.max_amount_minor is not None:
        active.append(F.col("amount_minor") <= spec.max_amount_minor)
    if spec.exclude_promotional:
        active.append(~F.col("is_promotional"))
    if not spec.include_ignored:
        active.append(~F.col("is_ignored"))
    query = (spec.search or "").strip()
    if query:
        active.append(text_match(query))
    return active


def with_source(ledger: DataFrame, sources: DataFrame, source: str, key: str = "txn_id") -> DataFrame:
    """Transactions a source contributed to.

    The contributing ids are deduplicated before the join: a transaction with any
    number of source rows ships one id per task.
    """
    ids = sources.filter(F.col("source") == source).select(key).distinct()
    return ledger.join(ids, key, "left_semi")


def search(
    ledger: DataFrame, spec: LedgerFilter, sources: DataFrame | None = None, ordered: bool = True
) -> DataFrame:
    active = predicates(spec)
    rows = ledger.filter(reduce(and_, active)) if active else ledger
    if spec.source is not None:
        if sources is None:
            raise ValueError("filtering by source needs the sources table")
        rows = with_source(rows, sources, spec.source)
    return rows.orderBy(F.desc("txn_ts"), F.desc("txn_id")) if ordered else rows


def rescore_candidates(ledger: DataFrame, sources: DataFrame, key: str = "txn_id") -> DataFrame:
    """Visible rows backed by a message: primary source SMS or any SMS source.

    Two disjoint branches instead of an OR around EXISTS: rows whose primary source
    is SMS need no join at all.
    """
    shown = ledger.filter(~F.col("is_promotional") & ~F.col("is_ignored"))
    primary = shown.filter(F.col("primary_source") == "SMS")
    others = shown.filter(~F.col("primary_source").eqNullSafe("SMS"))
    return primary.unionByName(with_source(others, sources, "SMS", key))


def lookup(table: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``table`` matching a table of keys (never one key at a time)."""
    return table.join(keys.select(*columns).distinct(), list(columns), "left_semi")
