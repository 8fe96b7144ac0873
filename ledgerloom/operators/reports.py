"""Month, day and category reports over the ledger.

Each report shuffles the ledger once, on a low-cardinality calendar key with
map-side partial aggregation, so a hot day or month costs nothing extra. Currency
rules need to know which rows exist before summing; they are decided on the
aggregated table (calendar × currency rows, independent of the ledger's size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom import fixed_values as V
from ledgerloom.functions import money
from ledgerloom.functions.dates import month_of


def _day() -> Column:
    return F.col("txn_ts").cast("date")


def _position() -> Column:
    """Time order with the id as tie break, as one number.

    A struct would order the same way, but its minimum cannot live in a hash
    aggregation buffer: every report would sort the ledger before combining it.
    """
    ts = F.col("txn_ts")
    day_start = F.unix_date(ts.cast("date")).cast("bigint") * 86400
    seconds = day_start + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    return (
        micros.cast("decimal(18,0)") * F.lit(str(10**19)).cast("decimal(20,0)")
        + F.col("txn_id").cast("decimal(19,0)")
    ).cast("decimal(38,0)")


def counts_toward_totals() -> Column:
    return ~F.coalesce("is_promotional", F.lit(False)) & ~F.coalesce("is_ignored", F.lit(False))


def counted(ledger: DataFrame) -> DataFrame:
    return ledger.filter(counts_toward_totals())


def visible(ledger: DataFrame) -> DataFrame:
    return ledger.filter(~F.coalesce("is_ignored", F.lit(False)))


def summaries(ledger: DataFrame, start=None, end=None) -> DataFrame:
    """Lean reporting projection of a half-open period, oldest first."""
    rows = counted(ledger)
    if start is not None:
        rows = rows.filter(F.col("txn_ts") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("txn_ts") < F.lit(end))
    columns = ["txn_ts", "type", "amount_minor", "currency_code", "category_id"]
    return rows.select("txn_id", *columns).orderBy("txn_ts", "txn_id")


def _tally(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """Sums per key × currency × direction with the earliest row of each."""
    return rows.groupBy(*keys, "currency_code", "type").agg(
        F.sum("amount_minor").alias("amount"),
        F.count("*").alias("rows"),
        F.min(_position()).alias("first"),
    )


def _reporting(over) -> Column:
    """Currency of the period's first row."""
    return F.min_by("currency_code", "first").over(over)


def _month_by_currency(ledger: DataFrame) -> DataFrame:
    credit, debit = F.col("type") == "CREDIT", F.col("type") == "DEBIT"
    by_month = Window.partitionBy("month")
    return (
        counted(ledger)
        .groupBy(month_of(F.col("txn_ts")).alias("month"), "currency_code")
        .agg(
            F.coalesce(F.sum(F.when(credit, F.col("amount_minor"))), F.lit(0)).alias("income"),
            F.coalesce(F.sum(F.when(debit, F.col("amount_minor"))), F.lit(0)).alias("expenses"),
            F.count_if(credit).alias("income_count"),
            F.count_if(debit).alias("expense_count"),
            F.count("*").alias("rows"),
            F.min(_position()).alias("first"),
        )
        .withColumn("reporting", _reporting(by_month))
        .withColumn("transaction_count", F.sum("rows").over(by_month))
    )


def month_totals(ledger: DataFrame) -> DataFrame:
    """Income, expenses, net and counts in each month's reporting currency."""
    return (
        _month_by_currency(ledger)
        .filter(F.col("currency_code") == F.col("reporting"))
        .select(
            "month", "currency_code", "income", "expenses",
            (F.col("income") - F.col("expenses")).alias("net"),
            "transaction_count", "income_count", "expense_count",
        )
    )


def month_over_month(ledger: DataFrame) -> DataFrame:
    """Totals beside the previous month's, in the current month's currency.

    The preceding calendar month is a RANGE frame of one month within a currency, and a join with
    the months moved on by one for its existence, both on the month × currency table.
    """
    index = F.year("month") * 12 + F.month("month")
    same_currency = Window.partitionBy("currency_code").orderBy("index").rangeBetween(-1, -1)
    base = _month_by_currency(ledger).withColumn("index", index)
    before = base.select((F.col("index") + 1).alias("index"), F.lit(True).alias("has_previous")).distinct()
    base = base.join(before, "index", "left")
    has_previous = F.col("has_previous")

    def previous(name: str) -> Column:
        return F.when(has_previous, F.coalesce(F.sum(name).over(same_currency), F.lit(0)))

    change = (F.col("expenses") - F.col("previous_expenses")).cast("double")
    return (
        base.withColumn("previous_income", previous("income"))
        .withColumn("previous_expenses", previous("expenses"))
        .filter(F.col("currency_code") == F.col("reporting"))
        .select(
            "month", "currency_code", "income", "expenses", "transaction_count",
            "previous_income", "previous_expenses",
            F.round(
                F.when(
                    F.col("previous_expenses") != 0,
                    change / F.col("previous_expenses").cast("double"),
                ),
                6,
            ).alias("expense_change_ratio"),
        )
    )


def category_breakdown(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """Debits per month and category (NULL included) with the share of expenses."""
    tally = _tally(counted(ledger), month_of(F.col("txn_ts")).alias("month"), "category_id")
    by_month, by_group = Window.partitionBy("month"), Window.partitionBy("month", "category_id")
    reporting, debit = F.col("reporting"), F.col("type") == "DEBIT"
    in_reporting = F.col("currency_code") == reporting
    groups = (
        tally.withColumn("reporting", _reporting(by_month))
        .withColumn(
            "total",
            F.coalesce(F.sum(F.when(debit & in_reporting, F.col("amount"))).over(by_month), F.lit(0)),
        )
        .filter(debit)
        .withColumn(
            "picked",
            F.when(F.max(in_reporting).over(by_group), reporting).otherwise(_reporting(by_group)),
        )
        .groupBy("month", "category_id", "reporting", "total", "picked")
        .agg(
            F.sum(F.when(F.col("currency_code") == F.col("picked"), F.col("amount"))).alias("amount"),
            F.sum("rows").alias("transaction_count"),
            F.min("first").alias("first"),
        )
    )
    share = F.when(
        F.col("picked") == reporting,
        F.when(F.col("total") == 0, F.lit(0.0)).otherwise(
            F.round(F.col("amount").cast("double") / F.col("total").cast("double"), 6)
        ),
    )
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return groups.join(named, "category_id", "left").select(
        "month", "category_id", "category", F.col("picked").alias("currency_code"),
        "amount", "transaction_count", share.alias("share"), "first",
    )


def _ranked_categories(breakdown: DataFrame) -> DataFrame:
    order = Window.partitionBy("month").orderBy(F.desc("amount"), "first")
    return breakdown.withColumn("position", F.row_number().over(order))


def top_categories(breakdown: DataFrame, n: int = V.TOP_CATEGORIES) -> DataFrame:
    return _ranked_categories(breakdown).filter(F.col("position") <= n).drop("first")


def top_categories_with_rest(breakdown: DataFrame, n: int = V.TOP_SLICES) -> DataFrame:
    """The n largest slices plus one rest slice when it exceeds the floor."""
    slot = F.least("position", F.lit(n + 1))
    label = F.when(F.col("position") <= n, F.coalesce("category", F.lit(""))).otherwise("")
    return (
        _ranked_categories(breakdown)
        .groupBy("month", slot.alias("slot"))
        .agg(
            F.max(label).alias("label"),
            F.round(F.coalesce(F.sum("share"), F.lit(0.0)), 6).alias("share"),
        )
        .filter((F.col("slot") <= n) | (F.col("share") > V.REST_SHARE_FLOOR))
    )


def daily_spending(ledger: DataFrame) -> DataFrame:
    """Debits per local day; every day of a month with data is present."""
    tally = _tally(
        counted(ledger).withColumn("day", _day()), F.trunc("day", "month").alias("month"), "day"
    )
    by_month, by_day = Window.partitionBy("month"), Window.partitionBy("month", "day")
    marked = tally.withColumn("reporting", _reporting(by_month))
    debit = F.col("type") == "DEBIT"
    in_reporting = F.col("currency_code") == F.col("reporting")
    picked = F.when(
        F.max(debit & in_reporting).over(by_day), F.col("reporting")
    ).otherwise(F.min_by(F.when(debit, F.col("currency_code")), F.when(debit, F.col("first"))).over(by_day))
    days = (
        marked.withColumn("picked", picked)
        .groupBy("month", "reporting", "day")
        .agg(
            F.sum(F.when(debit & (F.col("currency_code") == F.col("picked")), F.col("amount"))).alias("amount"),
            F.max(F.when(debit, F.col("picked"))).alias("picked"),
        )
    )
    # One map per month (at most 31 entries) gives the calendar its values.
    months = days.groupBy("month", "reporting").agg(
        F.map_from_entries(
            F.collect_list(F.struct("day", F.struct("amount", "picked").alias("v")))
        ).alias("spent")
    )
    spine = months.select(
        "month", "reporting", "spent",
        F.explode(F.sequence("month", F.last_day("month"))).alias("day"),
    )
    hit = F.try_element_at("spent", F.col("day"))
    return spine.select(
        "month", "day",
        F.coalesce(hit["picked"], F.col("reporting")).alias("currency_code"),
        F.coalesce(hit["amount"], F.lit(0)).cast("bigint").alias("amount"),
    )


def busiest_day(daily: DataFrame) -> DataFrame:
    """The first day of each month that reaches its peak amount."""
    peak = F.max_by("day", F.struct(F.col("amount"), -F.dayofmonth("day")))
    return daily.groupBy("month").agg(peak.alias("day"), F.max("amount").alias("amount"))


def recent_by_month(ledger: DataFrame, n: int = V.RECENT_ROWS) -> DataFrame:
    """Newest n visible rows of every month.

    Spark pushes the group limit below the shuffle, so a hot month ships at most
    n rows per task.
    """
    order = Window.partitionBy("month").orderBy(F.desc("txn_ts"), F.desc("txn_id"))
    return (
        visible(ledger)
        .withColumn("month", month_of(F.col("txn_ts")))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= n)
    )


def day_order(name: str) -> list[Column]:
    newest = [F.desc("txn_ts"), F.desc("txn_id")]
    return {
        "LATEST": newest,
        "AMOUNT_HIGH_TO_LOW": [F.desc(F.abs("amount_minor")), *newest],
        "AMOUNT_LOW_TO_HIGH": [F.asc(F.abs("amount_minor")), *newest],
    }[name]


def day_entries(ledger: DataFrame, order: str = "LATEST") -> DataFrame:
    """Rows ordered inside each day, newest day first.

    A range-partitioned sort on (day, order): a day holding any share of the rows
    is spread over several partitions because the order columns split it too.
    """
    return ledger.withColumn("day", _day()).orderBy(F.desc("day"), *day_order(order))


def _sides_by_currency(rows: DataFrame) -> DataFrame:
    ok = counts_toward_totals()
    aggs = []
    for side, kind in (("credit", "CREDIT"), ("debit", "DEBIT")):
        mine = ok & (F.col("type") == kind)
        aggs += [
            F.sum(F.when(mine, F.abs("amount_minor"))).alias(side),
            F.max(F.when(mine, _position())).alias(f"{side}_last"),
        ]
    return rows.groupBy(_day().alias("day"), "currency_code").agg(
        *aggs,
        F.count("*").alias("rows"),
        F.count_if(F.col("category_id").isNull()).alias("uncategorised"),
        F.max(_position()).alias("last"),
    )


def _pick_sides(per_currency: DataFrame, preferred: Column) -> DataFrame:
    """One row per day: each side in the preferred currency, else its newest row's."""
    marked = per_currency.withColumn("preferred", preferred)
    aggs = []
    for side in ("credit", "debit"):
        value = F.struct(F.col("currency_code").alias("ccy"), F.col(side).alias("amount"))
        rank = F.when(
            F.col(f"{side}_last").isNotNull(),
            F.struct((F.col("currency_code") == F.col("preferred")).alias("p"), F.col(f"{side}_last")),
        )
        aggs.append(F.max_by(value, rank).alias(side))
    return marked.groupBy("day", "preferred").agg(
        *aggs,
        F.sum("rows").alias("transaction_count"),
        F.sum("uncategorised").alias("uncategorised_count"),
    ).select(
        "day",
        F.coalesce("credit.amount", F.lit(0)).alias("credit_total"),
        F.coalesce("credit.ccy", "preferred").alias("credit_currency"),
        F.coalesce("debit.amount", F.lit(0)).alias("debit_total"),
        F.coalesce("debit.ccy", "preferred").alias("debit_currency"),
        "transaction_count", "uncategorised_count",
    )


def _with_net(groups: DataFrame) -> DataFrame:
    sides = [F.col(c) for c in ("credit_total", "credit_currency", "debit_total", "debit_currency")]
    return (
        groups.withColumn("net", money.net_amount(*sides))
        .withColumn("net_currency", money.net_currency(*sides))
        .withColumn("flag", money.surplus_flag(F.col("net")))
    )


def day_groups(rows: DataFrame) -> DataFrame:
    """Per day: credit, debit, net, entries and uncategorised entries.

    Totals use counted rows only; the counts use every row given.
    """
    return _with_net(_pick_sides(_sides_by_currency(rows), F.lit(V.DEFAULT_CURRENCY)))


def month_groups(days: DataFrame) -> DataFrame:
    """Months over day groups (a table of calendar days, whatever the ledger's size)."""
    by_month = Window.partitionBy("month")
    marked = days.withColumn("month", F.trunc("day", "month"))
    for side in ("credit", "debit"):
        ccy = F.col(f"{side}_currency")
        marked = marked.withColumn(
            f"{side}_pick",
            F.when(F.max(ccy == V.DEFAULT_CURRENCY).over(by_month), V.DEFAULT_CURRENCY).otherwise(
                F.max_by(ccy, F.col("day")).over(by_month)
            ),
        )
    totals = []
    for side in ("credit", "debit"):
        mine = F.col(f"{side}_currency") == F.col(f"{side}_pick")
        totals += [
            F.sum(F.when(mine, F.col(f"{side}_total"))).alias(f"{side}_total"),
            F.max(f"{side}_pick").alias(f"{side}_currency"),
        ]
    grouped = marked.groupBy("month").agg(
        *totals,
        F.sum("transaction_count").alias("transaction_count"),
        F.sum("uncategorised_count").alias("uncategorised_count"),
    )
    return _with_net(grouped)


def month_day_rollup(rows: DataFrame) -> DataFrame:
    """Day groups and month groups in one table, told apart by ``level``."""
    days = day_groups(rows)
    shared = [
        "credit_total", "credit_currency", "debit_total", "debit_currency", "net",
        "net_currency", "flag", "transaction_count", "uncategorised_count",
    ]
    return days.select(
        F.lit("DAY").alias("level"), F.col("day").alias("period"), *shared
    ).unionByName(
        month_groups(days).select(F.lit("MONTH").alias("level"), F.col("month").alias("period"), *shared)
    )


def direction_totals(ledger: DataFrame, day=None) -> DataFrame:
    """A day's credit and debit totals, in the currency of the day's newest row."""
    rows = visible(ledger)
    if day is not None:
        start = F.lit(day).cast("date")
        rows = rows.filter(
            (F.col("txn_ts") >= start.cast("timestamp_ntz"))
            & (F.col("txn_ts") < F.date_add(start, 1).cast("timestamp_ntz"))
        )
    newest = F.max_by("currency_code", "last").over(Window.partitionBy("day"))
    return _pick_sides(_sides_by_currency(rows), newest).drop("uncategorised_count")


def date_bounds(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.min("txn_ts").alias("earliest"), F.max("txn_ts").alias("latest"))


def account_tails(ledger: DataFrame) -> DataFrame:
    return (
        visible(ledger).filter(F.col("account_tail").isNotNull())
        .select("account_tail").distinct().orderBy("account_tail")
    )


def months_with_data(ledger: DataFrame, today=None) -> DataFrame:
    """Months holding counted rows, newest first; the current month when none does."""
    months = counted(ledger).select(month_of(F.col("txn_ts")).alias("month")).distinct()
    if today is not None:
        current = F.trunc(F.lit(today).cast("date"), "month")
        months = months.groupBy().agg(F.collect_set("month").alias("m")).select(
            F.explode(F.when(F.size("m") > 0, F.col("m")).otherwise(F.array(current))).alias("month")
        )
    return months.orderBy(F.desc("month"))


def total_count(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("transactions"))


def count_by_source(ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """Transactions per contributing source.

    (source, txn) pairs are deduplicated first, which spreads a hot source over all
    partitions before the small count.
    """
    pairs = sources.select("source", "txn_id").distinct()
    return (
        pairs.join(ledger.select("txn_id"), "txn_id", "left_semi")
        .groupBy("source").agg(F.count("*").alias("transactions"))
    )


def source_sets(sources: DataFrame) -> DataFrame:
    """Distinct contributing sources per transaction (at most four values)."""
    return sources.groupBy("txn_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def display_title() -> Column:
    def present(name: str) -> Column:
        return F.when(F.col(name).rlike(r"\S"), F.col(name))

    return F.coalesce(
        present("merchant_name"), present("description"), present("bank_name"), F.lit(V.UNTITLED)
    )
