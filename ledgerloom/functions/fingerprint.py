"""Deterministic payment identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V


def strategy(normalized_reference: Column) -> Column:
    usable = F.length(F.trim(F.coalesce(normalized_reference, F.lit("")))) > 0
    return F.when(usable, "REFERENCE").otherwise("FIELDS")


def fingerprint(
    amount_minor: Column,
    currency: Column,
    type_: Column,
    ts: Column,
    normalized_reference: Column,
    merchant_key: Column,
    account_tail: Column,
) -> Column:
    """Reference identity when a reference survived, else day/merchant/account fields."""

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    kind = strategy(normalized_reference)
    money = F.concat(currency, F.lit(":"), F.abs(amount_minor).cast("string"))
    head = [F.lit(V.FINGERPRINT_VERSION), kind, money, type_]
    by_reference = F.concat_ws("|", *head, text(normalized_reference))
    by_fields = F.concat_ws(
        "|", *head, ts.cast("date").cast("string"), text(merchant_key), text(account_tail)
    )
    payload = F.when(kind == "REFERENCE", by_reference).otherwise(by_fields)
    return F.concat(F.lit(f"{V.FINGERPRINT_VERSION}:"), F.sha2(payload, 256))
