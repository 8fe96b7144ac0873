"""``parsed`` → ``normalised``: one projection, native expressions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fingerprint as fp
from ledgerloom.functions import text
from ledgerloom.operators.once import with_once


def normalise(parsed: DataFrame) -> DataFrame:
    """Canonical reference, merchant, account and identity of every parsed row.

    Amounts become positive (direction lives in ``type``), accounts keep four digits,
    and raw text survives only where parsing was incomplete.
    """
    words = F.col("merchant_words")
    derived = with_once(
        parsed,
        {
            "normalized_reference": text.reference(F.col("reference_number")),
            "merchant_words": text.merchant_words(F.col("merchant_name")),
            "account_tail": text.account_tail(F.col("account_identifier")),
        },
    ).withColumn("merchant_key", text.key_of(words))
    identity = fp.fingerprint(
        *[
            F.col(c)
            for c in (
                "amount_minor", "currency_code", "type", "txn_ts", "normalized_reference",
                "merchant_key", "account_tail",
            )
        ]
    )
    return derived.select(
        "seq",
        *[c for c in ("place",) if c in parsed.columns],
        F.abs("amount_minor").alias("amount_minor"),
        "currency_code",
        "type",
        "txn_ts",
        text.blank_to_null(F.col("description")).alias("description"),
        text.name_of(words, F.col("merchant_name")).alias("merchant_name"),
        text.blank_to_null(F.col("reference_number")).alias("reference_number"),
        "normalized_reference",
        "merchant_key",
        "account_tail",
        text.blank_to_null(F.col("bank_name")).alias("bank_name"),
        F.coalesce("payment_method", F.lit("UNKNOWN")).alias("payment_method"),
        "source",
        "source_identifier",
        "origin_label",
        "parse_status",
        F.when(F.col("parse_status") != "PARSED", F.col("raw_payload")).alias("raw_payload"),
        F.coalesce("is_promotional", F.lit(False)).alias("is_promotional"),
        fp.strategy(F.col("normalized_reference")).alias("strategy"),
        identity.alias("fingerprint"),
    )
