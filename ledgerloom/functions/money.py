"""Money is integral minor units plus a currency code; never floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V


def fraction_digits(currency: Column) -> Column:
    return (
        F.when(currency.isin(*V.ZERO_DIGIT_CURRENCIES), 0)
        .when(currency.isin(*V.THREE_DIGIT_CURRENCIES), 3)
        .otherwise(2)
    )


def printed_number(text: Column) -> Column:
    """Exact decimal out of printed text such as ``Rs.1,299.00`` or ``540.50 Dr``."""
    unworded = F.regexp_replace(text, r"(?i)\brs\.", "")
    kept = F.regexp_replace(F.regexp_replace(unworded, r"[^0-9.\-]", ""), r"\.$", "")
    # Nothing removed is a digit, so the text itself tells whether any is left.
    return F.when(text.rlike("[0-9]"), kept.try_cast("decimal(38,18)"))


def minor_units(text: Column, currency: Column | str = V.DEFAULT_CURRENCY) -> Column:
    """Printed amount → minor units, half-even at the currency's own precision."""
    number = printed_number(text)

    def scaled(digits: int) -> Column:
        exact = F.bround(number, digits) * F.lit(10**digits).cast("decimal(4,0)")
        return exact.try_cast("bigint")

    if isinstance(currency, str):
        digits = (
            0
            if currency in V.ZERO_DIGIT_CURRENCIES
            else 3
            if currency in V.THREE_DIGIT_CURRENCIES
            else 2
        )
        return scaled(digits)
    digits = fraction_digits(currency)
    return F.when(digits == 0, scaled(0)).when(digits == 3, scaled(3)).otherwise(scaled(2))


def net_currency(credit: Column, credit_ccy: Column, debit: Column, debit_ccy: Column) -> Column:
    return F.when((credit == 0) & (credit_ccy != debit_ccy), debit_ccy).otherwise(credit_ccy)


def net_amount(credit: Column, credit_ccy: Column, debit: Column, debit_ccy: Column) -> Column:
    """Credit minus debit in one currency; otherwise the side that is not zero."""
    return (
        F.when(credit_ccy == debit_ccy, credit - debit)
        .when(credit == 0, -debit)
        .otherwise(credit)
    )


def surplus_flag(net: Column) -> Column:
    return F.when(net > 0, "PROFIT").when(net < 0, "LOSS").otherwise("EVEN")
