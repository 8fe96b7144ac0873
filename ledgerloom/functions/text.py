"""Column functions for references, merchants and account tails (native only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; also works inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Fixed value: the characters that count as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def blank_to_null(col: Column) -> Column:
    trimmed = strip(col)
    return F.when(F.length(trimmed) > 0, trimmed)


def squeeze(col: Column) -> Column:
    return F.regexp_replace(col, r"\s+", " ")


def upper_words(col: Column) -> Column:
    """Upper-case alphanumeric words of a text, one blank between them."""
    return F.upper(F.regexp_replace(col, r"[^\p{L}\p{Nd}]+", " "))


def _without(words: Column, *alternatives: str) -> Column:
    """Drop whole words matching any alternative, each with the blank after it; one pass over ``upper_words``."""
    whole = rf"(?<!\S)(?:{'|'.join(alternatives)})(?!\S) ?"
    return F.trim(F.regexp_replace(words, whole, ""))


_TRUSTED = (
    rf"^(?=.{{{V.REFERENCE_MIN_LENGTH}}})(?=(?:\P{{Nd}}*\p{{Nd}}){{{V.REFERENCE_MIN_DIGITS}}}).*$"
)


def may_hold_reference(col: Column) -> Column:
    """Cheap test that every text with a ``reference`` passes: it has that many digits."""
    return col.rlike(rf"(?:\p{{Nd}}\P{{Nd}}*){{{V.REFERENCE_MIN_DIGITS}}}")


def reference(col: Column) -> Column:
    """Canonical bank reference, or NULL when nothing trustworthy is left.

    Numeric fragments are pieces of one number; otherwise the longest word that
    carries a digit is the reference (the first one on ties).
    """

    def choose(words: Column) -> Column:
        longest = F.array_max(
            F.transform(
                F.filter(F.split(words, " "), lambda t: t.rlike(r"\p{Nd}")),
                lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("at"), t.alias("t")),
            )
        )
        pieces = words.rlike(r"^\p{Nd}+(?: \p{Nd}+)*$")
        return (
            F.when(pieces, F.translate(words, " ", ""))
            .when(words.contains(" "), longest["t"])
            .when(words.rlike(r"\p{Nd}"), words)
        )

    words = _without(upper_words(col), *V.REFERENCE_LABEL_WORDS)
    return F.get(F.regexp_extract_all(let(words, choose), F.lit(_TRUSTED), F.lit(0)), 0)


def merchant_words(col: Column) -> Column:
    """Words that say who was paid: no plumbing words, no identifiers."""
    identifier = rf"(?=\S{{{V.MERCHANT_IDENTIFIER_MIN}}})\S*\p{{Nd}}\S*"
    words = upper_words(F.substring_index(col, "@", 1))
    return _without(words, *V.MERCHANT_NOISE_WORDS, r"\p{Nd}+", identifier)


def key_of(words: Column) -> Column:
    """Comparison key out of merchant words."""
    key = F.translate(words, " ", "")
    return F.when(F.length(key) > 0, key)


def name_of(words: Column, raw: Column) -> Column:
    """Readable name out of merchant words; the raw text when none are left."""

    def title(t: Column) -> Column:
        return F.when(F.length(t) <= V.MERCHANT_ACRONYM_MAX, t).otherwise(
            F.concat(F.substring(t, 1, 1), F.lower(F.substring(t, F.lit(2), F.length(t))))
        )

    tidy = F.array_join(F.transform(F.split(words, " "), title), " ")
    return F.when(F.length(words) > 0, tidy).otherwise(blank_to_null(raw))


def merchant_key(col: Column) -> Column:
    return key_of(merchant_words(col))


def merchant_name(col: Column) -> Column:
    return name_of(merchant_words(col), col)


def account_tail(col: Column) -> Column:
    digits = F.regexp_replace(col, r"\P{Nd}", "")
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4)))


def account_masked(tail: Column) -> Column:
    return F.when(F.length(F.trim(tail)) > 0, F.concat(F.lit("•" * 4), tail))
