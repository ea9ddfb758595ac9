"""Column functions. All of them stay in the JVM; none is a Python UDF."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from contractlens import values

MINUTE = 60_000_000  # microseconds

# Text patterns
_NUMERIC_PREFIX = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
# white space in full, as the (?U) classes are slow
_SPACE = values.SPACE
_MONEY_NOISE = rf"[₹$,A-Za-z{_SPACE}]+"
_CURRENCY_WORD = r"(?i)^\s*(?:rs|inr)\b\.?"


def starts_with_digit(text: Column) -> Column:
    return text.rlike("^[0-9]")


def numeric_prefix(text: Column) -> Column:
    """Longest numeric prefix as a double; 0 when there is none."""
    prefix = F.regexp_extract(F.ltrim(text), _NUMERIC_PREFIX, 0)
    return F.when(text.isNotNull(), F.coalesce(prefix.try_cast("double"), F.lit(0.0)))


def clean_price(text: Column, strict: bool = False) -> Column:
    """Price text to a double, NULL when nothing numeric is left.

    Letters, currency signs, commas and white space go, dots stay, so
    ``Rs. 500`` reads as 0.5.  ``strict`` removes a leading currency word
    together with its dot first.
    """
    if strict:
        text = F.regexp_replace(text, _CURRENCY_WORD, "")
    return F.regexp_replace(text, _MONEY_NOISE, "").try_cast("double")


def parse_when(text: Column, formats: dict[str, str] | None = None) -> Column:
    """Text to a timestamp by the first format that fits, else NULL.

    A format is tried only on text of its shape: a failed try costs far more
    than a pattern.  Put the result in a column before taking parts of it.
    """
    formats = formats or values.DATE_FORMATS
    trimmed = F.trim(text)
    return F.coalesce(
        *[
            F.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed, F.lit(f)))
            for f, shape in formats.items()
        ]
    )


def missing_to_null(text: Column) -> Column:
    """NULL for every token that stands for a missing CSV value."""
    return F.when(~text.isin(values.MISSING_TOKENS), text)


def is_junk_product(name: Column) -> Column:
    return reduce(or_, [name.ilike(p) for p in values.JUNK_PRODUCTS])


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases])


def without_nan(number: Column) -> Column:
    """NaN counts as missing, so that comparisons with it are not true."""
    return F.nanvl(number.cast("double"), F.lit(None).cast("double"))


def log_price(price: Column) -> Column:
    """ln(1 + price), negative prices taken as 0, missing kept missing."""
    known = without_nan(price)
    return F.when(known.isNotNull(), F.log1p(F.greatest(known, F.lit(0.0))))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that is NULL when the divisor is 0."""
    return F.try_divide(top, bottom)


def micros(when: Column) -> Column:
    return F.unix_micros(when.cast("timestamp"))


def strip_space(text: Column) -> Column:
    """Strip any Unicode white space at both ends."""
    return F.btrim(text, F.lit(values.SPACES))


def plain_text(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.regexp_replace(text, rf"[{_SPACE}]+", " "))
