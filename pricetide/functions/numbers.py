"""Rounding, parsing and coercion of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even the way array libraries do: scale, rint, unscale."""
    if digits == 0:
        return F.rint(value)
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def round_to(value: Column, step: float = 5_000) -> Column:
    """Nearest multiple of `step`, ties to even."""
    return F.rint(value / float(step)) * float(step)


def clip(value: Column, low: float | None, high: float | None) -> Column:
    """Clamp, keeping NULL as NULL."""
    out = value
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    return out


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL on a zero divisor, also in ANSI mode."""
    return numerator / F.nullif(denominator, F.lit(0))


def to_number(value: Column) -> Column:
    """Text or number to double; bad text, NaN and infinities become NULL."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def sane_price(value: Column, ceiling: float = 1e8) -> Column:
    """Finite, positive and not above the ceiling, else NULL."""
    number = to_number(value)
    return F.when((number > 0) & (number <= ceiling), number)


def heal_first_price(first: Column, current: Column) -> Column:
    """Keep a plausible first price; one more than 50 times off is a parse artefact."""
    share = ratio(first, current)
    return (
        F.when(first.isNull(), current)
        .when(current.isNull(), first)
        .when((share > 50) | (share < 0.02), current)
        .otherwise(first)
    )


def parse_price(text: Column) -> Column:
    """'1.250,50 €' to 1250.5: dots group thousands, a comma marks decimals."""
    main = F.regexp_replace(F.translate(text, "€ .", ""), ",", ".")
    main = F.regexp_replace(main, r"[^0-9.]", "")
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.coalesce(
        F.nullif(main, F.lit("")).try_cast("double"),
        F.nullif(digits, F.lit("")).try_cast("double"),
    )


def parse_amount(text: Column) -> Column:
    """European amount text ('1.250,50') to double, bad text to NULL."""
    return F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".").try_cast("double")


def first_int(text: Column) -> Column:
    """The first run of digits, as an integer."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")


def to_flag(text: Column) -> Column:
    """Yes-like words to 1, everything else (also NULL) to 0."""
    # fixed values: accepted words
    words = ("1", "true", "yes", "y", "si", "sí")
    return F.coalesce(F.lower(F.trim(text)).isin(*words).cast("int"), F.lit(0))


def truthy_flag(value: Column) -> Column:
    """Boolean, number or text to 0/1; a value never seen is 0."""
    number = value.try_cast("double")
    return F.coalesce(
        value.try_cast("boolean").cast("int"),
        F.when(number.isNotNull(), (number != 0).cast("int")),
        F.lit(0),
    )
