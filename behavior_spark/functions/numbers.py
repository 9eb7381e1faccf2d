"""Rounding and number guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from behavior_spark.schemas import UINT64

_INFINITY = float("inf")


def finite(col: Column) -> Column:
    """The value if it is a finite number, else NULL (NaN sorts above infinity in Spark)."""
    return F.when(F.abs(col) < F.lit(_INFINITY), col)


def round_half_even(col: Column, digits: int = 0) -> Column:
    """Round a double with halves going to the even neighbour."""
    if digits == 0:
        return F.rint(col)
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def round_half_up(col: Column, digits: int = 0) -> Column:
    """Round with halves going up, also below zero (the browser's rule)."""
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def to_fixed(col: Column, digits: int = 2) -> Column:
    """Round a double as a browser's ``toFixed`` does: by its exact binary value, halves away from zero.

    2.675 is a little less than it reads, so it gives 2.67. The product with the power of ten is taken together with its rounding
    error (Veltkamp's and Dekker's splitting, exact in doubles), and the two decide which side of the half the value is on.
    Above 2**53 a double has no fraction and stays as it is.
    """
    scale = float(10**digits)
    value = F.abs(col)
    split = value * F.lit(134217729.0)
    high = split - (split - value)
    product = value * F.lit(scale)
    error = (high * F.lit(scale) - product) + (value - high) * F.lit(scale)
    whole = F.floor(product).cast("double")
    up = (product - whole - F.lit(0.5)) + error >= 0
    rounded = (whole + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(scale)
    return F.when(value >= F.lit(9007199254740992.0 / scale), col).otherwise(F.signum(col) * rounded)


def whole_number(col: Column) -> Column:
    """A double without a fraction as BIGINT, NULL if it does not fit."""
    return F.when(F.abs(col) < F.lit(9223372036854775808.0), col).cast("bigint")


def to_uint_or_null(col: Column) -> Column:
    """Digits-only text as an unsigned 64-bit whole number, NULL for anything else.

    A plain cast would let blanks and signs through. The type is DECIMAL(20,0) because
    the upper half of the range does not fit a BIGINT.
    """
    number = F.when(col.rlike("^[0-9]+$"), col.try_cast(UINT64))
    return F.when(number <= F.lit("18446744073709551615").cast(UINT64), number)


# Fixed value: what a browser counts as white space at the ends of a text.
_BLANKS = " \t\n\r\v\f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(_BLANKS))


def js_number(col: Column, present: Column | None = None) -> Column:
    """Text to number as a browser does it: a blank is 0, other text that is no number is NULL.

    ``present`` tells an explicit null (which counts as 0) from a missing key (no number).
    """
    return number_of_trimmed(js_trim(col), present)


def number_of_trimmed(trimmed: Column, present: Column | None = None) -> Column:
    """``js_number`` of a text without blanks at its ends, which is looked at several times here."""
    # Java reads a type letter at the end of a number; a browser does not.
    plain = F.when(~F.right(trimmed, F.lit(1)).isin("d", "D", "f", "F"), trimmed)
    value = (
        F.when(trimmed.isin("", "false"), F.lit(0.0))
        .when(trimmed == "true", F.lit(1.0))
        .otherwise(finite(plain.try_cast("double")))
    )
    if present is None:
        return value
    return F.when(present & trimmed.isNull(), F.lit(0.0)).otherwise(value)
