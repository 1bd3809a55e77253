"""Column helpers for numbers and time, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Six-decimal report rounding; adding zero drops a negative zero."""
    return F.round(col(c), 6) + F.lit(0.0)


def finite(c) -> Column:
    """True only for a present, finite number."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_number(c) -> Column:
    """Text or number to double; absent, unparsable, NaN and infinite become null."""
    value = col(c).try_cast("double")
    return F.when(finite(value), value)


def finite_text(c) -> Column:
    """Like :func:`finite_number` but a JSON boolean text is not a number."""
    c = col(c)
    return F.when(~F.lower(F.trim(c)).isin("true", "false"), finite_number(c))


def ratio(num, den) -> Column:
    """A rate with a zero or absent denominator is null, never zero."""
    num, den = col(num), col(den)
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def clamp(c, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def half_even(c, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def micros(ts) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, free of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts).cast("timestamp_ntz"))


def bucket(c, width: int) -> Column:
    """Non-negative whole bucket number; monotone in ``c`` so it may split an ordered stream."""
    return F.floor(col(c) / F.lit(width)).cast("long")


def first_failure(*rules: tuple[Column, str]) -> Column:
    """Code of the first rule whose condition is not true (null counts as failed)."""
    out = F.lit(None).cast("string")
    for ok, code in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def reasons(*rules: tuple[Column, str]) -> Column:
    """All codes whose condition is true, in the given order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in rules]))
