"""Column helpers shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Month names.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]


def pad_left(col: Column, width: int) -> Column:
    """Zero-pad without cutting longer input (``lpad`` alone would cut it)."""
    text = col.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def type_key(col: Column) -> Column:
    """Canonical spelling of an event type: lower case, underscores for spaces."""
    return F.replace(F.lower(col), F.lit(" "), F.lit("_"))


def type_label(col: Column) -> Column:
    """Readable form of a canonical event type."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def shift(col: Column, months: int, years: int = 0) -> Column:
    """Move by months, then by years; both steps clamp to the month's end."""
    moved = col + F.make_ym_interval(F.lit(0), F.lit(months)) if months else col
    return moved + F.make_ym_interval(F.lit(years), F.lit(0)) if years else moved


def month_start(col: Column) -> Column:
    return F.trunc(col.cast("date"), "month")


def month_index(col: Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return F.year(col) * 12 + F.month(col)


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month.cast("int"))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first rule whose condition holds."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return default if out is None else out.otherwise(default)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, null where the divisor is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def half_even(col: Column, digits: int) -> Column:
    """Round to a fixed count of decimals, ties to the even digit."""
    scale = 10.0**digits
    return F.rint(col.cast("double") * scale) / scale


def fixed(col: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals and no digit grouping."""
    return F.format_string(f"%.{digits}f", half_even(col, digits))
