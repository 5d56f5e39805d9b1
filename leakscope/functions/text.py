"""Text helpers shared by every audit. All are plain column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope.functions.constants import BLANK_TEXTS, WHITESPACE


def strip(c: Column) -> Column:
    """Drop white space (any Unicode kind) from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def fold(c: Column) -> Column:
    """Stripped lower-case form, the form every text comparison uses."""
    return F.lower(strip(c))


def text_in(c: Column, values: list[str]) -> Column:
    """Null-safe membership of the folded text; a null text counts as the empty one."""
    return F.coalesce(fold(c), F.lit("")).isin(*values)


def is_blank(c: Column) -> Column:
    """True for null and for the texts exports use instead of null."""
    return text_in(c, BLANK_TEXTS)


def fixed(x: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, for non-negative numbers.

    Rounds the scaled double half up, so the text is the same on every engine that follows IEEE
    arithmetic; ``format_string('%.2f')`` rounds the shortest decimal form instead.
    """
    scale = 10**digits
    n = F.floor(x * F.lit(float(scale)) + F.lit(0.5)).cast("bigint")
    whole = F.call_function("div", n, F.lit(scale)).cast("string")
    part = F.lpad((n % F.lit(scale)).cast("string"), digits, "0")
    return F.concat(whole, F.lit("."), part)


def percent(x: Column, digits: int) -> Column:
    """A ratio as percent text, e.g. 0.0123 -> '1.23%'."""
    return F.concat(fixed(x * F.lit(100.0), digits), F.lit("%"))


def grouped(x: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(x.cast("bigint"), 0)


def date_or(c: Column, missing: str) -> Column:
    """ISO text of a date, or the given text where it is null."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(missing))
