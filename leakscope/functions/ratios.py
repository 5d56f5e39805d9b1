"""Safe ratios. Every division is guarded, so they hold under ANSI mode."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num, den, otherwise: float | None = 0.0) -> Column:
    """num / den as double where den > 0, else the given value (null for None)."""
    num, den = _col(num), _col(den)
    value = num.cast("double") / den.cast("double")
    return F.when(den > 0, value).otherwise(F.lit(otherwise).cast("double"))


def ctr(clicks="clicks", impressions="impressions") -> Column:
    return ratio(clicks, impressions)


def cpm(spend="spend", impressions="impressions") -> Column:
    spend, impressions = _col(spend), _col(impressions)
    value = spend.cast("double") / impressions.cast("double") * F.lit(1000.0)
    return F.when(impressions > 0, value).otherwise(F.lit(0.0))


def money(c) -> Column:
    """Sums stay decimal while they are added up and become double in the result."""
    return _col(c).cast("double")


def total(c, name: str | None = None) -> Column:
    """Sum that is 0, not null, when there is nothing to add."""
    s = F.coalesce(F.sum(_col(c)), F.lit(0))
    return s.alias(name or c) if (name or isinstance(c, str)) else s


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
