"""Labels of a report window such as '2026-07-16_to_2026-07-22' or '2026-07-23'."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _label(window_id: Column, pattern: str, joiner: str) -> Column:
    def one(part):
        day = F.when(part.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(part, "yyyy-MM-dd"))
        return F.coalesce(F.date_format(day, pattern), part)

    start = F.substring_index(window_id, "_to_", 1)
    rest = F.substring(window_id, F.length(start) + 5, F.length(window_id))
    ranged = F.concat(one(start), F.lit(joiner), one(rest))
    return F.when(window_id.contains("_to_"), ranged).otherwise(one(window_id))


def report_name(window_id: Column) -> Column:
    """'07/16/26 – 07/22/26' for display."""
    return _label(window_id, "MM/dd/yy", " – ")


def range_label(window_id: Column) -> Column:
    """'07.16.26-07.22.26' for file names."""
    return _label(window_id, "MM.dd.yy", "-")


def window_id(start: Column, end: Column) -> Column:
    """Key of a delivery window: one day, or 'start_to_end'; null without dates."""
    a, b = F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd")
    return F.when(a == b, a).otherwise(F.concat(a, F.lit("_to_"), b))
