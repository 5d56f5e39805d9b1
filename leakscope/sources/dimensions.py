"""Block list and buyer dimensions."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.text import fold, strip, text_in
from leakscope.sources.headers import find_exact_or_part


def block_date(text: Column) -> Column:
    """Dates of a block list; 'Date(y,m,d)' counts its months from 0."""
    t = strip(text)
    sheet = r"^Date\((\d+),(\d+),(\d+)"
    y, m, d = (F.regexp_extract(t, sheet, i) for i in (1, 2, 3))
    month = (m.try_cast("int") + 1).cast("string")
    from_sheet = F.when(
        t.rlike(sheet), F.try_to_date(F.concat_ws("-", y, month, d), "y-M-d")
    )
    short = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(t, "M/d/yy"))
    long = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "M/d/yyyy"))
    iso = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "y-M-d"))
    return F.coalesce(from_sheet, long, iso, short)


def blocklist_rows(tabs: dict[str, DataFrame], value_at: int = 1, date_at: int = 4) -> DataFrame:
    """Positional tab frames -> (value, tab, date_added) rows.

    A header row is one with a header word in any cell; a tab without one loses nothing.
    """
    parts = []
    for tab, df in tabs.items():
        cols = df.columns
        if len(cols) <= value_at:
            continue
        date = F.col(f"`{cols[date_at]}`") if len(cols) > date_at else F.lit(None)
        parts.append(
            df.select(
                strip(F.col(f"`{cols[value_at]}`")).alias("value"), F.lit(tab).alias("tab"),
                date.cast("string").alias("_date"),
                F.greatest(F.lit(False), *[
                    text_in(F.col(f"`{c}`").cast("string"), K.BLOCKLIST_HEADER_WORDS) for c in cols
                ]).alias("_header"),
            )
        )
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    body = rows.filter(~text_in(F.col("value"), [""]) & ~F.col("_header"))
    return body.select("value", "tab", block_date(F.col("_date")).alias("date_added"))


def read_blocklist(spark: SparkSession, tab_paths: dict[str, str], **positions) -> DataFrame:
    """Block-list tabs as headerless CSV files -> one row per (match_key, tab)."""
    tabs = {tab: spark.read.option("header", False).csv(p) for tab, p in tab_paths.items()}
    return blocklist_dim(blocklist_rows(tabs, **positions))


def blocklist_dim(rows: DataFrame) -> DataFrame:
    """(match_key, tab, value, date_added): the earliest known date of a value on a tab.

    `value` is the smallest spelling of the key.
    """
    return rows.groupBy(fold(F.col("value")).alias("match_key"), "tab").agg(
        F.min("value").alias("value"), F.min("date_added").alias("date_added")
    )


def blocklist_by_key(dim: DataFrame) -> DataFrame:
    """One row per key: its tabs, earliest date, and the date each tab blocks since.

    The tabs are a fixed set, so this is a conditional aggregate with a state of fixed size. A
    tab without a date blocks since the sentinel day; a tab the key is not on stays null.
    """
    since = F.coalesce(F.col("date_added"), F.lit(K.BLANK_BLOCK_DATE).cast("date"))
    tabs = sorted(set(K.BLOCK_TABS))
    on_tab = {t: F.bool_or(F.col("tab") == t) for t in tabs}
    return dim.groupBy("match_key").agg(
        F.concat_ws(", ", *[F.when(on_tab[t], F.lit(t)) for t in tabs]).alias("lists"),
        F.min("date_added").alias("date_added"),
        *[F.min(F.when(F.col("tab") == t, since)).alias(since_column(t)) for t in tabs],
    )


def since_column(tab: str) -> str:
    return "since_" + tab.lower().replace(" ", "_")


def blocked_since(product: Column) -> Column:
    """First day the product is blocked for a row joined to `blocklist_by_key`; null if never."""
    by_tab = F.lit(None).cast("date")
    for name, tab in K.PRODUCT_TABS.items():
        by_tab = F.when(product == name, F.col(since_column(tab))).otherwise(by_tab)
    return F.least(F.col(since_column(K.TAB_ALL)), by_tab)


def buyer_dim(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """(partner, buyer) of a mapping table; of repeated partners the last row wins.

    Columns are matched by name, else the second and third column are taken. `order` gives the
    rows' source order; without it the largest buyer name is taken, which any run repeats.
    """
    cols = rows.columns
    partner = find_exact_or_part(cols, ["partner", "business unit", "advertiser", "agency"])
    buyer = find_exact_or_part(cols, ["buyer", "trader", "account manager", "owner"])
    if partner is None or buyer is None or partner == buyer:
        partner, buyer = cols[1], cols[2]
    named = rows.select(
        strip(F.col(f"`{partner}`")).alias("partner"), strip(F.col(f"`{buyer}`")).alias("buyer"),
        (order if order is not None else F.lit(0)).alias("_order"),
    ).filter((F.col("partner") != "") & (F.col("buyer") != ""))
    return named.groupBy("partner").agg(
        F.max_by("buyer", F.struct("_order", "buyer")).alias("buyer")
    )


def read_buyers(spark: SparkSession, path: str) -> DataFrame:
    """Buyers from CSV: of repeated partners the last row of the last file by path wins."""
    rows = spark.read.option("header", True).csv(path)
    return buyer_dim(rows, F.struct(
        "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()))


def with_buyer(df: DataFrame, buyers: DataFrame, partner: str = "business_unit") -> DataFrame:
    """Add the partner's buyer: exact name first, else ignoring case and outer spaces.

    Both spellings are folded into one mapping before the join, so the lookup is one hash join
    per spelling and the left side keeps its rows.
    """
    exact = buyers.select(F.col("partner").alias("_p"), F.col("buyer").alias("_exact"))
    loose = buyers.groupBy(fold(F.col("partner")).alias("_f")).agg(
        F.max_by("buyer", "partner").alias("_loose")
    )
    joined = df.join(exact, df[partner] == F.col("_p"), "left").join(
        loose, fold(df[partner]) == F.col("_f"), "left"
    )
    return joined.withColumn(
        "buyer", F.coalesce("_exact", "_loose", F.lit(""))
    ).drop("_p", "_f", "_exact", "_loose")
