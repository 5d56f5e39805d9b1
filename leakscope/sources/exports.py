"""Flat delivery and creative exports (CSV or Parquet) and the canonical delivery fact."""

import csv
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leakscope.functions import constants as K
from leakscope.functions.names import display_name, looks_like_app, split_name_id
from leakscope.functions.text import fold, strip, text_in
from leakscope.sources.headers import (
    CREATIVE_COLUMNS,
    CREATIVE_HEADERS,
    DELIVERY_COLUMNS,
    DELIVERY_HEADERS,
    canonical_columns,
    columns_containing,
    find_by_tokens,
)

MONEY = "decimal(20,6)"
COUNT_COLUMNS = [
    "Impressions", "Clicks", "Post Click Conversions", "Post View Conversions",
    "25% Completed", "50% Completed", "75% Completed", "100% Completed",
]
ID_COLUMNS = ["Creative ID", "Campaign ID", "Campaign Pool ID"]
TYPE_COLUMNS = ["Site/App", "Inventory Type", "Environment", "Channel Type"]
OVERVIEW_NUMBERS = [
    "Impressions", "Clicks", "Click Conversions", "View-throughs", "CPM", "Internal Cost",
]


def count_of(c: Column) -> Column:
    """Any text or number as a count: fractions round half up, what does not parse is 0."""
    number = F.nanvl(c.try_cast("double"), F.lit(0.0))
    return F.coalesce(F.round(number).try_cast("bigint"), F.lit(0).cast("bigint"))


def money_of(c: Column) -> Column:
    return F.coalesce(c.try_cast(MONEY), F.lit(0).cast(MONEY))


def date_of(c: Column) -> Column:
    """Dates as the exports write them, with or without a time; null when no form fits whole."""
    text = strip(c.cast("string"))
    iso = F.when(text.rlike(r"^\d{4}-"), text.try_cast("timestamp"))
    return F.coalesce(
        iso.cast("date"),
        F.try_to_date(text, "M/d/yyyy"),
        F.try_to_date(text, "M/d/yy"),
        F.try_to_date(text, "M/d/yyyy H:mm"),
        F.try_to_date(text, "M/d/yyyy H:mm:ss"),
    )


def id_of(c: Column) -> Column:
    """Ids are labels: numeric ones lose a trailing '.0', a missing one is the empty text."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"^(\d+)\.0$", "$1"), F.lit(""))


def _typed(df: DataFrame) -> DataFrame:
    casts = {c: count_of(F.col(f"`{c}`")) for c in COUNT_COLUMNS if c in df.columns}
    casts |= {c: id_of(F.col(f"`{c}`")) for c in ID_COLUMNS if c in df.columns}
    if "Billable Spend" in df.columns:
        casts["Billable Spend"] = money_of(F.col("`Billable Spend`"))
    if "Date" in df.columns:
        casts["Date"] = date_of(F.col("Date"))
    return df.withColumns(casts)


# So large that no file is split or shares a partition with another one.
_ONE_FILE_EACH = {"spark.sql.files.maxPartitionBytes": str(1 << 50),
                  "spark.sql.files.openCostInBytes": str(1 << 50)}


def csv_headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Header line -> the files that begin with it, for all files of the paths.

    One job with a task for each file, which stops reading behind the first line that is not
    blank. The names of the files pass the driver, as Spark's own listing of them does.
    """
    def first_lines(batches):
        import pyarrow as pa

        for batch in batches:
            for path, line in zip(*(c.to_pylist() for c in batch.columns)):
                if line.strip():
                    yield pa.RecordBatch.from_pydict({"path": [path], "header": [line]})
                    return

    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    before = {k: spark.conf.get(k) for k in _ONE_FILE_EACH}
    try:
        for key, value in _ONE_FILE_EACH.items():
            spark.conf.set(key, value)
        found = lines.mapInArrow(first_lines, "path string, header string").collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out: dict[str, list[str]] = {}
    for path, header in sorted(found):
        out.setdefault(header.lstrip("\ufeff").rstrip("\r"), []).append(unquote(path))
    return out


def _names(header: str) -> list[str]:
    """Column names of a header line; blank and repeated ones get their place as a suffix."""
    names = next(csv.reader([header]))
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n
            for i, n in enumerate(names)]


def _literal(path: str) -> str:
    """A path without its characters being read as a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def read_layouts(spark: SparkSession, paths, fmt: str, multi_line: bool) -> list[DataFrame]:
    """The rows of all files as one frame for each layout.

    CSV files are grouped by their header line, so a folder may hold files of several layouts and
    thousands of files of a few layouts are a few scans. Other formats name their columns in each
    path's own schema.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt != "csv":
        return [spark.read.format(fmt).load(p) for p in paths]
    reader = spark.read.options(header=True, escape='"', multiLine=multi_line)
    frames = []
    for header, files in csv_headers(spark, paths).items():
        files = [_literal(f) for f in files]
        if header.count('"') % 2:  # a name with a line break
            frames.append(reader.csv(files))
        else:
            schema = StructType([StructField(n, StringType()) for n in _names(header)])
            frames.append(reader.schema(schema).csv(files))
    return frames or [reader.csv(paths)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_delivery_export(
    spark: SparkSession, paths, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """Site/app exports with canonical headers, used columns only and coerced measures.

    Headers are resolved per layout, because exports of different days may order or name their
    columns differently; the rows of all layouts are one lazy union. With `multi_line` quoted
    values may hold line breaks, and a file is read by one task.
    """
    frames = [
        _typed(canonical_columns(df, DELIVERY_HEADERS, DELIVERY_COLUMNS))
        for df in read_layouts(spark, paths, fmt, multi_line)
    ]
    return clean_app_identity(_union(frames))


def read_creative_export(
    spark: SparkSession, paths, fmt: str = "csv", multi_line: bool = True
) -> DataFrame:
    """Creative exports. Names and URLs stay verbatim: blanks are what the audit looks for.

    Names may hold quoted line breaks, so a CSV file is read by one task unless `multi_line` is
    off. A layout without a creative name comes back unpruned, so the caller can refuse it.
    """
    frames = []
    for raw in read_layouts(spark, paths, fmt, multi_line):
        df = canonical_columns(raw, CREATIVE_HEADERS, CREATIVE_COLUMNS)
        frames.append(_typed(df) if "Creative Name" in df.columns else raw)
    return _union(frames)


def exchange_rows(df: DataFrame) -> DataFrame:
    """Canonical rows of an exchange sheet: what the exchange audits take.

    Columns are found by the words in their names. All conversion columns are added up, without
    one conversions are 0; without a product all rows belong to the product `(all)`. Numbers that
    do not parse count as 0. A sheet without an exchange column is refused.
    """
    cols = df.columns
    found = {
        "exchange": find_by_tokens(cols, ("exchange",)),
        "product": find_by_tokens(cols, ("product",)),
        "impressions": find_by_tokens(cols, ("impression",), exclude=("conversion",)),
        "clicks": find_by_tokens(cols, ("click",), exclude=("conversion",)),
        "spend": find_by_tokens(cols, ("billable", "spend"), ("spend",), ("cost",)),
    }
    if found["exchange"] is None:
        raise ValueError("no exchange column")

    def column(name, missing):
        return F.col(f"`{found[name]}`") if found[name] else missing

    conversions = reduce(
        lambda a, b: a + b, [count_of(F.col(f"`{c}`")) for c in columns_containing(
            cols, "conversion")], F.lit(0).cast("bigint"))
    return df.select(
        column("exchange", None).cast("string").alias("exchange"),
        column("product", F.lit("(all)")).cast("string").alias("product"),
        *[count_of(column(c, F.lit(0))).alias(c) for c in ("impressions", "clicks")],
        conversions.alias("conversions"), money_of(column("spend", F.lit(0))).alias("spend"))


def read_exchange_export(spark: SparkSession, paths, fmt: str = "csv") -> DataFrame:
    """Exchange sheets of any layouts as rows of exchange, product and measures."""
    return _union([exchange_rows(df) for df in read_layouts(spark, paths, fmt, False)])


def drop_total_row(df: DataFrame) -> DataFrame:
    """Drop summary rows (first column reads TOTAL) and coerce the overview numbers."""
    first = F.col(f"`{df.columns[0]}`").cast("string")
    kept = df.filter(F.coalesce(F.upper(strip(first)), F.lit("")) != "TOTAL")
    numbers = [c for c in OVERVIEW_NUMBERS if c in df.columns]
    return kept.withColumns(
        {c: F.coalesce(F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)), F.lit(0.0))
         for c in numbers}
    )


def clean_app_identity(df: DataFrame) -> DataFrame:
    """Split composite app ids into name and id; the exact source text stays as 'Raw Value'."""
    if "App ID" not in df.columns:
        return df
    raw = F.col("`App ID`")
    parts = split_name_id(raw)
    changed = F.coalesce(parts["id"] != raw, F.lit(False))

    def refilled(c):
        current = F.col(f"`{c}`")
        stale = current.isNull() | (current == raw) | current.isin("", "nan", "None", "NA")
        return F.when(changed & stale, parts["name"]).otherwise(current)

    names = {c: refilled(c) for c in ("App Name", "Final App Name") if c in df.columns}
    return df.withColumns({"Raw Value": raw, **names, "App ID": parts["id"]})


def combined_is_app(df: DataFrame, inventory_id: Column, force_app=(), force_site=()) -> Column:
    """App or site: forced ids first, then the export's own type column, then the id's shape."""
    key = F.lower(inventory_id)
    type_column = next((c for c in TYPE_COLUMNS if c in df.columns), None)
    decision = looks_like_app(inventory_id)
    if type_column:
        stated = F.coalesce(F.lower(F.col(f"`{type_column}`")), F.lit(""))
        decision = (
            F.when(stated.contains("app"), True)
            .when(stated.rlike("site|web"), False)
            .otherwise(decision)
        )
    if force_site:
        decision = F.when(key.isin(*[v.lower() for v in force_site]), False).otherwise(decision)
    apps = [*K.APP_DOMAINS, *[v.lower() for v in force_app]]
    return F.when(key.isin(*apps), True).otherwise(decision)


def split_combined_inventory(
    df: DataFrame, dsp_label: str = "TTD/DV360", force_app=(), force_site=()
) -> tuple[DataFrame, DataFrame]:
    """One App/URL export -> (site rows, app rows), both tagged with the DSP."""
    parts = split_name_id(F.col("`App/URL`"))
    tagged = df.withColumns(
        {"DSP": F.lit(dsp_label), "Raw Value": F.col("`App/URL`"), "_parts": parts}
    )
    tagged = tagged.withColumn(
        "_app", combined_is_app(df, F.col("_parts.id"), force_app, force_site)
    )
    helpers = ["App/URL", "_parts", "_app", *[c for c in TYPE_COLUMNS if c in df.columns]]
    sites = tagged.filter(~F.col("_app")).withColumns(
        {"Site Domain": F.col("_parts.id"), "Final Site Domain Name": F.col("_parts.id")}
    )
    apps = tagged.filter(F.col("_app")).withColumns(
        {"App Name": F.col("_parts.name"), "Final App Name": F.col("_parts.name"),
         "App ID": F.col("_parts.id")}
    )
    return sites.drop(*helpers), apps.drop(*helpers)


def filter_date_range(df: DataFrame, start: str, end: str, column: str = "Date") -> DataFrame:
    """Rows dated within [start, end]; a frame without the column passes through."""
    if column not in df.columns:
        return df
    day = F.col(f"`{column}`")
    return df.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def latest_days(frames: list[DataFrame], days: int, column: str = "Date") -> list[DataFrame]:
    """Trim several facts to the last N delivery days of the newest date among all of them.

    The newest date is one scalar subquery, so each fact is filtered without a join.
    """
    dates = reduce(
        lambda a, b: a.unionByName(b),
        [f.agg(F.max(f"`{column}`").alias("d")) for f in frames],
    )
    newest = dates.agg(F.max("d")).scalar()
    day = F.col(f"`{column}`")
    return [
        f.filter((day >= F.date_sub(newest, days - 1)) & (day <= newest)) for f in frames
    ]


def _overview(df: DataFrame, keys: list[str]) -> DataFrame:
    measures = {
        "Impressions": "Impressions", "Clicks": "Clicks",
        "Click Conversions": "Post Click Conversions",
        "View-throughs": "Post View Conversions", "Internal Cost": "Billable Spend",
    }
    sums = [
        (F.coalesce(F.sum(f"`{source}`"), F.lit(0)) if source in df.columns else F.lit(0))
        .alias(name)
        for name, source in measures.items()
    ]
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*sums)
    return out.withColumnRenamed("Product 2", "Product")


def overview_frames(sites: DataFrame, apps: DataFrame) -> dict[str, DataFrame]:
    """Product and strategy overviews over the union of both facts; null keys are kept."""
    both = sites.unionByName(apps, allowMissingColumns=True)
    unit = next(
        (c for c in ("Business Unit", "Client Business Unit") if c in both.columns),
        both.columns[0],
    )
    product = [c for c in (unit, "Client", "Product 2") if c in both.columns]
    strategy = product + [c for c in ("Strategy Type", "Strategy Name") if c in both.columns]
    return {"product": _overview(both, product), "strategy": _overview(both, strategy)}


def normalize_delivery(df: DataFrame, kind: str) -> DataFrame:
    """Canonical delivery rows of one export ('site' or 'app'), whatever its column names.

    Measures that are missing count 0, dimensions read '(not in export)', ids are empty.
    """
    cols = df.columns
    named = "site" if kind == "site" else "app"
    final = find_by_tokens(cols, ("final", named), ("final", "domain"), ("final",))
    plain = [c for c in cols if c != final]
    raw = find_by_tokens(
        plain, *((("site", "domain"), ("domain",)) if kind == "site" else (("app", "name"),))
    ) or final
    if final is None:
        raise ValueError("no 'Final ... Name' column in the export")

    def col(name):
        return F.col(f"`{name}`")

    def text(name, default):
        return col(name).cast("string") if name else F.lit(default)

    def number(name, convert):
        return convert(col(name)) if name else convert(F.lit(0))

    app_id = find_by_tokens(cols, ("app", "id"), ("app", "bundle"), ("bundle",))
    client = next((c for c in cols if c.lower().strip() == "client"), None) or find_by_tokens(
        cols, ("client",), exclude=("business", "unit")
    )
    date = find_by_tokens(cols, ("date",))
    strategy = find_by_tokens(cols, ("strategy", "type"), ("strategy",))
    campaign_id = find_by_tokens(
        cols, ("campaign", "id"), ("campaign", "#"), ("campaign", "number"), exclude=("pool",)
    )
    clicks = find_by_tokens(cols, ("click",), exclude=("conversion", "url", "through"))
    conversions = [c for c in cols if "conversion" in c.lower()]
    placement = col(raw).cast("string")
    final_text = strip(col(final).cast("string"))
    identity = col(app_id).cast("string") if app_id else placement
    return df.select(
        (date_of(col(date)) if date else F.lit(None).cast("date")).alias("served_date"),
        text(find_by_tokens(cols, ("business", "unit")), K.NOT_IN_EXPORT).alias("business_unit"),
        text(client, K.NOT_IN_EXPORT).alias("client"),
        text(find_by_tokens(cols, ("product",)), K.NOT_IN_EXPORT).alias("product"),
        text(strategy, K.NOT_IN_EXPORT).alias("strategy_type"),
        text(find_by_tokens(cols, ("strategy", "name")) or strategy, K.NOT_IN_EXPORT)
        .alias("strategy_name"),
        text(find_by_tokens(cols, ("campaign", "name"), exclude=("pool",)), K.NOT_IN_EXPORT)
        .alias("campaign"),
        F.regexp_replace(strip(text(campaign_id, "")), r"\.0$", "").alias("campaign_id"),
        F.lit(kind).alias("placement_type"),
        placement.alias("placement"),
        identity.alias("app_id"),
        display_name(placement, identity).alias("display"),
        text(find_by_tokens(cols, ("dsp",)), "").alias("dsp"),
        F.coalesce(text(find_by_tokens(cols, ("raw", "value")), ""), F.lit(""))
        .alias("raw_value"),
        final_text.alias("final"),
        number(find_by_tokens(cols, ("impression",)), count_of).alias("impressions"),
        number(clicks, count_of).alias("clicks"),
        reduce(lambda a, b: a + b, [count_of(col(c)) for c in conversions], F.lit(0).cast("bigint"))
        .alias("conversions"),
        number(find_by_tokens(cols, ("billable", "spend"), ("spend",), ("cost",)), money_of)
        .alias("spend"),
        text_in(final_text, K.BLOCK_SENTINELS).alias("is_block"),
        text_in(final_text, ["", "nan"]).alias("is_unresolved"),
        F.lit(bool(conversions)).alias("has_conversions"),
    )
