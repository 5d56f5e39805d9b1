"""Writing result tables. Every sink is a distributed write; nothing passes the driver."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leakscope.functions.text import fold
from leakscope.lineage import fresh_path, shuffles_dropped
from leakscope.sources.dimensions import with_buyer
from leakscope.sources.pooling import newest_rows


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Overwrite one table and return how many rows were written, as the write itself counts."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    with shuffles_dropped(df.sparkSession):
        writer.format(fmt).save(path)
    return seen.get["rows"]


def write_tables(tables: dict[str, DataFrame], root: str, formats=("csv", "parquet")) -> None:
    """Every named result as CSV and Parquet below one folder; the latest run wins.

    A result is evaluated once: further formats are copies of what was written first.
    """
    for name, df in tables.items():
        first, *others = sorted(formats, key=lambda f: f != "parquet")
        write_table(df, f"{root}/{first}/{name}", first)
        for fmt in others:
            written = df.sparkSession.read.schema(df.schema).format(first).load(
                f"{root}/{first}/{name}")
            write_table(written, f"{root}/{fmt}/{name}", fmt)


def write_report_window(df: DataFrame, path: str, window_id: str | Column) -> None:
    """Write a table under its delivery window: the same window is replaced, others stay."""
    key = F.lit(window_id) if isinstance(window_id, str) else window_id
    (
        df.withColumn("window_id", key).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("window_id").parquet(path)
    )


def watchlist_columns(df: DataFrame, buyers: DataFrame | None = None) -> DataFrame:
    """Buyer first, an open review mark second; the flag every row carries is dropped.

    A list without buyers gets those of its business units.
    """
    if "buyer" not in df.columns and buyers is not None and "business_unit" in df.columns:
        df = with_buyer(df, buyers)
    rest = [c for c in df.columns if c not in ("buyer", "buyer_review", "flagged")]
    buyer = F.col("buyer") if "buyer" in df.columns else F.lit("")
    return df.select(buyer.alias("buyer"), F.lit(False).alias("buyer_review"), *rest)


def watchlist_export(
    watchlists: dict[str, DataFrame], root: str, buyers: DataFrame | None = None
) -> None:
    for name, df in watchlists.items():
        write_table(watchlist_columns(df, buyers), f"{root}/{name}", "csv")


def creative_findings_export(
    findings: dict[str, DataFrame], checks: dict[str, DataFrame], root: str
) -> list[str]:
    """One CSV table per finding and check that has rows, written whole; returns their names.

    Each is evaluated once, into a table of this run whose row count decides.
    """
    names = []
    for name, df in (findings | checks).items():
        path = fresh_path(df.sparkSession, f"finding-{name}")
        if write_table(df, path):
            saved = df.sparkSession.read.schema(df.schema).parquet(path)
            write_table(saved, f"{root}/{name}", "csv")
            names.append(name)
    return names


def serving_block_columns(clients: DataFrame) -> DataFrame:
    """Clients on blocked placements without buyer columns; day-zero dates read as unknown."""
    def known(c):
        text = F.col(c)
        return F.when(text.isin("1970-01-01", "nan", "NaT"), "—").otherwise(text).alias(c)

    dates = {"date_added", "last_served"}
    keep = [c for c in clients.columns if c not in ("buyer", "buyer_review", "sites_list")]
    return clients.select(*[known(c) if c in dates else F.col(c) for c in keep])


def serving_block_export(clients: DataFrame, path: str) -> None:
    write_table(serving_block_columns(clients), path, "csv")


def append_exclusions(rows: DataFrame, path: str, run_id: str) -> None:
    """Keep reviewed exclusions and pushed blocks (value, kind, status) of a run.

    A run owns its partition, so writing it again replaces it instead of doubling it.
    """
    write_partition = rows.select("value", "kind", "status").withColumn("run_id", F.lit(run_id))
    (
        write_partition.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id").parquet(path)
    )


def current_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Values whose latest review (by run) excludes them; what `drop_excluded` takes."""
    rows = spark.read.parquet(path).select(
        fold(F.col("value")).alias("value"), "kind", "status",
        F.col("run_id").cast("string").alias("run_id"),
    )
    latest = newest_rows(rows, ["value", "kind"], ["run_id"])
    return latest.filter(F.col("status") == "excluded").select("value", "kind")
