"""Choosing export files from a manifest of (path, modified)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions import constants as K


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Manifest of a folder; the files' contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"))


def export_files(manifest: DataFrame) -> DataFrame:
    """The manifest's exports with their kind and date; other files are left out.

    Creative marks are looked for first and combined ones next, since their names may also hold
    the site and app marks. The date is the one in the file's name, else the modification day.
    """
    base, bare = F.col("_base"), F.translate("_base", "-_ ", "")
    kind = (
        F.when(~(base.endswith(".csv") | base.endswith(".xlsx") | base.endswith(".parquet")), None)
        .when(bare.contains(K.CREATIVE_FILE_MARK), "creatives")
        .when(base.contains(K.COMBINED_FILE_MARK), "ttddv")
        .when(base.contains(K.SITE_FILE_MARK), "sites")
        .when(base.contains(K.APP_FILE_MARK), "apps")
    )
    digits = F.translate(F.regexp_extract("_base", K.FILE_DATE, 0), "-_", "")
    stated = F.when(F.length("_stamp") == 8, F.try_to_date("_stamp", "yyyyMMdd"))
    named = manifest.withColumn("_base", F.lower(F.substring_index("path", "/", -1)))
    return named.withColumns({"kind": kind, "_stamp": digits}).select(
        "path", "modified", "kind",
        F.coalesce(stated, F.col("modified").cast("date")).alias("file_date"),
    ).filter(F.col("kind").isNotNull())


def file_inventory(manifest: DataFrame) -> DataFrame:
    """Files of each kind per date, and whether the date has its site and app files."""
    counts = [
        F.count_if(F.col("kind") == k).alias(k) for k in K.EXPORT_KINDS
    ]
    per_date = export_files(manifest).groupBy("file_date").agg(*counts)
    return per_date.withColumn("complete", (F.col("sites") > 0) & (F.col("apps") > 0))


def select_range_files(
    manifest: DataFrame, start: str, end: str, grace_days: int = 8
) -> DataFrame:
    """All files dated in [start, end + grace]; oldest first by (file_date, modified, path).

    Reversed bounds are swapped. A window without both a site and an app file gives one row with
    the reason.
    """
    start, end = min(start, end), max(start, end)
    window_end = F.date_add(F.lit(end).cast("date"), grace_days)
    dated = export_files(manifest).filter(
        (F.col("file_date") >= F.lit(start).cast("date")) & (F.col("file_date") <= window_end)
    )
    complete = dated.agg(
        F.count_distinct(F.when(F.col("kind").isin("sites", "apps"), F.col("kind"))) == 2
    ).scalar()
    chosen = dated.withColumn("_complete", complete).filter("_complete").select(
        "kind", "path", "file_date", "modified", F.lit(None).cast("string").alias("reason"))
    missing = manifest.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("date").alias("file_date"),
        F.lit(None).cast(chosen.schema["modified"].dataType).alias("modified"),
        F.lit("no site and app files in the window").alias("reason"),
        complete.alias("_complete"),
    ).filter(~F.col("_complete")).drop("_complete")
    return chosen.unionByName(missing)


def newest_file_per_kind(manifest: DataFrame) -> DataFrame:
    return export_files(manifest).groupBy("kind").agg(
        F.max_by("path", F.struct("modified", "path")).alias("path"),
        F.max("modified").alias("modified"),
    )
