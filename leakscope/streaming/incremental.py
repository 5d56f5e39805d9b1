"""Incremental pooling of exports and incremental creative alerts.

Both are file streams that run what has arrived and stop (`availableNow`). Each micro-batch writes
under its own batch id and reads only what earlier batches wrote, so a batch that is replayed after
a failure gives the same result: the outcome does not depend on how often a batch ran.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from leakscope.lineage import written
from leakscope.operators.creative_alert import alert_of
from leakscope.operators.creative_profile import daily_sums, measured, summary_of, written_profile
from leakscope.sources.pooling import newest_rows

# Files that a batch adds to a day at most.
FILES_PER_DAY = 8
# Batch of compacted rows; streams number theirs from 0.
COMPACTED = -1

ALERT = "section string, position int, count bigint, text string, batch_id bigint"


def _run(stream: DataFrame, on_batch, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _file_stream(spark: SparkSession, schema: StructType, source: str, files: int | None):
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)


def _overwrite(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that `df` holds; others stay."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions).parquet(path)
    )


# --- pooled delivery ----------------------------------------------------------------------------
#
# A store holds for each delivery day the generations `batch_id` in which the day was written, each
# with all current rows of the day. The manifest names the days of each batch and is written after
# the batch's rows: a day's generation of the largest batch in the manifest is the current one, so
# all days of a batch switch at once, and rows of a batch that failed are never read.


def _manifest(store: str) -> str:
    """Below a name that readers of the rows ignore."""
    return f"{store}/_manifest/days"


def _manifest_schema(date: str, kind: DataType) -> StructType:
    return StructType([StructField(date, kind), StructField("batch_id", LongType())])


def _generation(date: str):
    """Text of a row's day and generation; a function of partition columns, so filters prune."""
    return F.concat_ws(
        "/", F.coalesce(F.col(f"`{date}`").cast("string"), F.lit("-")), F.col("batch_id"))


def _current(spark: SparkSession, store: str, schema: StructType, date: str,
             before: int | None = None, days: DataFrame | None = None) -> DataFrame:
    """Rows of the current generation of each day, with their batch_id.

    The names of the generations pass the driver, as the store's list of partitions does: one for
    each day.
    """
    listed = spark.read.schema(_manifest_schema(date, schema[date].dataType)).parquet(
        _manifest(store))
    if before is not None:
        listed = listed.filter(F.col("batch_id") < before)
    if days is not None:
        touched = days.select(F.col(f"`{date}`").alias("_day")).distinct()
        listed = listed.join(touched, F.col(f"`{date}`").eqNullSafe(F.col("_day")), "left_semi")
    newest = listed.groupBy(date).agg(F.max("batch_id").alias("batch_id"))
    names = [r[0] for r in newest.select(_generation(date)).collect()]
    rows = spark.read.schema(_stored(schema, date)).parquet(store)
    return rows.filter(_generation(date).isin(names)) if names else rows.limit(0)


def _stored(schema: StructType, date: str) -> StructType:
    """Columns of the store: partition columns last."""
    rest = [f for f in schema.fields if f.name not in (date, "batch_id")]
    return StructType([*rest, schema[date], StructField("batch_id", LongType())])


def upsert_days(
    rows: DataFrame, store: str, batch_id: int, keys: list[str], version: list[str],
    date: str = "served_date", files_per_day: int = FILES_PER_DAY,
) -> None:
    """Merge rows into the days they belong to: the newest version of each key stays.

    Only touched days are read and written anew, as a generation of this batch. The day is one of
    the keys, so a key's versions meet in one day.
    """
    if date not in keys:
        raise ValueError(f"{date} must be one of the keys")
    spark = rows.sparkSession
    schema = _manifest_schema(date, rows.schema[date].dataType)
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch_id").parquet(
        _manifest(store))
    new = written(newest_rows(rows, keys, version), "pool-batch")
    old = _current(spark, store, rows.schema, date, before=batch_id, days=new)
    merged = newest_rows(old.drop("batch_id").unionByName(new), keys, version)
    _write_days(merged, store, batch_id, keys, date, files_per_day)
    _list_days(new, store, batch_id, date)


def _list_days(rows: DataFrame, store: str, batch_id: int, date: str) -> None:
    days = rows.select(F.col(f"`{date}`")).distinct().withColumn(
        "batch_id", F.lit(batch_id).cast("long"))
    _overwrite(days.coalesce(1), _manifest(store), "batch_id")


def _write_days(
    rows: DataFrame, store: str, batch_id: int, keys: list[str], date: str, files_per_day: int
) -> None:
    """Each day's rows go to a few tasks by their keys, so that a large day is no single task."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(files_per_day))
    generation = rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
    _overwrite(generation.repartition(F.col(f"`{date}`"), salt), store, date, "batch_id")


def incremental_pool(
    spark: SparkSession, schema: StructType, source: str, store: str, checkpoint: str,
    keys: list[str], version: list[str], date: str = "served_date",
    files_per_batch: int | None = None, files_per_day: int = FILES_PER_DAY,
) -> None:
    """Add newly arrived exports to the store; a late file replaces older versions of its days."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        upsert_days(batch, store, batch_id, keys, version, date, files_per_day)

    _run(_file_stream(spark, schema, source, files_per_batch), on_batch, checkpoint)


def pooled_rows(
    spark: SparkSession, store: str, schema: StructType, date: str = "served_date"
) -> DataFrame:
    """Current rows of a store, one for each key. Date filters prune its partitions."""
    rows = _current(spark, store, schema, date)
    return rows.select(*[F.col(f"`{f.name}`") for f in schema.fields])


def compact_store(
    spark: SparkSession, store: str, target: str, schema: StructType, keys: list[str],
    date: str = "served_date", files_per_day: int = FILES_PER_DAY,
) -> None:
    """Write the current rows of a store to the new store `target`, as one generation.

    The old store stays as it is, so a failed run is repeated from it. A stream that goes on with
    `target` and the same checkpoint merges its batches into the compacted days.
    """
    rows = pooled_rows(spark, store, schema, date)
    _write_days(rows, target, COMPACTED, keys, date, files_per_day)
    _list_days(rows, target, COMPACTED, date)


def stale_generations(
    spark: SparkSession, store: str, schema: StructType, date: str = "served_date",
    grace_days: int = 8,
) -> DataFrame:
    """(day, batch_id) of generations that nothing will read any more.

    Stale is what a later batch replaced, where that batch is not the last one (a replay of the last
    batch reads what it replaced), and whose day is older than the watermark: the latest day
    less the days within which late files arrive, for readers that are still on the way.
    """
    listed = spark.read.schema(_manifest_schema(date, schema[date].dataType)).parquet(
        _manifest(store))
    last = listed.agg(F.max("batch_id")).scalar()
    watermark = listed.agg(F.date_sub(F.max(date), grace_days)).scalar()
    kept = listed.filter(F.col("batch_id") < last).groupBy(F.col(date).alias("_day")).agg(
        F.max("batch_id").alias("_kept"))
    return listed.join(kept, F.col(date).eqNullSafe(F.col("_day"))).filter(
        (F.col("batch_id") < F.col("_kept"))
        & F.coalesce(F.col(date) < watermark, F.lit(True))
    ).select(date, "batch_id")


def prune_store(
    spark: SparkSession, store: str, schema: StructType, date: str = "served_date",
    grace_days: int = 8,
) -> int:
    """Delete the partitions of stale generations; returns how many there were."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    stale = stale_generations(spark, store, schema, date, grace_days).collect()
    for day, batch_id in stale:
        name = "__HIVE_DEFAULT_PARTITION__" if day is None else day
        files.delete(hadoop.Path(f"{store}/{date}={name}/batch_id={batch_id}"), True)
    return len(stale)


# --- creative alerts ----------------------------------------------------------------------------


def add_sums(batch: DataFrame, state: str, batch_id: int) -> None:
    """Store a batch's sums per day and text columns, sorted so that filters on days skip files."""
    sums = daily_sums(measured(batch)).withColumn("batch_id", F.lit(batch_id).cast("long"))
    _overwrite(sums.sortWithinPartitions("date"), state, "batch_id")


def stored_sums(spark: SparkSession, state: str, upto: int | None = None) -> DataFrame:
    """The stored sums of all batches up to one; they can be added up again in any way."""
    rows = spark.read.option("mergeSchema", True).parquet(state)
    return (rows if upto is None else rows.filter(F.col("batch_id") <= upto)).drop("batch_id")


def judge(spark: SparkSession, state: str, out: str, batch_id: int,
          min_impressions: int = 1) -> None:
    """Summary and alert of all delivery stored up to a batch, under the batch's id."""
    prof = written_profile(stored_sums(spark, state, batch_id))
    summary = written(summary_of(prof, min_impressions), "creative-summary")
    of = F.lit(batch_id).cast("long")
    _overwrite(alert_of(prof, summary).withColumn("batch_id", of), f"{out}/alerts", "batch_id")
    _overwrite(summary.drop("banner_impressions").withColumn("batch_id", of),
               f"{out}/summary", "batch_id")


def incremental_creative_alerts(
    spark: SparkSession, schema: StructType, source: str, state: str, out: str, checkpoint: str,
    files_per_batch: int | None = None, min_impressions: int = 1,
) -> None:
    """Add arrived creative exports to the stored sums and judge all that was delivered so far.

    However the feed is cut into batches, the alert after the last one is that of the whole feed: a
    day may arrive in parts. Costs of a batch are those of its rows and of the stored sums, never
    of earlier exports.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        add_sums(batch, state, batch_id)
        judge(spark, state, out, batch_id, min_impressions)

    _run(_file_stream(spark, schema, source, files_per_batch), on_batch, checkpoint)


def compact_sums(spark: SparkSession, state: str, target: str) -> None:
    """Fold the stored sums of all batches into one, in the new state `target`."""
    sums = daily_sums(stored_sums(spark, state)).withColumn(
        "batch_id", F.lit(COMPACTED).cast("long"))
    _overwrite(sums.sortWithinPartitions("date"), target, "batch_id")


def latest_alert(spark: SparkSession, out: str) -> DataFrame:
    """Rows of the alert after the last judged batch; none if that raised none."""
    last = spark.read.parquet(f"{out}/summary").agg(F.max("batch_id").cast("long")).scalar()
    rows = spark.read.schema(ALERT).parquet(f"{out}/alerts")
    return rows.filter(F.col("batch_id") == last).drop("batch_id")
