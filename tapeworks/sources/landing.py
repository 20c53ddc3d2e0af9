"""Landing zone: one row per report file, batch or stream, and the partitioned sinks behind it.

Files lie under ``<root>/<source>/<YYYY-MM-DD>/<name>``. Spark's text reader splits the work by
file; folder names come from the file path, so nothing is listed or parsed on the driver.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tapeworks.operators.merge import upsert
from tapeworks.session import discard, materialise, path_exists

_PLACE = r"/([^/]+)/(\d{4}-\d{2}-\d{2})/[^/]+$"


def _shaped(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(path, _PLACE, 1).alias("source"),
        F.regexp_extract(path, _PLACE, 2).try_cast("date").alias("data_date"),
        F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("landed_at"))


def read_landing(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """(source, data_date, payload, landed_at), one row per file."""
    path = f"{root}/{source or '*'}/*/*"
    return _shaped(spark.read.text(path, wholetext=True))


def stream_landing(spark: SparkSession, root: str, source: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    return _shaped(spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger)
                   .format("text").load(f"{root}/{source}/*/*"))


def read_table(spark: SparkSession, path: str, columns: Sequence[str], start: str | None = None,
               end: str | None = None, as_of: str | Column | None = None) -> DataFrame:
    """Columns of a date-partitioned table in [start, end], optionally only facts usable at ``as_of``.

    Plain predicates on the partition column and on a stored column: both reach the scan.
    """
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("data_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("data_date") <= F.lit(end).cast("date"))
    if as_of is not None:
        df = df.where(F.col("available_at") <= (F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of))
    return df.select(*columns)


def write_days(df: DataFrame, path: str, date: str = "data_date", sort: Sequence[str] = ("symbol",),
               files_per_day: int = 1) -> None:
    """Replace exactly the dates present in ``df``; a rerun writes the same table.

    Rows are spread over ``files_per_day`` files per date by a hash of the sort key, so one heavy
    date is not one task, and sorted inside for scan statistics.
    """
    salt = F.pmod(F.xxhash64(*sort), F.lit(files_per_day))
    (df.withColumn("_salt", salt).repartition(date, "_salt").drop("_salt")
     .sortWithinPartitions(date, *sort)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path))


def append_days(df: DataFrame, path: str, date: str = "data_date") -> None:
    df.write.mode("append").partitionBy(date).parquet(path)


def merge_days(batch: DataFrame, path: str, keys: list[str], date: str = "data_date", seq: str | None = None,
               files_per_day: int = 1) -> None:
    """Merge rows into the dates they carry: a stored row stays unless ``batch`` has its key, and only those dates
    are written again. Of rows with one key the one with the largest ``seq`` counts (any of them without it).

    The merged dates are written beside the table first, because a table cannot be read and replaced at once.
    """
    spark = batch.sparkSession
    new = materialise(batch)
    if path_exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        days = new.select(date).distinct()
        old = old.join(days, date, "left_semi").select(*new.columns)
    else:
        old = new.limit(0)
    merged = materialise(upsert(old, new, [date, *[k for k in keys if k != date]], seq=seq).select(*new.columns))
    write_days(merged, path, date, [k for k in keys if k != date] or [date], files_per_day)
    for done in (new, merged):
        discard(done)


def replace_day_stream(df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], seq: str | None = None,
                       files_per_day: int = 1) -> DataStreamWriter:
    """Micro-batches are merged into the dates they carry by ``keys``: the files of a date may come in any number of
    batches, and re-delivery of a batch changes nothing."""
    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _id: merge_days(batch, path, list(keys), seq=seq, files_per_day=files_per_day))
