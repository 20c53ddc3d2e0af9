"""Market calendar: numbering, next day, gaps, coverage, date generators."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def _days() -> WindowSpec:
    """One row per trading day: the only tables here that are windowed without a key."""
    return Window.partitionBy(F.lit(1)).orderBy("data_date")


def market_calendar(*tables: DataFrame, date: str = "data_date") -> DataFrame:
    """Distinct dates over all tables with ``day_no`` (1..) and ``next_date``."""
    days = tables[0].select(F.col(date).alias("data_date")).distinct()
    for t in tables[1:]:
        days = days.unionByName(t.select(F.col(date).alias("data_date")).distinct())
    return days.where("data_date IS NOT NULL").distinct().select(
        "data_date",
        F.row_number().over(_days()).alias("day_no"),
        F.lead("data_date").over(_days()).alias("next_date"),
    )


def with_day_no(df: DataFrame, calendar: DataFrame) -> DataFrame:
    return df.join(calendar.select("data_date", "day_no"), "data_date")


def civil_next_day(calendar: DataFrame) -> DataFrame:
    """(data_date, entry_date): every civil day mapped to the first market day after it."""
    return calendar.where("next_date IS NOT NULL").select(
        F.explode(F.sequence("data_date", F.date_sub("next_date", 1))).alias("data_date"),
        F.col("next_date").alias("entry_date"),
    )


def missing_days(calendar: DataFrame, source: DataFrame) -> DataFrame:
    """Calendar dates the source lacks."""
    return calendar.select("data_date").distinct().join(
        source.select("data_date").distinct(), "data_date", "left_anti")


def missing_per_label(calendar: DataFrame, source: DataFrame, label: str,
                      values: Sequence[str]) -> DataFrame:
    """Missing (date, label) pairs for a fixed short list of labels such as markets."""
    wanted = calendar.select("data_date").distinct().select(
        "data_date", F.explode(F.array(*[F.lit(v) for v in values])).alias(label))
    return wanted.join(source.select("data_date", label).distinct(), ["data_date", label], "left_anti")


def gaps(calendar: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Per source: days, span, holes after its own first day, and how late it starts.

    Holes before the first day are not gaps: a moving average has no value there by nature.
    """
    out = None
    days = calendar.select("data_date", F.lit(1).alias("_in"), F.lit(0).alias("_have")).distinct()
    for name, df in sources.items():
        have = df.select("data_date").where("data_date IS NOT NULL").distinct()
        first = have.agg(F.min("data_date"))
        both = (
            days.unionByName(have.select("data_date", F.lit(0).alias("_in"), F.lit(1).alias("_have")))
            .groupBy("data_date").agg(F.max("_in").alias("_in"), F.max("_have").alias("_have"))
            .withColumn("_first", first.scalar())
        )
        hole = (F.col("_have") == 0) & (F.col("data_date") >= F.col("_first"))
        one = both.agg(
            F.lit(name).alias("source"),
            F.sum("_have").alias("days"),
            F.min(F.when(F.col("_have") == 1, F.col("data_date"))).alias("first_date"),
            F.max(F.when(F.col("_have") == 1, F.col("data_date"))).alias("last_date"),
            F.count(F.when(hole, 1)).alias("missing"),
            F.count(F.when((F.col("_in") == 1) & (F.col("data_date") < F.col("_first")), 1))
            .alias("starts_late"),
            F.array_sort(F.collect_list(F.when(hole, F.col("data_date")))).alias("missing_dates"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def covered_every_day(coverage: DataFrame, window: DataFrame, key: str) -> DataFrame:
    """Keys that have a row on every date of ``window`` (relational division)."""
    days = window.select("data_date").distinct()
    total = days.agg(F.count(F.lit(1)).alias("_days"))
    return (
        coverage.join(days, "data_date", "left_semi").select(key, "data_date").distinct()
        .groupBy(key).agg(F.count(F.lit(1)).alias("days"))
        .where((F.col("days") == total.scalar()) & (F.col("days") > 0))
    )


def recent_dates(df: DataFrame, n: int, date: str = "data_date") -> DataFrame:
    """Newest ``n`` distinct dates, oldest first."""
    return df.select(date).distinct().orderBy(F.col(date).desc()).limit(n).orderBy(date)


def usable_window(calendar: DataFrame, usable: Column, n: int) -> DataFrame:
    """Newest ``n`` days that pass ``usable``; nothing at all if fewer exist."""
    picked = calendar.where(usable).orderBy(F.col("data_date").desc()).limit(n)
    return picked.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where(
        F.col("_c") == n).drop("_c")


def month_spans(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per month touched by [start, end]: clipped first and last day."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = spark.range(1).select(
        F.explode(F.sequence(F.trunc(lo, "month"), hi, F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.select(
        "month", F.greatest(F.col("month"), lo).alias("first_day"),
        F.least(F.last_day("month"), hi).alias("last_day"))


def weekdays(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Monday to Friday dates of [start, end]."""
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("data_date"))
    return days.where(~F.dayofweek("data_date").isin(1, 7))


def completeness(datasets: Mapping[str, DataFrame], minimum: Mapping[str, int]) -> DataFrame:
    """Rows per (date, dataset) against its minimum, with a reason when short."""
    out = None
    for name, df in datasets.items():
        one = df.groupBy("data_date").agg(F.count(F.lit(1)).alias("rows")).select(
            "data_date", F.lit(name).alias("dataset"), "rows",
            F.lit(int(minimum[name])).cast("bigint").alias("required"))
        out = one if out is None else out.unionByName(one)
    ok = F.col("rows") >= F.col("required")
    return out.withColumn("complete", ok).withColumn(
        "reason", F.when(~ok, F.concat(F.col("dataset"), F.lit(": "), F.col("rows").cast("string"),
                                       F.lit(" < "), F.col("required").cast("string"))))
