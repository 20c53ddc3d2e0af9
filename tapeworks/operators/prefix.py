"""Running sums, previous values and drawdowns over sequences of any length.

A window partitioned by symbol puts one symbol's whole history in one task. That is fine for
daily bars (at most one row per trading day) but not for ticks, where one symbol-day - or one
minute of it - may hold a third of all rows. These operators cut a sequence into *chunks*, work
inside each chunk, reduce each chunk to one row, scan those rows, and join the carry back. A chunk
is either a column that never decreases along the order and that bounds its rows (a day of bars),
or, with no column given, a range partition of the rows in the order itself (:func:`range_cut`):
then however crowded a minute is, it is spread over as many chunks as its rows need.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.session import materialise

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)


def key_block(df: DataFrame, column: str) -> Column:
    """Coarse, order-preserving block of a sort column: ranges of 4096 for numbers, two leading
    characters for text. Cuts a day with very many symbols into several chunks."""
    if dict(df.dtypes)[column] == "string":
        return F.substring(column, 1, 2)
    return F.floor(F.col(column) / 4096)


def range_cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """``df``, written once, with ``_cut``: the range partition of (keys, order) that a row is in.

    Ranges are balanced by sampled rows, not by keys or the clock, so their size does not depend on how crowded a key
    or a minute is; only rows equal in all of (keys, order) stay together. Without ``pieces`` their number follows the
    session's shuffle partitions, which adaptive execution joins while they are small. Within a key the numbers
    increase along the order.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(pieces, *by) if pieces else df.repartitionByRange(*by)
    return materialise(dealt.withColumn("_cut", F.spark_partition_id()))


def _chunked(df: DataFrame, keys: list[str], chunk: Sequence[str] | None, order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(chunk)) if chunk else (range_cut(df, keys, order), ["_cut"])


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
                           *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(renamed, cond, how).drop(*[f"_r{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, keys: Sequence[str], chunk: Sequence[str] | None, order: Sequence[str],
                value: Column, out: str) -> DataFrame:
    """Cumulative sum of ``value`` along ``order`` inside ``keys``."""
    keys = list(keys)
    df, chunk = _chunked(df, keys, chunk, order)
    base = (
        df.groupBy(*keys, *chunk).agg(F.sum(value).alias("_t"))
        .withColumn("_carry", F.coalesce(
            F.sum("_t").over(Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(*_BEFORE)),
            F.lit(0)))
        .drop("_t")
    )
    inner = Window.partitionBy(*keys, *chunk).orderBy(*order).rowsBetween(*_SO_FAR)
    local = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return _null_safe(local, base, [*keys, *chunk], "left").withColumn(
        out, F.col("_in") + F.col("_carry")).drop("_in", "_carry", "_cut")


def previous_value(df: DataFrame, keys: Sequence[str], chunk: Sequence[str] | None, order: Sequence[str],
                   value: str, out: str) -> DataFrame:
    """Value of the preceding row along ``order`` inside ``keys`` (NULL on the first row)."""
    keys = list(keys)
    df, chunk = _chunked(df, keys, chunk, order)
    last = (
        df.groupBy(*keys, *chunk)
        .agg(F.max_by(F.struct(value), F.struct(*order)).alias("_s"))
        .withColumn("_carry", F.lag("_s").over(Window.partitionBy(*keys).orderBy(*chunk))[value])
        .drop("_s")
    )
    inner = Window.partitionBy(*keys, *chunk).orderBy(*order)
    local = df.withColumn("_in", F.lag(value).over(inner)).withColumn(
        "_first", F.row_number().over(inner) == 1)
    return _null_safe(local, last, [*keys, *chunk], "left").withColumn(
        out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in"))
    ).drop("_in", "_first", "_carry", "_cut")


def last_known(df: DataFrame, keys: Sequence[str], chunk: Sequence[str] | None, order: Sequence[str],
               value: str, out: str) -> DataFrame:
    """Latest non-NULL ``value`` at or before each row along ``order``."""
    keys = list(keys)
    df, chunk = _chunked(df, keys, chunk, order)
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    last = (
        df.groupBy(*keys, *chunk).agg(F.max_by(F.struct(value), at)[value].alias("_s"))
        .withColumn("_carry", F.last("_s", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(*_BEFORE)))
        .drop("_s")
    )
    inner = Window.partitionBy(*keys, *chunk).orderBy(*order).rowsBetween(*_SO_FAR)
    local = df.withColumn("_in", F.last(value, ignorenulls=True).over(inner))
    return _null_safe(local, last, [*keys, *chunk], "left").withColumn(
        out, F.coalesce("_in", "_carry")).drop("_in", "_carry", "_cut")


def max_drawdown(df: DataFrame, keys: Sequence[str], chunk: Sequence[str], order: Sequence[str],
                 value: str, out: str = "max_drawdown") -> DataFrame:
    """Deepest fall of the cumulated ``value`` from its running maximum, per ``keys`` (<= 0)."""
    keys, chunk = list(keys), list(chunk)
    inner = Window.partitionBy(*keys, *chunk).orderBy(*order).rowsBetween(*_SO_FAR)
    steps = (
        df.where(F.col(value).isNotNull())
        .withColumn("_eq", F.sum(value).over(inner))
        .withColumn("_top", F.max("_eq").over(inner))
    )
    pieces = steps.groupBy(*keys, *chunk).agg(
        F.sum(value).alias("_sum"), F.max("_eq").alias("_hi"), F.min("_eq").alias("_lo"),
        F.min(F.col("_eq") - F.col("_top")).alias("_dd"),
    )
    w = Window.partitionBy(*keys).orderBy(*chunk)
    placed = pieces.withColumn(
        "_base", F.coalesce(F.sum("_sum").over(w.rowsBetween(*_BEFORE)), F.lit(0.0)))
    placed = placed.withColumn(
        "_peak", F.max(F.col("_base") + F.col("_hi")).over(w.rowsBetween(*_BEFORE)))
    across = F.col("_base") + F.col("_lo") - F.col("_peak")
    return placed.groupBy(*keys).agg(
        F.min(F.least(F.col("_dd"), F.coalesce(across, F.lit(0.0)))).alias(out))
