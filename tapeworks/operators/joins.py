"""Keyed look-ups: latest, as-of, range and self joins."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators import prefix


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key, the last along ``order``. An aggregate, so it combines before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"))
    return picked.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def on_or_before(df: DataFrame, keys: Sequence[str], day: Column, date: str = "data_date") -> DataFrame:
    return latest_per_key(df.where(F.col(date) <= day), keys, date)


def last_rows(df: DataFrame, keys: Sequence[str], n: int, *order: str) -> DataFrame:
    """Last ``n`` rows per key; the window limit prunes each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, *tie: str) -> DataFrame:
    """Row with the highest ``score`` per key, NULL scores last, ties by ``tie`` ascending last wins."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(score).isNotNull().alias("_known"), F.col(score), *tie)
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_s"))
    return picked.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str],
              time: str = "data_date", cut: bool = False,
              right_time: str = "asof_date") -> DataFrame:
    """``left`` plus the latest ``right`` row at or before its time.

    Union and carry-forward, so nothing is compared pairwise. ``cut`` keeps unbounded histories out
    of one task: the union is cut into ranges of the order.
    """
    keys = list(keys)
    payload = F.struct(F.col(time).alias(right_time), *values)
    rows = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(*keys, time, F.lit(0).alias("_side"), payload.alias("_hit")),
        allowMissingColumns=True)
    if not cut:
        w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_last", F.last("_hit", ignorenulls=True).over(w))
    else:
        rows = prefix.last_known(rows, keys, None, [time, "_side"], "_hit", "_last")
    return rows.where(F.col("_side") == 1).select(
        *left.columns, F.col(f"_last.{right_time}").alias(right_time),
        *[F.col(f"_last.{v}").alias(v) for v in values])


def previous_event(df: DataFrame, keys: Sequence[str], value: str, max_days: int,
                   date: str = "data_date") -> DataFrame:
    """Previous row's ``value`` and date per key, if it lies within ``max_days``."""
    w = Window.partitionBy(*keys).orderBy(date)
    near = F.datediff(F.col(date), F.lag(date).over(w)) <= max_days
    return df.withColumn(f"prev_{value}", F.when(near, F.lag(value).over(w))).withColumn(
        "prev_date", F.when(near, F.lag(date).over(w)))


def by_source_priority(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of sources, first source wins per key."""
    keys, out = list(keys), None
    for i, df in enumerate(tables):
        one = df.withColumn("_p", F.lit(i))
        out = one if out is None else out.unionByName(one)
    rest = [c for c in out.columns if c not in keys and c != "_p"]
    best = out.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("_p")).alias("_s"))
    return best.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def occurrence_number(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      cut: bool = False, out: str = "row_seq") -> DataFrame:
    """0-based number of each repeat of a key, in source order; ``cut`` for keys of unbounded size."""
    if cut:
        return prefix.running_sum(df, keys, None, order, F.lit(1), out).withColumn(
            out, (F.col(out) - 1).cast("int"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w) - 1)


def collapse_duplicates(df: DataFrame, keys: Sequence[str], first_by: str,
                        out: str = "duplicate_count") -> DataFrame:
    """One row per key (the earliest by ``first_by``) with the number of copies."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(first_by)).alias("_s"),
                                F.count(F.lit(1)).alias(out))
    return agg.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest], out)
