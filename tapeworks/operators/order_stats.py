"""Exact ranks and quantiles inside groups of any size.

A window over a group, or the ``percentile`` aggregate, brings the whole group into one
task. Here a group is cut into *value buckets* instead: a fixed, order-preserving function
of the value (its octave and leading mantissa bits). Three facts make that enough:

* equal values collapse to one row with a count before anything is shuffled;
* bucket totals are a small histogram per group, whose running sum gives every bucket's offset;
* inside a bucket a window ranks only that bucket's distinct values.

So a date, factor or symbol that holds a third of all rows is still spread over its buckets.
Nothing is sampled: ranks and quantiles are exact.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.session import discard, materialise, sent_whole

MANTISSA_STEPS = 1024
COARSE_STEPS = 4
POSITION_STEPS = 64
_OCTAVE_SHIFT = 1100
_NULL_PARTS = 256


def value_bucket(value: Column, steps: int = MANTISSA_STEPS) -> Column:
    """Non-decreasing integer function of a DOUBLE: 2**-10 relative width by default.

    If ``log2`` rounds to a neighbouring octave the mantissa term moves by a whole
    octave the other way, so order is kept. Infinities have the outermost buckets; NaN comes last of all.
    """
    end = (2 * _OCTAVE_SHIFT + 100) * steps
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), octave) - 1.0) * steps)
    magnitude = ((octave + _OCTAVE_SHIFT) * steps + step).cast("bigint")
    special = (F.when(F.isnan(value), F.lit(end + 1)).when(value == float("inf"), F.lit(end))
               .when(value == float("-inf"), F.lit(-end)).when(value == 0, F.lit(0)))
    return F.when(special.isNotNull(), special.cast("bigint")).otherwise(
        F.signum(value).cast("bigint") * magnitude)


def distinct_positions(df: DataFrame, keys: Sequence[str], value: str,
                       weight: str | None = None) -> DataFrame:
    """One row per (keys, distinct non-NULL value): ``_ties``, ``_below`` (rows strictly
    smaller) and ``_n`` (rows in the group). ``weight`` is a row count per input row."""
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = F.col(weight) if weight else F.lit(1).cast("bigint")
    distinct = (
        df.where(F.col(value).isNotNull())
        .select(*keys, v.alias("_v"), rows.alias("_w"))
        .groupBy(*keys, "_v").agg(F.sum("_w").alias("_ties"))
        .withColumn("_b", value_bucket(F.col("_v"), POSITION_STEPS))
    )
    hist = distinct.groupBy(*keys, "_b").agg(F.sum("_ties").alias("_bn"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ordered = whole.orderBy("_b")
    hist = hist.select(
        *keys, "_b",
        (F.sum("_bn").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bn"))
        .alias("_base"),
        F.sum("_bn").over(whole).alias("_n"),
    )
    inner = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = distinct.withColumn("_in", F.sum("_ties").over(inner) - F.col("_ties"))
    return local.join(hist, [*keys, "_b"]).select(
        *keys, "_v", "_ties", (F.col("_base") + F.col("_in")).alias("_below"), "_n")


def _attach(df: DataFrame, pos: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Positions of each row's value. Rows without a value match nothing and are spread by a salt, not by their NULL."""
    right = pos.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                       "_v", "_ties", "_below", "_n", F.lit(0).alias("_zero"))
    salt = F.when(F.col(value).isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(_NULL_PARTS))).otherwise(F.lit(0))
    cond = (F.col(value).cast("double") == F.col("_v")) & (F.col("_salt") == F.col("_zero"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.withColumn("_salt", salt.cast("int")).join(right, cond, "left").drop(
        "_v", "_salt", "_zero", *[f"_k{i}" for i in range(len(keys))])


def with_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``df`` plus ``_ties``, ``_below``, ``_n`` of ``value`` inside ``keys``; NULL values get NULL."""
    return _attach(df, distinct_positions(df, keys, value), list(keys), value)


def with_stored_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """:func:`with_positions` of a stored table: positions are written first, so what they shuffle is gone before ``df``
    is shuffled to meet them."""
    return _attach(df, materialise(distinct_positions(df, keys, value)), list(keys), value)


def average_ranks(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """1-based ranks with ties averaged, one output column per (value -> name) entry.

    All positions are taken from ``df`` itself, so branches do not stack up.
    """
    out = df
    for value, name in values.items():
        out = _attach(out, distinct_positions(df, keys, value), list(keys), value).withColumn(
            name, F.col("_below") + (F.col("_ties") + 1) / 2.0).drop("_ties", "_below", "_n")
    return out


def average_ranks_stored(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """:func:`average_ranks` as a written table; each rank is written before the next one is made, and what it was made
    from is deleted."""
    out = materialise(df)
    for value, name in values.items():
        pos, before = materialise(distinct_positions(out, keys, value)), out
        out = materialise(_attach(before, pos, list(keys), value).withColumn(
            name, F.col("_below") + (F.col("_ties") + 1) / 2.0).drop("_ties", "_below", "_n"))
        discard(pos), discard(before)
    return out


def percentile_score(df: DataFrame, keys: Sequence[str], value: str, out: str,
                     digits: int | None = 1) -> DataFrame:
    """(average rank - 0.5) / n * 100; a group of one scores 50."""
    score = (F.col("_below") + F.col("_ties") / 2.0) / F.col("_n") * 100
    score = F.round(score, digits) if digits is not None else score
    return with_positions(df, keys, value).withColumn(out, score).drop("_ties", "_below", "_n")


def share_at_or_below(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Share of the group's values that are <= this one, in [0, 1]."""
    return with_positions(df, keys, value).withColumn(
        out, (F.col("_below") + F.col("_ties")) / F.col("_n")).drop("_ties", "_below", "_n")


def _steps_to(rows: DataFrame, keys: list[str], qs: dict[str, float], steps: int) -> tuple[DataFrame, dict[str, Column]]:
    """Buckets of ``rows`` (keys, ``_v``, ``_w`` and, once narrowed, ``_base`` and ``_n``) that hold a wanted position, and
    the positions (in terms of ``_n``)."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    narrowed = "_base" in rows.columns
    group = [*keys, "_base", "_n"] if narrowed else keys
    so_far = (Window.partitionBy(*group) if narrowed else whole).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = rows.withColumn("_b", value_bucket(F.col("_v"), steps)).groupBy(*group, "_b").agg(F.sum("_w").alias("_bn"))
    before = F.sum("_bn").over(so_far) - F.col("_bn")
    hist = hist.select(
        *keys, "_b", "_bn", (F.col("_base") + before if narrowed else before).alias("_base"),
        (F.col("_n") if narrowed else F.sum("_bn").over(whole)).alias("_n"))
    spots = {}
    for name, q in qs.items():
        at = F.lit(float(q)) * (F.col("_n") - 1)
        spots[f"_lo_{name}"], spots[f"_hi_{name}"] = F.floor(at), F.ceil(at)
    inside = F.lit(False)
    for at in spots.values():
        inside = inside | ((F.col("_base") <= at) & (at < F.col("_base") + F.col("_bn")))
    return hist.where(inside).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), "_base", "_n"), spots


def _inside(rows: DataFrame, keys: list[str], wanted: DataFrame, steps: int) -> DataFrame:
    cond = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.select(*keys, "_v", "_w").withColumn("_b", value_bucket(F.col("_v"), steps))
    return rows.join(wanted, cond).select(*keys, "_v", "_w", "_b", "_base", "_n")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float],
              weight: str | None = None, narrow: bool = False) -> DataFrame:
    """Linear-interpolated quantiles per group: one row per group with ``_n`` and one column
    per entry of ``qs``.

    Bucket counts come first (combined map-side). They tell which few buckets hold the wanted
    positions; only rows of those buckets are ordered. The plan is lazy; adaptive execution sees the
    real size of the list of wanted buckets and broadcasts it only below the planner's threshold.

    ``narrow`` is for many rows in few groups, of a stored table: counts of coarse buckets come first, their short list
    of wanted ones is written and sent to the rows, and the rows in them (written too) go the way above. Then neither
    the rows nor a bucket for nearly every row are shuffled.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"),
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"))
    if narrow:
        coarse, _ = _steps_to(rows, keys, qs, COARSE_STEPS)
        rows = materialise(_inside(rows, keys, sent_whole(coarse), COARSE_STEPS).drop("_b"))
    wanted, spots = _steps_to(rows, keys, qs, MANTISSA_STEPS)
    near = _inside(rows, keys, wanted, MANTISSA_STEPS).groupBy(*keys, "_b", "_v", "_base", "_n").agg(F.sum("_w").alias("_ties"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_end", F.col("_base") + F.sum("_ties").over(inner))
    hits = {name: F.max(F.when((F.col("_end") - F.col("_ties") <= at) & (at < F.col("_end")), F.col("_v"))).alias(name)
            for name, at in spots.items()}
    agg = near.groupBy(*keys).agg(F.max("_n").alias("_n"), *hits.values())
    cols = []
    for name, q in qs.items():
        at = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return agg.select(*keys, "_n", *cols)


def median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5}).withColumnRenamed("_n", f"{out}_n")
