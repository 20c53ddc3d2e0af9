"""Cross-sectional standardisation per date (and per factor)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators import order_stats
from tapeworks.session import sent_whole


def winsor_z(long: DataFrame, keys: Sequence[str], value: str, out: str,
             q: float = 0.01, clip: float = 5.0) -> DataFrame:
    """Clip to the [q, 1-q] quantiles of the group, standardise with population moments, clip again.

    Groups below two values have no z (NULL, never 0); a group of equal values has z = 0.
    ``keys`` normally holds the date and, for melted features, the feature name, so all features
    share the same few shuffles. The plan is lazy; limits and moments are one row per group, so adaptive
    execution joins them without another shuffle of the rows while they are small. ``long`` is read by
    several branches: pass a stored table when it is costly.
    """
    keys = list(keys)
    known = long.where(F.col(value).isNotNull())
    v = F.col(value).cast("double")
    if q > 0:
        limits = order_stats.quantiles(known, keys, value, {"_lo": q, "_hi": 1 - q}).drop("_n")
        known = known.join(limits, keys).withColumn("_w", F.greatest(F.col("_lo"), F.least(F.col("_hi"), v)))
    else:
        known = known.withColumn("_lo", F.lit(None)).withColumn("_hi", F.lit(None)).withColumn("_w", v)
    moments = known.groupBy(*keys).agg(
        F.count("_w").alias("_zn"), F.avg("_w").alias("_zm"), F.stddev_pop("_w").alias("_zs"))
    z = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.try_divide(
        F.col("_w") - F.col("_zm"), F.col("_zs"))))
    return (
        known.join(moments, keys)
        .withColumn(out, F.when(F.col("_zn") < 2, F.lit(None).cast("double"))
                    .when(F.col("_zs") == 0, F.lit(0.0)).otherwise(z))
        .drop("_w", "_lo", "_hi", "_zn", "_zm", "_zs")
    )


def winsor_z_columns(wide: DataFrame, key: str, columns: Sequence[str], q: float = 0.01, clip: float = 5.0) -> DataFrame:
    """``wide``, a stored table, with each of ``columns`` replaced by its z inside ``key``, as :func:`winsor_z` has it.

    Rows stay where they are: only counts, limits and moments are made, one row per ``key`` with all columns side by
    side, and these are written and sent to the rows. Unknown values stay NULL.
    """
    columns = list(columns)
    rows = wide
    if q > 0:
        long = melt(wide, [key], columns, "_factor", "_value")
        limits = order_stats.quantiles(long, [key, "_factor"], "_value", {"_lo": q, "_hi": 1 - q}, narrow=True)
        rows = rows.join(sent_whole(limits.groupBy(key).agg(*[
            F.max(F.when(F.col("_factor") == c, F.col(end))).alias(f"{end}_{c}") for c in columns for end in ("_lo", "_hi")])), key, "left")
    clipped = {}
    for c in columns:
        v = F.col(c).cast("double")
        clipped[c] = F.when(v.isNotNull(), F.greatest(F.col(f"_lo_{c}"), F.least(F.col(f"_hi_{c}"), v))) if q > 0 else v
    rows = rows.withColumns(clipped)
    moments = sent_whole(rows.groupBy(key).agg(*[f(c).alias(f"{name}_{c}") for c in columns for name, f in (
        ("_zn", F.count), ("_zm", F.avg), ("_zs", F.stddev_pop))]))
    z = {}
    for c in columns:
        zs = F.col(f"_zs_{c}")
        one = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.try_divide(F.col(c) - F.col(f"_zm_{c}"), zs)))
        z[c] = F.when(F.col(c).isNotNull() & (F.col(f"_zn_{c}") >= 2), F.when(zs == 0, F.lit(0.0)).otherwise(one))
    return rows.join(moments, key, "left").withColumns(z).select(*wide.columns)


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "factor",
         value: str = "value") -> DataFrame:
    """Wide to long; NULL cells are dropped."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(ids), list(columns), name, value).where(F.col(value).isNotNull())


def spread(long: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "factor",
           value: str = "value") -> DataFrame:
    """Long to wide by conditional maximum: one aggregate, no pivot pre-scan of the names."""
    return long.groupBy(*ids).agg(*[
        F.max(F.when(F.col(name) == c, F.col(value))).alias(c) for c in columns])
