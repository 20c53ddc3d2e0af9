"""Back-adjustment of prices and volumes for corporate actions.

With C(d) the product of all factors whose ex date is on or before d, the factor that puts a bar
of date d on the scale of date t is C(t) / C(d). C depends on d only, so one pass serves every
target date: divide by C once, run ordinary windows, multiply by C(t) where a price level is wanted.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_factor(factor: Column) -> Column:
    """NULL for factors that are absent, not positive or no-ops."""
    f = factor.cast("double")
    return F.when((f > 0) & (f != 1.0), f)


def scale_to_date(bars: DataFrame, actions: DataFrame, factors: dict[str, str],
                  keys: Sequence[str] = ("symbol",), date: str = "data_date") -> DataFrame:
    """Add one cumulative factor C(date) per entry of ``factors`` (output name -> action column).

    Actions are merged into the bar sequence (an action counts on its own ex date), so the cost is
    one sort by key; bars and events are never paired off.
    """
    keys = list(keys)
    events = actions.groupBy(*keys, date).agg(*[
        F.product(F.coalesce(valid_factor(F.col(c)), F.lit(1.0))).alias(f"_f_{out}")
        for out, c in factors.items()])
    rows = bars.withColumn("_bar", F.lit(1)).unionByName(
        events.withColumn("_bar", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(date, "_bar").rowsBetween(Window.unboundedPreceding, 0)
    for out in factors:
        rows = rows.withColumn(out, F.coalesce(
            F.product(F.coalesce(F.col(f"_f_{out}"), F.lit(1.0))).over(w), F.lit(1.0)))
    return rows.where("_bar = 1").select(*bars.columns, *factors)


def back_adjust(bars: DataFrame, actions: DataFrame, prices: Sequence[str], volumes: Sequence[str] = (),
                keys: Sequence[str] = ("symbol",), date: str = "data_date",
                price_factor: str = "adj_factor", share_factor: str = "share_factor") -> DataFrame:
    """Series on the scale of each key's newest action: ``adj_<column>`` per listed column.

    Factor of a bar = product of the factors with an ex date after the bar. The running product goes
    backwards in time, so later events multiply earlier bars only.
    """
    keys = list(keys)
    events = actions.groupBy(*keys, date).agg(
        F.product(F.coalesce(valid_factor(F.col(price_factor)), F.lit(1.0))).alias("_pf"),
        F.product(F.coalesce(valid_factor(F.col(share_factor)), F.lit(1.0))).alias("_sf"))
    rows = bars.withColumn("_bar", F.lit(1)).unionByName(
        events.withColumn("_bar", F.lit(0)), allowMissingColumns=True)
    # newest first; on the ex date itself the bar comes before its action
    w = (Window.partitionBy(*keys).orderBy(F.col(date).desc(), F.col("_bar").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    price = F.product(F.coalesce("_pf", F.lit(1.0))).over(w)
    share = F.product(F.coalesce("_sf", F.lit(1.0))).over(w)
    return (
        rows.withColumn("price_scale", price).withColumn("share_scale", share)
        .where("_bar = 1")
        .select(*bars.columns, "price_scale", "share_scale",
                *[(F.col(c) * F.col("price_scale")).alias(f"adj_{c}") for c in prices],
                *[(F.col(c) * F.col("share_scale")).alias(f"adj_{c}") for c in volumes])
    )
