"""Look-ahead-safe evaluation of scores: entry, exits, excursions, bucket statistics."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numbers import net_return, ratio
from tapeworks.operators import order_stats, prefix
from tapeworks.operators.calendar import civil_next_day, market_calendar
from tapeworks.session import sent_whole


def entry_bars(bars: DataFrame, horizons: Sequence[int], entry: str = "open") -> DataFrame:
    """Every bar seen as an entry: price, and per horizon k the k-th close, highest high and lowest low.

    Exit k counts the symbol's own bars, the entry bar being the first.
    """
    w = Window.partitionBy("symbol").orderBy("data_date")
    cols = []
    for k in horizons:
        frame = w.rowsBetween(0, k - 1)
        cols += [
            F.lead("close", k - 1).over(w).alias(f"exit_{k}"),
            F.max("high").over(frame).alias(f"high_{k}"),
            F.min("low").over(frame).alias(f"low_{k}"),
        ]
    return bars.select("symbol", F.col("data_date").alias("entry_date"),
                       F.col(entry).alias("entry_price"), *cols)


def outcomes(signals: DataFrame, bars: DataFrame, cfg: Mapping[str, Any],
             calendar: DataFrame | None = None) -> DataFrame:
    """One row per (signal, realised horizon): entry on the next *market* day's bar, else dropped.

    A symbol that did not trade on that day yields nothing, so a halt never becomes a fill.
    """
    calendar = market_calendar(bars) if calendar is None else calendar
    horizons = list(cfg["horizons"])
    first = calendar.agg(F.min("data_date"))
    placed = signals.join(sent_whole(civil_next_day(calendar)), "data_date", "left").withColumn(
        "entry_date", F.when(F.col("data_date") < first.scalar(), first.scalar())
        .otherwise(F.col("entry_date"))).where("entry_date IS NOT NULL")
    hit = placed.join(entry_bars(bars, horizons, cfg["entry"]), ["symbol", "entry_date"]).where(
        F.col("entry_price") > 0)
    price = F.col("entry_price")
    per_h = F.array(*[F.struct(
        F.lit(k).alias("horizon"), F.col(f"exit_{k}").alias("exit_price"),
        (F.try_divide(F.col(f"exit_{k}"), price) - 1).alias("gross"),
        net_return(price, F.col(f"exit_{k}"), cfg).alias("net"),
        (F.try_divide(F.col(f"high_{k}"), price) - 1).alias("mfe"),
        (F.try_divide(F.col(f"low_{k}"), price) - 1).alias("mae")) for k in horizons])
    keep = [c for c in signals.columns]
    return hit.select(*keep, "entry_date", "entry_price", F.explode(per_h).alias("_h")).select(
        *keep, "entry_date", "entry_price", "_h.*").where("exit_price IS NOT NULL")


def bucket_label(score: Column, buckets: Sequence[Sequence[float]]) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in buckets:
        out = F.when((score >= lo) & (score < hi), F.lit(f"[{lo},{hi})")).otherwise(out)
    return out


def by_bucket(rows: DataFrame, buckets: Sequence[Sequence[float]], score: str = "score") -> DataFrame:
    return rows.withColumn("label", bucket_label(F.col(score), buckets)).where("label IS NOT NULL")


def by_threshold(rows: DataFrame, thresholds: Sequence[float], score: str = "score") -> DataFrame:
    """A row counts for every threshold it reaches (a fixed short list)."""
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col(score))
    return rows.withColumn("_t", F.explode(reached)).withColumn(
        "label", F.concat(F.lit(">="), F.col("_t").cast("int").cast("string"))).drop("_t")


def return_stats(rows: DataFrame, keys: Sequence[str], day: str = "data_date",
                 tie: str = "symbol") -> DataFrame:
    """Count, win rate, mean, median, profit factor, expectancy, drawdown, Sharpe, Sortino, MFE, MAE.

    Moments combine before the shuffle; the median is read off value buckets and the drawdown is
    scanned by day and symbol block, so a label that covers most signals is not one task's work.
    """
    keys = list(keys)
    r = F.col("net")
    agg = rows.groupBy(*keys).agg(
        F.count(r).alias("count"), F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(r).alias("avg_return"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_win"),
        F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("_loss"), F.stddev_samp(r).alias("_sd"),
        F.count(F.when(r < 0, r)).alias("_nd"), F.stddev_samp(F.when(r < 0, r)).alias("_dd"),
        F.avg("mfe").alias("avg_mfe"), F.avg("mae").alias("avg_mae"))
    mid = order_stats.quantiles(rows, keys, "net", {"median_return": 0.5}).drop("_n")
    blocks = rows.withColumn("_block", prefix.key_block(rows, tie))
    fall = prefix.max_drawdown(blocks, keys, [day, "_block"], [day, tie], "net")
    pf = F.when(F.col("_loss") == 0, F.when(F.col("_win") > 0, F.lit(float("inf"))).otherwise(0.0)
                ).otherwise(ratio(F.col("_win"), F.col("_loss")))
    sharpe = F.when((F.col("count") >= 2) & (F.col("_sd") > 0), ratio(F.col("avg_return"), F.col("_sd")))
    sortino = F.when((F.col("count") >= 2) & (F.col("_nd") >= 2) & (F.col("_dd") > 0),
                     ratio(F.col("avg_return"), F.col("_dd")))
    return agg.join(mid, keys).join(fall, keys).select(
        *keys, "count", "win_rate", "avg_return", "median_return", pf.alias("profit_factor"),
        F.col("avg_return").alias("expectancy"), "max_drawdown",
        F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"), F.coalesce(sortino, F.lit(0.0)).alias("sortino"),
        "avg_mfe", "avg_mae")


def success_rate(rows: DataFrame, cfg: Mapping[str, Any], keys: Sequence[str] = ()) -> DataFrame:
    """Share of decided signals whose excursions met the goal at the success horizon."""
    s = cfg["success"]
    won = (F.col("mfe") >= s["min_mfe"]) & (F.col("mae") >= -s["max_mae"])
    return rows.where(F.col("horizon") == s["horizon"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("decided"), F.avg(won.cast("double")).alias("success_rate"))
