"""Order flow from trades: side, minute bars, large trades, absorption, speed, efficiency, score.

Trades are reduced to minute bars and to volume counts before any window runs; every window after
that sees at most one row per minute of the day. A symbol-day with a third of all trades is
therefore combined map-side, not sent to one task.
"""
from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numbers import clamp, ratio
from tapeworks.operators import order_stats, prefix

DAY = ["symbol", "data_date"]

# Score weight key -> bounded signal column.
SIGNALS = {
    "large_trade_delta": "large_net", "cvd": "net_aggressor", "cvd_slope": "cvd_slope_norm",
    "absorption": "absorption", "trade_speed": "trade_speed", "price_efficiency": "price_efficiency",
}


def quote_side(price: Column, bid: Column, ask: Column, prev_price: Column) -> Column:
    """1 buy, -1 sell, 0 unknown: quotes first, then the last price change; never forced."""
    return (
        F.when(ask.isNotNull() & (price >= ask), 1)
        .when(bid.isNotNull() & (price <= bid), -1)
        .when(price > prev_price, 1).when(price < prev_price, -1).otherwise(0)
    )


def classify_side(ticks: DataFrame, out: str = "side") -> DataFrame:
    """Aggressor side of every trade; the previous price is found range by range, however busy a minute is."""
    t = prefix.previous_value(ticks, DAY, None, ["ts", "seq"], "price", "_prev")
    return t.withColumn(out, quote_side(
        F.col("price"), F.col("bid_price"), F.col("ask_price"), F.col("_prev"))).drop("_prev")


def running_delta(ticks: DataFrame, out: str = "cvd") -> DataFrame:
    """Cumulative signed volume after every trade of the day."""
    return prefix.running_sum(ticks, DAY, None, ["ts", "seq"], F.col("side") * F.col("volume"), out)


def minute_bars(ticks: DataFrame) -> DataFrame:
    """Per (symbol, day, minute): OHLC, volume, trades, delta, turnover, and running delta."""
    at = F.struct("ts", "seq")
    delta = F.col("side") * F.col("volume")
    bars = ticks.groupBy(*DAY, F.date_trunc("minute", "ts").alias("minute")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("trades"),
        F.sum(F.when(F.col("side") > 0, F.col("volume")).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(F.col("side") < 0, F.col("volume")).otherwise(0)).alias("sell_volume"),
        F.sum(delta).alias("delta"),
        F.sum(F.col("price") * F.col("volume")).alias("turnover"),
    )
    w = Window.partitionBy(*DAY).orderBy("minute")
    return bars.withColumn(
        "cvd", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "vwap", ratio(F.col("turnover"), F.col("volume")))


def large_trades(ticks: DataFrame, q: float = 0.95, min_samples: int = 500) -> DataFrame:
    """Day threshold (quantile of trade volumes, NULL below the minimum) and large buy/sell volume.

    Works on (side, volume) counts: a day has few distinct trade sizes however many trades it has.
    """
    counts = ticks.groupBy(*DAY, "side", "volume").agg(F.count(F.lit(1)).alias("_c"))
    thr = order_stats.quantiles(counts, DAY, "volume", {"_q": q}, weight="_c").select(
        *DAY, F.when(F.col("_n") >= min_samples, F.col("_q")).alias("large_threshold"))
    big = F.when(F.col("volume") >= F.col("large_threshold"), F.col("volume") * F.col("_c"))
    agg = counts.join(thr, DAY).groupBy(*DAY).agg(
        F.max("large_threshold").alias("large_threshold"),
        F.coalesce(F.sum(F.when(F.col("side") > 0, big)), F.lit(0)).alias("large_buy"),
        F.coalesce(F.sum(F.when(F.col("side") < 0, big)), F.lit(0)).alias("large_sell"))
    total = F.col("large_buy") + F.col("large_sell")
    return agg.withColumn("large_delta", F.col("large_buy") - F.col("large_sell")).withColumn(
        "large_net", F.coalesce(ratio(F.col("large_buy") - F.col("large_sell"), total), F.lit(0.0)))


def absorption_terms(volume_z: Column, return_z: Column, side: Column,
                     eps: float = 0.5) -> tuple[Column, Column]:
    """(buy, sell) absorption: volume that moved price less than it should have."""
    score = volume_z / (F.abs(return_z) + eps)
    sell = F.when((side < 0) & (return_z >= 0), score).otherwise(0.0)
    buy = F.when((side > 0) & (return_z <= 0), score).otherwise(0.0)
    return buy, sell


def bar_signals(bars: DataFrame) -> DataFrame:
    """Day signals from minute bars: slope, absorption, speed change, path efficiency."""
    day = Window.partitionBy(*DAY)
    w = day.orderBy("minute")
    prev = F.lag("close").over(w)
    b = (
        bars.withColumn("_i", F.row_number().over(w) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(day))
        .withColumn("_ret", F.when(prev.isNull() | (prev == 0), F.lit(0.0))
                    .otherwise(F.try_divide(F.col("close") - prev, prev)))
        .withColumn("_step", F.abs(F.col("close") - prev))
    )
    vz = (F.col("volume") - F.avg("volume").over(day)) / (F.stddev_pop("volume").over(day) + 1e-9)
    rz = (F.col("_ret") - F.avg("_ret").over(day)) / (F.stddev_pop("_ret").over(day) + 1e-9)
    b = b.withColumn("_vz", vz).withColumn("_rz", rz)
    buy, sell = absorption_terms(F.col("_vz"), F.col("_rz"), F.col("delta"))
    busy = F.col("_vz") > 0
    late = F.col("_i") >= F.floor(F.col("_n") / 2)
    agg = b.groupBy(*DAY).agg(
        F.max("_n").alias("minutes"),
        F.regr_slope("cvd", "_i").alias("_slope"),
        F.sum("volume").alias("_vol"),
        F.sum(F.when(busy, buy)).alias("_buy_abs"), F.sum(F.when(busy, sell)).alias("_sell_abs"),
        F.sum(F.when(late, F.col("trades"))).alias("_late"),
        F.sum(F.when(~late, F.col("trades"))).alias("_early"),
        F.min_by("close", "minute").alias("_first"), F.max_by("close", "minute").alias("_last"),
        F.sum("_step").alias("_path"),
    )
    zero = F.lit(0.0)
    absorbed = F.col("_buy_abs") + F.col("_sell_abs")
    slope = F.coalesce(F.col("_slope"), zero)
    return agg.select(
        *DAY, "minutes", slope.alias("cvd_slope"),
        clamp(slope / (F.col("_vol") / F.col("minutes") + 1e-9)).alias("cvd_slope_norm"),
        F.when((F.col("minutes") >= 3) & (absorbed > 0),
               clamp(ratio(F.col("_sell_abs") - F.col("_buy_abs"), absorbed)))
        .otherwise(zero).alias("absorption"),
        F.when(F.col("minutes") >= 4, clamp(ratio(
            F.col("_late") - F.col("_early"), F.col("_late") + F.col("_early"))))
        .otherwise(zero).alias("trade_speed"),
        F.when((F.col("minutes") >= 2) & (F.col("_path") > 0),
               clamp(ratio(F.col("_last") - F.col("_first"), F.col("_path"))))
        .otherwise(zero).alias("price_efficiency"),
    )


def order_flow(ticks: DataFrame, cfg: Mapping[str, Any], bars: DataFrame | None = None) -> DataFrame:
    """Totals, bounded signals and the 0-100 order-flow score per symbol-day."""
    bars = minute_bars(ticks) if bars is None else bars
    totals = bars.groupBy(*DAY).agg(
        F.sum("trades").alias("trade_count"), F.sum("volume").alias("total_volume"),
        F.sum("buy_volume").alias("buy_volume"), F.sum("sell_volume").alias("sell_volume"),
        F.sum("delta").alias("cvd_final"))
    lt = cfg["large_trade"]
    flow = (
        totals.join(large_trades(ticks, lt["quantile"], lt["min_samples"]), DAY)
        .join(bar_signals(bars), DAY)
        .withColumn("buy_ratio", F.coalesce(ratio(
            F.col("buy_volume"), F.col("buy_volume") + F.col("sell_volume")), F.lit(0.0)))
        .withColumn("net_aggressor", F.coalesce(ratio(
            F.col("buy_volume") - F.col("sell_volume"), F.col("total_volume")), F.lit(0.0)))
    )
    weights = cfg["weights"]["intraday"]
    total = sum(abs(v) for v in weights.values()) or 1.0
    signal = F.lit(0.0)
    for key, column in SIGNALS.items():
        signal = signal + F.lit(weights[key]) * F.col(column)
    return flow.withColumn("flow_score", F.round(50 + 50 * clamp(signal / total), 1))


def book_imbalance(bids: Column, asks: Column) -> Column:
    """(sum of bids - sum of asks) / both, 0 for an empty book."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))
    b, a = total(bids), total(asks)
    return F.coalesce(ratio(b - a, b + a), F.lit(0.0))


def trade_rates(trades: Column, volume: Column, value: Column, seconds: Column) -> list[Column]:
    s = F.greatest(seconds.cast("double"), F.lit(1e-9))
    return [(trades / s).alias("trades_per_sec"), (volume / s).alias("volume_per_sec"),
            (value / s).alias("value_per_sec")]


def price_delta_divergence(bars: DataFrame, keys: list[str], order: str = "minute") -> DataFrame:
    """+1 price not up but running delta up, -1 price up but delta not, else 0 (two bars needed)."""
    agg = bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("close", order).alias("_p0"), F.max_by("close", order).alias("_p1"),
        F.min_by("cvd", order).alias("_c0"), F.max_by("cvd", order).alias("_c1"))
    price_up, delta_up = F.col("_p1") > F.col("_p0"), F.col("_c1") > F.col("_c0")
    flag = (F.when(F.col("_n") < 2, 0).when(price_up & ~delta_up, -1)
            .when(~price_up & delta_up, 1).otherwise(0))
    return agg.select(*keys, flag.alias("divergence"))


def repair_batches(ticks: DataFrame) -> DataFrame:
    """Undo whole-batch re-deliveries: symbol-days in which every distinct trade occurs the same
    k >= 2 times keep the first arrival of each trade; all other days keep every row."""
    fields = [c for c in ticks.columns if c != "seq"]
    copies = ticks.groupBy(*fields).agg(F.count(F.lit(1)).alias("_c"), F.min("seq").alias("_first"))
    verdict = copies.groupBy(*DAY).agg(
        ((F.min("_c") >= 2) & (F.min("_c") == F.max("_c"))).alias("_batch"))
    cond = F.lit(True)
    for i, c in enumerate(fields):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_f{i}"))
    bad = copies.join(verdict.where("_batch"), DAY, "left_semi").select(
        *[F.col(c).alias(f"_f{i}") for i, c in enumerate(fields)], "_first")
    return ticks.join(bad, cond, "left").where(
        F.col("_first").isNull() | (F.col("_first") == F.col("seq"))).select(*ticks.columns)


def intraday_signals(flow: DataFrame) -> DataFrame:
    """Rename order-flow signals to the keys the cross-sectional step standardises."""
    return flow.select(*DAY, F.col("net_aggressor").alias("cvd"),
                       F.col("large_net").alias("large_trade_delta"), "absorption", "trade_speed",
                       "price_efficiency", "cvd_slope_norm")
