"""Market regime per date: averages, slope, breadth, volatility, trend score, label."""
from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numbers import clamp, ratio, rounded
from tapeworks.operators import adjust, rolling
from tapeworks.operators.calendar import market_calendar


def breadth(prices: DataFrame, actions: DataFrame | None) -> DataFrame:
    """Advancers and decliners against the adjusted close of the previous *market* day."""
    cal = market_calendar(prices).select("data_date", "day_no")
    bars = prices.select("symbol", "data_date", F.col("close").cast("double").alias("close"))
    if actions is None:
        bars = bars.withColumn("_cp", F.lit(1.0))
    else:
        bars = adjust.scale_to_date(bars, actions, {"_cp": "adj_factor"})
    w = Window.partitionBy("symbol").orderBy("data_date")
    bars = bars.join(cal, "data_date").withColumn("_n", F.col("close") / F.col("_cp"))
    prev = F.when(F.lag("day_no").over(w) == F.col("day_no") - 1, F.lag("_n").over(w))
    bars = bars.withColumn("_d", F.col("_n") - prev)
    return bars.groupBy("data_date").agg(
        F.count(F.when(F.col("_d") > 0, 1)).alias("advancers"),
        F.count(F.when(F.col("_d") < 0, 1)).alias("decliners"))


def index_inputs(index: DataFrame, r: Mapping[str, Any]) -> DataFrame:
    """Averages, slope of the short average and return volatility of the index series (one row a day)."""
    w = Window.partitionBy(F.lit(1)).orderBy("data_date")
    c = F.col("index_close")
    s = index.where(c.isNotNull()).select("data_date", c.cast("double").alias("index_close"))
    s = s.withColumn("_i", F.row_number().over(w)).withColumn(
        "_r", ratio(c - F.lag(c).over(w), F.lag(c).over(w)))
    s = s.withColumn("ma_short", rolling.sma(c, r["ma_short"], w)).withColumn(
        "ma_long", rolling.sma(c, r["ma_long"], w))
    n = r["slope_rows"]
    fit = F.regr_slope("ma_short", "_i").over(w.rowsBetween(-(n - 1), 0))
    return s.withColumn("ma_slope", F.when(F.col("_i") >= r["ma_short"] + n, fit)).withColumn(
        "volatility_pct", F.when(F.col("_i") >= r["vol_rows"] + 1, F.stddev_samp("_r").over(
            w.rowsBetween(-(r["vol_rows"] - 1), 0)))).drop("_i", "_r")


def trend_score(r: Mapping[str, Any]) -> Column:
    """Weighted signs of the averages, squashed slope, breadth and a volatility term, in [-1, 1]."""
    c, short, long, slope = (F.col(n) for n in ("index_close", "ma_short", "ma_long", "ma_slope"))
    up, down = F.col("advancers"), F.col("decliners")
    zero = F.lit(0.0)

    def sign(ma: Column, weight: float) -> Column:
        return F.when(ma.isNotNull(), F.when(c > ma, weight).otherwise(-weight)).otherwise(zero)

    tilt = F.tanh(ratio(slope, short) * 60 / r["slope_scale"] * 0.01)
    vol = F.col("volatility_pct")
    score = (
        sign(short, r["above_short"]) + sign(long, r["above_long"])
        + F.when(slope.isNotNull() & (short != 0), r["slope"] * tilt).otherwise(zero)
        + r["breadth"] * F.coalesce(ratio(up - down, up + down), zero)
        + F.when(vol.isNull(), zero).when(vol > r["high_vol"], -r["volatility"]).otherwise(0.5 * r["volatility"]))
    return clamp(score)


def build_market(index: DataFrame, prices: DataFrame, actions: DataFrame | None,
                 cfg: Mapping[str, Any]) -> DataFrame:
    r = cfg["regime"]
    m = index_inputs(index, r).join(breadth(prices, actions), "data_date", "left").fillna(
        0, ["advancers", "decliners"])
    return m.withColumn("market_trend_score", trend_score(r)).select(
        "data_date", rounded(F.col("index_close"), 2).alias("index_close"),
        rounded(F.col("ma_short"), 2).alias("ma_short"), rounded(F.col("ma_long"), 2).alias("ma_long"),
        "ma_slope", "advancers", "decliners", "volatility_pct", "market_trend_score")


# Labels by lower bound of the trend score, highest first.
REGIMES = [(0.4, "多頭"), (0.15, "偏多")]
REGIME_NEUTRAL, REGIME_SOFT, REGIME_BEAR = "中性", "偏空", "空頭"


def regime_label(score: Column) -> Column:
    """Symmetric bands at 0.15 and 0.4; an unknown score reads as neutral."""
    out = F.when(score > -REGIMES[1][0], REGIME_NEUTRAL).when(score > -REGIMES[0][0], REGIME_SOFT).otherwise(
        REGIME_BEAR)
    for low, label in reversed(REGIMES):
        out = F.when(score >= low, label).otherwise(out)
    return F.when(score.isNull(), REGIME_NEUTRAL).otherwise(out)
