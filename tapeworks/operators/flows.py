"""Price against institutional flow: divergence, estimated cost, panel."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numbers import pearson, ratio
from tapeworks.operators import rolling


def vwap(turnover, volume, close):
    """Turnover over volume where both are known and non-zero, else the close."""
    ok = (F.coalesce(turnover, F.lit(0.0)) != 0) & (F.coalesce(volume, F.lit(0.0)) != 0)
    return F.when(ok, ratio(turnover, volume)).otherwise(close)


def divergence(panel: DataFrame, window: int, cfg: Mapping[str, Any], close: str = "close",
               net: str = "net", volume: str = "volume") -> DataFrame:
    """Status of every (symbol, date) over its last ``window`` rows.

    Adds price_return, inst_net, flow_ratio, price_flow_corr and status. All terms are sums,
    first and last values over one frame, so a single sort by symbol serves them.
    """
    w = rolling.series()
    frame = w.rowsBetween(-(window - 1), 0)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    valid = F.col(close) > 0
    p = panel.withColumn("_c", F.when(valid, F.col(close)))
    p = p.withColumn("_prev", F.last("_c", ignorenulls=True).over(so_far))
    pair = F.col("_c").isNotNull() & F.col("_prev").isNotNull() & F.col(net).isNotNull()
    x = F.try_divide(F.col("_c"), F.col("_prev")) - 1.0
    y = F.col(net).cast("double")
    terms = F.struct(*[F.when(pair, t).otherwise(F.lit(0.0)).alias(n) for n, t in {
        "n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}.items()])
    p = p.withColumn("_t", terms)
    # The first valid close of the frame has its predecessor outside the frame: take its pair out.
    lead = F.first(F.when(F.col("_c").isNotNull(), F.col("_t")), ignorenulls=True).over(frame)
    p = p.withColumn("_lead", lead)
    s = {n: F.sum(F.col(f"_t.{n}")).over(frame) - F.coalesce(F.col(f"_lead.{n}"), F.lit(0.0))
         for n in ("n", "x", "y", "xx", "yy", "xy")}
    p = p.withColumns({f"_s_{n}": v for n, v in s.items()})
    closes = F.count("_c").over(frame)
    vol = F.sum(volume).over(frame)
    p = p.withColumns({
        "price_return": F.when(closes >= 2, F.try_divide(
            F.last("_c", ignorenulls=True).over(frame),
            F.first("_c", ignorenulls=True).over(frame)) - 1.0),
        "inst_net": F.coalesce(F.sum(net).over(frame), F.lit(0.0)),
        "_vol": vol,
        "_points": F.least(closes, F.count(net).over(frame)),
    })
    p = p.withColumn("flow_ratio", F.when(F.col("_vol") > 0, ratio(F.col("inst_net"), F.col("_vol"))))
    p = p.withColumn("price_flow_corr", pearson(
        F.round("_s_n"), *[F.col(f"_s_{n}") for n in ("x", "y", "xx", "yy", "xy")]))
    pe, fe = cfg["price_eps"], cfg["flow_eps"]
    up, down = F.col("price_return") >= pe, F.col("price_return") <= -pe
    inflow, outflow = F.col("flow_ratio") >= fe, F.col("flow_ratio") <= -fe
    unknown = ((F.col("_points") < cfg["min_points"]) | F.col("price_return").isNull()
               | F.col("flow_ratio").isNull())
    status = (
        F.when(unknown, "neutral").when(down & inflow, "bullish_div").when(up & outflow, "bearish_div")
        .when(up & inflow, "aligned_up").when(down & outflow, "aligned_down").otherwise("neutral"))
    helpers = ["_c", "_prev", "_t", "_lead", "_vol", "_points", *[f"_s_{n}" for n in s]]
    return p.withColumn("status", status).drop(*helpers)


def cost_basis(panel: DataFrame, price: str, net: str, keys: Sequence[str] = ("symbol",),
               date: str = "data_date") -> DataFrame:
    """Moving weighted-average cost of the accumulated net position after every row.

    Buys re-average, sells keep the cost, an emptied position resets.

    * position = S - min(0, running min of S) with S the running net - a walk reflected at 0;
    * every row maps the cost before it to a * cost + b: a buy keeps the share a = position before / position
      after of it, an emptied position keeps nothing. Two rows in order compose to (a a', a' b + b'), all shares are
      at most 1 and nothing is divided by a product of them;
    * the rows of one year of a symbol are folded in order, and the years' own (a, b) give each year the cost it
      starts with. A daily table has a few hundred rows per symbol and year, so no array grows with the history.
    """
    keys, own = list(keys), [F.col(c) for c in panel.columns]
    w = Window.partitionBy(*keys).orderBy(date)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    active = F.col(price).isNotNull() & (F.col(price) > 0) & F.col(net).isNotNull()
    p = panel.withColumn("_n", F.when(active, F.col(net).cast("double")).otherwise(0.0))
    p = p.withColumn("_s", F.sum("_n").over(so_far))
    p = p.withColumn("position", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(so_far)))
    before, after = F.coalesce(F.lag("position").over(w), F.lit(0.0)), F.col("position")
    p = p.withColumn("_before", before)
    held = F.when(after <= 0, 0.0).when(F.col("_n") > 0, F.col("_before") / after).otherwise(1.0)
    paid = F.when((after > 0) & (F.col("_n") > 0), F.col("_n") * F.col(price) / after).otherwise(0.0)
    p = p.select(*keys, F.year(date).alias("_year"),
                 F.struct(F.col(date).alias("at"), held.alias("a"), paid.alias("b"), F.struct(*own, "position").alias("row")).alias("_x"))
    years = p.groupBy(*keys, "_year").agg(F.array_sort(F.collect_list("_x"), lambda x, y: F.when(x["at"] < y["at"], -1).when(
        x["at"] > y["at"], 1).otherwise(0)).alias("_rows"))
    pair = "struct<a:double,b:double>"
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.array().cast(f"array<{pair}>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["a"] * x["a"], x["a"] * acc["b"] + x["b"]
        return F.struct(a.alias("a"), b.alias("b"), F.concat(acc["all"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("all"))

    years = years.withColumn("_fold", F.aggregate("_rows", none, step))
    earlier = Window.partitionBy(*keys).orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    past = F.collect_list(F.struct(F.col("_fold.a").alias("a"), F.col("_fold.b").alias("b"))).over(earlier)
    years = years.withColumn("_start", F.aggregate(past, F.lit(0.0), lambda c, x: x["a"] * c + x["b"]))
    flat = years.select("_start", F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_fold.all").alias("f"))).alias("z"))
    cost = F.when(F.col("z.r.row.position") > 0, F.col("z.f.a") * F.col("_start") + F.col("z.f.b"))
    return flat.select("z.r.row.*", cost.alias("cost"))


def cost_state(cost, price, eps: float):
    """(premium, state) of the latest price against the estimated cost."""
    premium = F.when((cost > 0) & price.isNotNull(), F.try_divide(price, cost) - 1.0)
    state = (F.when(premium.isNull(), "unknown").when(premium > eps, "profit")
             .when(premium < -eps, "loss").otherwise("flat"))
    return premium, state


def last_positive(price: str):
    w = rolling.series().rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(F.col(price) > 0, F.col(price)), ignorenulls=True).over(w)
