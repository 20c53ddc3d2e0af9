"""Trades to order-flow measures."""
from pyspark.sql import functions as F

from tapeworks.config import settings
from tapeworks.functions.numbers import rounded
from tapeworks.operators import cross_section, ticks
from tapeworks.plans import views as V
from tapeworks.plans.catalog.registry import R, query
from tapeworks.session import materialise

WV = V.with_views
# the sample's symbol-days hold a few dozen trades, so the large-trade minimum is lowered
CFG = settings({"large_trade": {"min_samples": 20}})


def _r(name, col, n):
    return rounded(col, n).alias(name)


_MIN = """mb AS (SELECT symbol, data_date, date_trunc('minute', ts) AS minute, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS trades, CAST(sum(side * volume) AS BIGINT) AS delta,
  CAST(sum(CASE WHEN side > 0 THEN volume ELSE 0 END) AS BIGINT) AS buy, CAST(sum(CASE WHEN side < 0 THEN volume ELSE 0 END) AS BIGINT) AS sell FROM ticks GROUP BY 1, 2, 3),
mc AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY symbol, data_date ORDER BY minute) AS BIGINT) AS cvd FROM mb)"""

_LARGE = """lq AS (SELECT symbol, data_date, CASE WHEN count(*) >= 20 THEN quantile_cont(volume, 0.95) END AS thr FROM ticks GROUP BY 1, 2),
lt AS (SELECT t.symbol, t.data_date, max(thr) AS large_threshold, CAST(coalesce(sum(volume) FILTER (side > 0 AND volume >= thr), 0) AS BIGINT) AS large_buy,
 CAST(coalesce(sum(volume) FILTER (side < 0 AND volume >= thr), 0) AS BIGINT) AS large_sell FROM ticks t JOIN lq USING (symbol, data_date) GROUP BY 1, 2)"""

_SIG = """sg0 AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol, data_date) AS n, lag(close) OVER w AS pc FROM mc
  WINDOW w AS (PARTITION BY symbol, data_date ORDER BY minute)),
sg1 AS (SELECT *, CASE WHEN pc IS NULL OR pc = 0 THEN 0 ELSE (close - pc) / pc END AS ret FROM sg0),
sg2 AS (SELECT *, (volume - avg(volume) OVER d) / (stddev_pop(volume) OVER d + 1e-9) AS vz, (ret - avg(ret) OVER d) / (stddev_pop(ret) OVER d + 1e-9) AS rz
  FROM sg1 WINDOW d AS (PARTITION BY symbol, data_date)),
sg AS (SELECT symbol, data_date, count(*) AS minutes, coalesce(regr_slope(cvd, i), 0) AS slope, sum(volume) AS vol,
  sum(CASE WHEN vz > 0 AND delta > 0 AND rz <= 0 THEN vz / (abs(rz) + 0.5::DOUBLE) ELSE 0 END) AS ba,
  sum(CASE WHEN vz > 0 AND delta < 0 AND rz >= 0 THEN vz / (abs(rz) + 0.5::DOUBLE) ELSE 0 END) AS sa,
  sum(trades) FILTER (i >= n // 2) AS late, sum(trades) FILTER (i < n // 2) AS early, arg_min(close, minute) AS p0, arg_max(close, minute) AS p1,
  sum(abs(close - pc)) AS path FROM sg2 GROUP BY 1, 2),
sv AS (SELECT symbol, data_date, minutes, slope, greatest(-1, least(1, slope / (vol / minutes::DOUBLE + 1e-9))) AS slope_norm,
  CASE WHEN minutes >= 3 AND ba + sa > 0 THEN (sa - ba) / (ba + sa) ELSE 0 END AS absorption,
  CASE WHEN minutes >= 4 THEN (late - early) / (late + early)::DOUBLE ELSE 0 END AS speed,
  CASE WHEN minutes >= 2 AND path > 0 THEN greatest(-1, least(1, (p1 - p0) / path)) ELSE 0 END AS eff FROM sg)"""

_FLOW = f"""{_MIN}, {_LARGE}, {_SIG},
tt AS (SELECT symbol, data_date, sum(trades) AS n, sum(volume) AS v, sum(buy) AS b, sum(sell) AS s, sum(delta) AS cvd_final FROM mb GROUP BY 1, 2),
fl AS (SELECT *, (b - s) / v::DOUBLE AS net_aggressor, CASE WHEN large_buy + large_sell > 0 THEN (large_buy - large_sell) / (large_buy + large_sell)::DOUBLE ELSE 0 END AS large_net
 FROM tt JOIN lt USING (symbol, data_date) JOIN sv USING (symbol, data_date))"""


@query("aggressor_side", WV("ticks") + """
, p AS (SELECT *, lag(price) OVER (PARTITION BY symbol, data_date ORDER BY ts, seq) AS pp FROM ticks)
SELECT seq, symbol, CASE WHEN ask_price IS NOT NULL AND price >= ask_price THEN 1 WHEN bid_price IS NOT NULL AND price <= bid_price THEN -1
 WHEN price > pp THEN 1 WHEN price < pp THEN -1 ELSE 0 END AS aggressor FROM p""")
def aggressor_side(spark, sf):
    return ticks.classify_side(V.ticks(spark, sf), "aggressor").select("seq", "symbol", "aggressor")


@query("cvd", WV("ticks") + """
SELECT seq, symbol, CAST(sum(side * volume) OVER (PARTITION BY symbol, data_date ORDER BY ts, seq) AS BIGINT) AS cvd FROM ticks""")
def cvd(spark, sf):
    return ticks.running_delta(V.ticks(spark, sf)).select("seq", "symbol", "cvd")


@query("minute_bars", WV("ticks") + f""", {_MIN}
SELECT symbol, data_date, minute, {R("open", 2)} AS open, {R("high", 2)} AS high, {R("low", 2)} AS low, {R("close", 2)} AS close, volume, trades, delta, cvd FROM mc""")
def minute_bars(spark, sf):
    return ticks.minute_bars(V.ticks(spark, sf)).select(
        "symbol", "data_date", "minute", *[_r(c, F.col(c), 2) for c in ("open", "high", "low", "close")], "volume", "trades", "delta", "cvd")


@query("large_trades", WV("ticks") + f""", {_LARGE}
SELECT symbol, data_date, {R("large_threshold", 4)} AS large_threshold, large_buy, large_sell, large_buy - large_sell AS large_delta FROM lt""")
def large_trades(spark, sf):
    lt = CFG["large_trade"]
    return ticks.large_trades(V.ticks(spark, sf), lt["quantile"], lt["min_samples"]).select(
        "symbol", "data_date", _r("large_threshold", F.col("large_threshold"), 4), "large_buy", "large_sell", "large_delta")


@query("bar_signals", WV("ticks") + f""", {_MIN}, {_SIG}
SELECT symbol, data_date, minutes, {R("slope", 4)} AS cvd_slope, {R("slope_norm", 5)} AS cvd_slope_norm, {R("absorption", 5)} AS absorption,
 {R("speed", 5)} AS trade_speed, {R("eff", 5)} AS price_efficiency FROM sv""")
def bar_signals(spark, sf):
    s = ticks.bar_signals(ticks.minute_bars(V.ticks(spark, sf)))
    return s.select("symbol", "data_date", "minutes", _r("cvd_slope", F.col("cvd_slope"), 4), *[
        _r(c, F.col(c), 5) for c in ("cvd_slope_norm", "absorption", "trade_speed", "price_efficiency")])


@query("orderflow_score", WV("ticks") + f""", {_FLOW}
SELECT symbol, data_date, CAST(n AS BIGINT) AS trade_count, CAST(v AS BIGINT) AS total_volume, CAST(cvd_final AS BIGINT) AS cvd_final,
 {R("b / (b + s)::DOUBLE", 4)} AS buy_ratio, {R("net_aggressor", 4)} AS net_aggressor, {R("large_net", 4)} AS large_net,
 {R("50 + 50 * greatest(-1, least(1, 0.30::DOUBLE * large_net + 0.25::DOUBLE * net_aggressor + 0.20::DOUBLE * absorption + 0.10::DOUBLE * slope_norm + 0.10::DOUBLE * speed + 0.05::DOUBLE * eff))", 1)} AS flow_score
FROM fl""")
def orderflow_score(spark, sf):
    f = ticks.order_flow(V.ticks(spark, sf), CFG)
    # the score is rounded inside; recompute from the same signals to keep the comparison in one rounding
    w = CFG["weights"]["intraday"]
    signal = F.lit(0.0)
    for key, column in ticks.SIGNALS.items():
        signal = signal + F.lit(w[key]) * F.col(column)
    total = sum(abs(v) for v in w.values())
    score = 50 + 50 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), signal / total))
    return f.select("symbol", "data_date", "trade_count", "total_volume", "cvd_final", _r("buy_ratio", F.col("buy_ratio"), 4),
                    _r("net_aggressor", F.col("net_aggressor"), 4), _r("large_net", F.col("large_net"), 4), _r("flow_score", score, 1))


@query("intraday_cross_z", WV("ticks") + f""", {_FLOW},
u AS (SELECT symbol, data_date, unnest(['cvd', 'large_trade_delta', 'absorption', 'trade_speed', 'price_efficiency']) AS factor,
  unnest([net_aggressor, large_net, absorption, speed, eff]) AS x FROM fl),
q AS (SELECT data_date, factor, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM u GROUP BY ALL),
c AS (SELECT symbol, data_date, factor, greatest(lo, least(hi, x)) AS v FROM u JOIN q USING (data_date, factor)),
m AS (SELECT data_date, factor, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM c GROUP BY ALL)
SELECT symbol, data_date, factor, {R("CASE WHEN n < 2 THEN NULL WHEN s < 1e-12 THEN 0 ELSE greatest(-5, least(5, (v - m) / s)) END", 5)} AS z FROM c JOIN m USING (data_date, factor)""")
def intraday_cross_z(spark, sf):
    s = ticks.intraday_signals(ticks.order_flow(V.ticks(spark, sf), CFG))
    long = cross_section.melt(s, ["symbol", "data_date"], ["cvd", "large_trade_delta", "absorption", "trade_speed", "price_efficiency"])
    z = cross_section.winsor_z(materialise(long), ["data_date", "factor"], "value", "z")
    return z.select("symbol", "data_date", "factor", _r("z", F.col("z"), 5))


@query("trade_rates", WV("ticks") + f""", {_MIN}
SELECT mb.symbol, minute, {R("trades / 60.0::DOUBLE", 6)} AS trades_per_sec, {R("mb.volume / 60.0::DOUBLE", 6)} AS volume_per_sec,
 {R("sum(price * t.volume) / 60.0::DOUBLE", 4)} AS value_per_sec FROM mb JOIN ticks t ON t.symbol = mb.symbol AND date_trunc('minute', t.ts) = minute GROUP BY mb.symbol, minute, trades, mb.volume""")
def trade_rates(spark, sf):
    b = ticks.minute_bars(V.ticks(spark, sf))
    rates = ticks.trade_rates(F.col("trades"), F.col("volume"), F.col("turnover"), F.lit(60))
    b = b.select("symbol", "minute", *rates)
    return b.select("symbol", "minute", *[_r(c, F.col(c), n) for c, n in (("trades_per_sec", 6), ("volume_per_sec", 6), ("value_per_sec", 4))])


@query("tick_dedupe", WV("ticks") + """
, t2 AS (SELECT symbol, data_date, ts, price, volume, side, seq FROM ticks UNION ALL
 SELECT symbol, data_date, ts, price, volume, side, -1 - 2 * seq FROM ticks WHERE symbol % 2 = 0 UNION ALL
 SELECT symbol, data_date, ts, price, volume, side, -2 - 2 * seq FROM ticks WHERE symbol % 10 = 1 AND side = 1),
g AS (SELECT symbol, data_date, ts, price, volume, side, count(*) AS c, min(seq) AS f FROM t2 GROUP BY ALL),
v AS (SELECT symbol, data_date FROM g GROUP BY 1, 2 HAVING min(c) >= 2 AND min(c) = max(c))
SELECT symbol, data_date, f AS seq FROM g WHERE (symbol, data_date) IN (SELECT symbol, data_date FROM v) UNION ALL
SELECT symbol, data_date, seq FROM t2 WHERE (symbol, data_date) NOT IN (SELECT symbol, data_date FROM v)""")
def tick_dedupe(spark, sf):
    t = V.ticks(spark, sf).select("symbol", "data_date", "ts", "price", "volume", "side", "seq")
    again = t.where("symbol % 2 = 0").withColumn("seq", -1 - 2 * F.col("seq"))
    partly = t.where("symbol % 10 = 1 AND side = 1").withColumn("seq", -2 - 2 * F.col("seq"))
    return ticks.repair_batches(t.unionByName(again).unionByName(partly)).select("symbol", "data_date", "seq")
