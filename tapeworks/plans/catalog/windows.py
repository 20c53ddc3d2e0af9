"""Rolling, cumulative and market-day windows over bars."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.config import DEFAULTS
from tapeworks.functions.numbers import net_return, rounded
from tapeworks.operators import backtest, calendar, joins, prefix, rolling
from tapeworks.plans import reports
from tapeworks.plans import views as V
from tapeworks.plans.catalog.registry import R, query

WV = V.with_views
_BY = "(PARTITION BY symbol ORDER BY data_date)"
_C = DEFAULTS["backtest"]


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY data_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _r(name, col, n):
    return rounded(col, n).alias(name)


@query("sma_min_rows", WV("bars") + f"""
SELECT symbol, data_date, {R(f"CASE WHEN count(*) OVER {_frame(20)} = 20 THEN avg(close) OVER {_frame(20)} END", 4)} AS ma20 FROM bars""")
def sma_min_rows(spark, sf):
    return V.bars(spark, sf).select("symbol", "data_date", _r("ma20", rolling.sma(F.col("close"), 20, rolling.series()), 4))


@query("atr", WV("bars") + f"""
, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {_BY}), abs(low - lag(close) OVER {_BY})) AS tr FROM bars)
SELECT symbol, data_date, {R("tr", 4)} AS true_range, {R(f"CASE WHEN count(*) OVER {_frame(15)} = 15 THEN avg(tr) OVER {_frame(14)} END", 4)} AS atr14 FROM t""")
def atr(spark, sf):
    w = rolling.series()
    b = V.bars(spark, sf).withColumn("tr", rolling.true_range(F.col("high"), F.col("low"), F.col("close"), w))
    return b.select("symbol", "data_date", _r("true_range", F.col("tr"), 4), _r("atr14", rolling.atr("tr", 14, w), 4))


@query("swing_and_resistance", WV("bars") + f"""
SELECT symbol, data_date, {R(f"min(low) OVER {_frame(10)}", 4)} AS swing_low,
 {R(f"CASE WHEN count(*) OVER {_frame(20)} >= 20 THEN max(high) OVER {_frame(20)} END", 4)} AS resistance FROM bars""")
def swing_and_resistance(spark, sf):
    w = rolling.series()
    return V.bars(spark, sf).select("symbol", "data_date", _r("swing_low", rolling.lowest(F.col("low"), 10, w), 4),
                                    _r("resistance", rolling.highest(F.col("high"), 20, w, 20), 4))


@query("momentum", WV("bars") + f"""
SELECT symbol, data_date, {R(f"close / lag(close) OVER {_BY} - 1", 6)} AS change_pct, {R(f"close / lag(close, 5) OVER {_BY} - 1", 6)} AS mom5,
 {R(f"close / lag(close, 20) OVER {_BY} - 1", 6)} AS mom20, {R(f"close / lag(close, 60) OVER {_BY} - 1", 6)} AS mom60,
 {R(f"-(close / lag(close, 5) OVER {_BY} - 1)", 6)} AS reversal FROM bars""")
def momentum(spark, sf):
    w, c = rolling.series(), F.col("close")
    return V.bars(spark, sf).select("symbol", "data_date", _r("change_pct", rolling.change(c, 1, w), 6), *[
        _r(f"mom{n}", rolling.change(c, n, w), 6) for n in (5, 20, 60)], _r("reversal", -rolling.change(c, 5, w), 6))


@query("net_window_market_days", WV("bars", "flows", "cal") + """
, d AS (SELECT f.symbol, f.data_date, c.day_no, f.foreign_net FROM flows f JOIN cal c USING (data_date))
SELECT symbol, data_date, CAST(CASE WHEN day_no >= 5 THEN sum(foreign_net) OVER (PARTITION BY symbol ORDER BY day_no RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) END AS BIGINT) AS net5
FROM d""")
def net_window_market_days(spark, sf):
    f = calendar.with_day_no(V.flows(spark, sf), calendar.market_calendar(V.bars(spark, sf)))
    return f.select("symbol", "data_date", rolling.market_day_sum(F.col("foreign_net"), 5).alias("net5"))


@query("asof_change", WV("bars", "flows", "cal") + f"""
, d AS (SELECT f.symbol, f.data_date, c.day_no, f.short_balance AS v FROM flows f JOIN cal c USING (data_date)),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day_no RANGE BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING) AS base FROM d)
SELECT symbol, data_date, v - base AS change_abs, {R("CASE WHEN base > 0 THEN (v - base) / base::DOUBLE END", 6)} AS change_pct FROM b""")
def asof_change(spark, sf):
    f = calendar.with_day_no(V.flows(spark, sf), calendar.market_calendar(V.bars(spark, sf)))
    b = f.withColumn("base", rolling.asof_base("short_balance", 5)["v"])
    v, base = F.col("short_balance"), F.col("base")
    return b.select("symbol", "data_date", (v - base).alias("change_abs"),
                    _r("change_pct", F.when(base > 0, (v - base) / base), 6))


@query("regression_slope", WV("bars") + f"""
, i AS (SELECT *, row_number() OVER {_BY} AS k FROM bars)
SELECT symbol, data_date, {R(f"CASE WHEN count(*) OVER {_frame(20)} = 20 THEN regr_slope(close, k) OVER {_frame(20)} END", 4)} AS slope FROM i""")
def regression_slope(spark, sf):
    w = rolling.series()
    b = V.bars(spark, sf).withColumn("k", F.row_number().over(w))
    return b.select("symbol", "data_date", _r("slope", rolling.slope("close", "k", 20, w), 4))


@query("max_drawdown", WV("bars") + f"""
, r AS (SELECT symbol, data_date, (close - open) / open AS ret FROM bars),
e AS (SELECT symbol, data_date, sum(ret) OVER (PARTITION BY symbol ORDER BY data_date) AS eq FROM r),
t AS (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY data_date) AS top FROM e)
SELECT symbol, {R("min(eq - top)", 6)} AS max_drawdown FROM t GROUP BY 1""")
def max_drawdown(spark, sf):
    r = V.bars(spark, sf).select("symbol", "data_date", ((F.col("close") - F.col("open")) / F.col("open")).alias("ret"),
                                 F.date_trunc("quarter", "data_date").alias("q"))
    d = prefix.max_drawdown(r, ["symbol"], ["q"], ["data_date"], "ret")
    return d.select("symbol", _r("max_drawdown", F.col("max_drawdown"), 6))


@query("volatility", WV("bars") + f"""
, r AS (SELECT *, close / lag(close) OVER {_BY} - 1 AS ret FROM bars)
SELECT symbol, data_date, {R(f"CASE WHEN count(ret) OVER {_frame(20)} = 20 THEN stddev_samp(ret) OVER {_frame(20)} END", 6)} AS vol20 FROM r""")
def volatility(spark, sf):
    w = rolling.series()
    b = V.bars(spark, sf).withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    return b.select("symbol", "data_date", _r("vol20", rolling.volatility("ret", 20, w), 6))


@query("balance_changes", WV("flows") + f"""
SELECT symbol, data_date, margin_balance - lag(margin_balance, 5) OVER {_BY} AS chg5, margin_balance - lag(margin_balance, 20) OVER {_BY} AS chg20,
 {R(f"CASE WHEN lag(margin_balance, 20) OVER {_BY} > 0 THEN margin_balance / lag(margin_balance, 20) OVER {_BY}::DOUBLE - 1 END", 6)} AS pct20,
 CAST(CASE WHEN count(*) OVER {_frame(5)} = 5 THEN sum(foreign_net) OVER {_frame(5)} END AS BIGINT) AS net5 FROM flows""")
def balance_changes(spark, sf):
    w, m = rolling.series(), F.col("margin_balance")
    return V.flows(spark, sf).select(
        "symbol", "data_date", rolling.difference(m, 5, w).alias("chg5"), rolling.difference(m, 20, w).alias("chg20"),
        _r("pct20", rolling.change(m, 20, w), 6),
        F.when(rolling.rows_in(w, 5) == 5, F.sum("foreign_net").over(w.rowsBetween(-4, 0))).alias("net5"))


def _forward_sql(k: int) -> str:
    return f"lead(close, {k}) OVER {_BY}"


@query("forward_entry_exit", WV("bars", "cal") + f"""
, x AS (SELECT b.symbol, b.data_date, lead(b.data_date) OVER {_BY} AS nd, lead(open) OVER {_BY} AS entry, {_forward_sql(5)} AS exit5,
  {_forward_sql(20)} AS exit20, cal.next_date FROM bars b JOIN cal USING (data_date))
SELECT symbol, data_date, {R("entry", 4)} AS entry,
 {R("(exit5 * (1 - 0.005425::DOUBLE) - entry * (1 + 0.002425::DOUBLE)) / (entry * (1 + 0.002425::DOUBLE))", 6)} AS net5,
 {R("(exit20 * (1 - 0.005425::DOUBLE) - entry * (1 + 0.002425::DOUBLE)) / (entry * (1 + 0.002425::DOUBLE))", 6)} AS net20
FROM x WHERE nd = next_date""")
def forward_entry_exit(spark, sf):
    b = V.bars(spark, sf)
    e = backtest.entry_bars(b, [5, 20])
    nxt = calendar.market_calendar(b).select("data_date", F.col("next_date").alias("entry_date"))
    j = b.select("symbol", "data_date").join(nxt, "data_date").join(e, ["symbol", "entry_date"])
    return j.select("symbol", "data_date", _r("entry", F.col("entry_price"), 4), *[
        _r(f"net{k}", net_return(F.col("entry_price"), F.col(f"exit_{k}"), _C), 6) for k in (5, 20)])


@query("mfe_mae", WV("bars") + f"""
, x AS (SELECT symbol, data_date, open, lead(close, 4) OVER {_BY} AS e5,
 max(high) OVER (PARTITION BY symbol ORDER BY data_date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS h5,
 min(low) OVER (PARTITION BY symbol ORDER BY data_date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l5 FROM bars)
SELECT symbol, data_date AS entry_date, {R("h5 / open - 1", 6)} AS mfe5, {R("l5 / open - 1", 6)} AS mae5 FROM x WHERE e5 IS NOT NULL""")
def mfe_mae(spark, sf):
    e = backtest.entry_bars(V.bars(spark, sf), [5]).where("exit_5 IS NOT NULL")
    return e.select("symbol", "entry_date", _r("mfe5", F.col("high_5") / F.col("entry_price") - 1, 6),
                    _r("mae5", F.col("low_5") / F.col("entry_price") - 1, 6))


@query("price_position", WV("bars") + f"""
SELECT symbol, data_date, {R(f"CASE WHEN count(*) OVER {_frame(40)} = 40 AND max(close) OVER {_frame(40)} > min(close) OVER {_frame(40)} THEN (close - min(close) OVER {_frame(40)}) / (max(close) OVER {_frame(40)} - min(close) OVER {_frame(40)}) END", 6)} AS pos
FROM bars""")
def price_position(spark, sf):
    return V.bars(spark, sf).select("symbol", "data_date", _r(
        "pos", rolling.range_position(F.col("close"), 40, rolling.series()), 6))


@query("tail_sums", WV("flows") + f"""
SELECT symbol, data_date, CAST(sum(foreign_net) OVER {_frame(5)} AS DOUBLE) AS f5, CAST(sum(foreign_net) OVER {_frame(20)} AS DOUBLE) AS f20,
 CAST(sum(foreign_net) OVER {_frame(60)} AS DOUBLE) AS f60, CAST(sum(foreign_net) OVER {_BY} AS DOUBLE) AS cumulative FROM flows""")
def tail_sums(spark, sf):
    w, f = rolling.series(), F.col("foreign_net").cast("double")
    return V.flows(spark, sf).select("symbol", "data_date", *[rolling.tail_sum(f, n, w).alias(f"f{n}") for n in (5, 20, 60)],
                                     rolling.running(f, w).alias("cumulative"))


@query("signed_streak", WV("flows") + f"""
, s AS (SELECT symbol, data_date, CAST(sign(foreign_net) AS INT) AS sg FROM flows),
g AS (SELECT *, CASE WHEN sg IS NOT DISTINCT FROM lag(sg) OVER {_BY} AND lag(symbol) OVER {_BY} IS NOT NULL THEN 0 ELSE 1 END AS st FROM s),
r AS (SELECT *, sum(st) OVER {_BY} AS run FROM g)
SELECT symbol, data_date, CAST(row_number() OVER (PARTITION BY symbol, run ORDER BY data_date) * sg AS INT) AS streak FROM r""")
def signed_streak(spark, sf):
    w = rolling.series()
    f = V.flows(spark, sf).withColumn("sg", F.signum("foreign_net").cast("int")).withColumn("st", rolling.run_start("sg", w))
    f = f.withColumn("run", F.sum("st").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return f.select("symbol", "data_date", rolling.signed_run("sg", "run").alias("streak"))


@query("first_last_change", WV("flows") + f"""
SELECT symbol, data_date, CASE WHEN count(short_balance) OVER {_frame(20)} >= 2 THEN last_value(short_balance IGNORE NULLS) OVER {_frame(20)}
 - first_value(short_balance IGNORE NULLS) OVER {_frame(20)} ELSE 0 END AS chg FROM flows""")
def first_last_change(spark, sf):
    return V.flows(spark, sf).select("symbol", "data_date", rolling.first_last_change(
        F.col("short_balance"), 20, rolling.series()).alias("chg"))


@query("prev_action_lookback", """WITH s AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS data_date, arg_max(o_orderstatus, o_orderkey) AS action
 FROM orders GROUP BY 1, 2), p AS (SELECT *, lag(action) OVER w AS pa, lag(data_date) OVER w AS pd FROM s WINDOW w AS (PARTITION BY symbol ORDER BY data_date))
SELECT symbol, data_date, action, CASE WHEN data_date - pd <= 120 THEN pa END AS prev_action, CASE WHEN data_date - pd <= 120 THEN pd END AS prev_date FROM p""")
def prev_action_lookback(spark, sf):
    s = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("data_date")).agg(
        F.max_by("o_orderstatus", "o_orderkey").alias("action"))
    return joins.previous_event(s, ["symbol"], "action", 120)


@query("rolling_quantile", WV("bars") + f"""
SELECT symbol, data_date, {R("CASE WHEN count(volume) OVER w >= 20 THEN quantile_cont(volume, 0.95) OVER w END", 4)} AS threshold FROM bars
WINDOW w AS (PARTITION BY symbol ORDER BY data_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def rolling_quantile(spark, sf):
    return V.bars(spark, sf).select("symbol", "data_date", _r("threshold", rolling.rolling_quantile(
        "volume", 0.95, 60, 20, rolling.series()), 4))


@query("rolling_z", WV("bars") + f"""
SELECT symbol, data_date, {R("CASE WHEN count(volume) OVER w < 2 THEN 0 ELSE (volume - avg(volume) OVER w) / (stddev_pop(volume) OVER w + 1e-9) END", 3)} AS z FROM
(SELECT symbol, data_date, volume FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY data_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def rolling_z(spark, sf):
    """A constant history gives the distance to it in units of 1e-9."""
    return V.bars(spark, sf).select("symbol", "data_date", _r("z", rolling.rolling_z("volume", 60, rolling.series()), 3))


@query("rolling_rank", WV("bars") + f"""
, i AS (SELECT symbol, data_date, volume, row_number() OVER {_BY} AS k FROM bars)
SELECT a.symbol, a.data_date, {R("CASE WHEN count(b.k) = 0 THEN 0.5 ELSE count(*) FILTER (b.volume <= a.volume) / count(b.k)::DOUBLE END", 6)} AS pct
FROM i a LEFT JOIN i b ON a.symbol = b.symbol AND b.k BETWEEN a.k - 40 AND a.k - 1 GROUP BY 1, 2""")
def rolling_rank(spark, sf):
    return V.bars(spark, sf).select("symbol", "data_date", _r("pct", rolling.rolling_rank("volume", 40, rolling.series()), 6))


@query("cum_flow_ratio", WV("bars", "flows") + f"""
, j AS (SELECT b.symbol, b.data_date, f.foreign_net AS net, b.volume AS vol FROM bars b JOIN flows f USING (symbol, data_date))
SELECT symbol, data_date, {R("net / vol", 6)} AS d1, {R(f"CASE WHEN count(*) OVER {_frame(5)} = 5 THEN sum(net) OVER {_frame(5)} / sum(vol) OVER {_frame(5)} END", 6)} AS cum5,
 {R(f"CASE WHEN count(*) OVER {_frame(20)} = 20 THEN sum(net) OVER {_frame(20)} / sum(vol) OVER {_frame(20)} END", 6)} AS cum20,
 {R(f"CASE WHEN count(*) OVER {_frame(60)} = 60 THEN sum(net) OVER {_frame(60)} / sum(vol) OVER {_frame(60)} END", 6)} AS cum60 FROM j""")
def cum_flow_ratio(spark, sf):
    j = V.bars(spark, sf).join(V.flows(spark, sf).select("symbol", "data_date", "foreign_net"), ["symbol", "data_date"])
    w, net, vol = rolling.series(), F.col("foreign_net").cast("double"), F.col("volume")
    return j.select("symbol", "data_date", *[
        _r(name, rolling.flow_ratio(net, vol, n, w), 6) for name, n in (("d1", 1), ("cum5", 5), ("cum20", 20), ("cum60", 60))])


@query("stock_heat", WV("bars", "flows") + f"""
SELECT symbol, data_date, {R("close", 4)} AS close, short_balance FROM bars JOIN flows USING (symbol, data_date)
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY data_date DESC) <= 60""")
def stock_heat(spark, sf):
    j = V.bars(spark, sf).join(V.flows(spark, sf).select("symbol", "data_date", "short_balance"), ["symbol", "data_date"])
    return reports.stock_heat(j, 60).select("symbol", "data_date", _r("close", F.col("close"), 4), "short_balance")
