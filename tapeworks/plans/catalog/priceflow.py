"""Adjustment, divergence, cost, panel, regime and feature queries."""
import uuid

from pyspark.sql import functions as F

from tapeworks.config import settings
from tapeworks.functions.numbers import rounded
from tapeworks.operators import adjust, flows
from tapeworks.plans import features as feat
from tapeworks.plans import maintain, regime, reports
from tapeworks.plans import views as V
from tapeworks.plans.catalog.registry import R, query
from tapeworks.session import discard, materialise, shared_folder
from tapeworks.sources.versions import VersionedDays

WV = V.with_views
_BY = "(PARTITION BY symbol ORDER BY data_date)"
# weekly bars: a wider pull window, and trade thresholds that fit the sample
CFG = settings({"features": {"window_days": 700}, "large_trade": {"min_samples": 20}, "divergence": {"flow_eps": 0.05}})


def _r(name, col, n):
    return rounded(col, n).alias(name)


_ADJ = """adj AS (SELECT b.symbol, b.data_date, any_value(open) AS open, any_value(high) AS high, any_value(low) AS low, any_value(close) AS close, any_value(volume) AS volume,
  any_value(turnover) AS turnover, coalesce(product(a.adj_factor), 1) AS pf, coalesce(product(coalesce(a.share_factor, 1)), 1) AS sf
  FROM bars b LEFT JOIN actions a ON a.symbol = b.symbol AND a.data_date > b.data_date GROUP BY 1, 2)"""


@query("back_adjust", WV("bars", "actions") + f""", {_ADJ}
SELECT symbol, data_date, {R("close * pf", 5)} AS close, {R("high * pf", 5)} AS high, {R("volume * sf", 4)} AS volume FROM adj""")
def back_adjust(spark, sf):
    a = adjust.back_adjust(V.bars(spark, sf), V.actions(spark, sf), ["close", "high"], ["volume"])
    return a.select("symbol", "data_date", _r("close", F.col("adj_close"), 5), _r("high", F.col("adj_high"), 5), _r("volume", F.col("adj_volume"), 4))


@query("vwap_deviation", WV("bars") + f"""
SELECT symbol, data_date, {R("turnover / volume", 4)} AS vwap, {R("(close - turnover / volume) / (turnover / volume)", 6)} AS deviation FROM bars""")
def vwap_deviation(spark, sf):
    b = V.bars(spark, sf).withColumn("v", flows.vwap(F.col("turnover"), F.col("volume"), F.col("close")))
    return b.select("symbol", "data_date", _r("vwap", F.col("v"), 4), _r("deviation", (F.col("close") - F.col("v")) / F.col("v"), 6))


# point in time: only actions in (bar, t] scale a bar seen from t
_PIT = f"""c0 AS (SELECT b.symbol, b.data_date, coalesce(product(a.adj_factor), 1) AS cp, coalesce(product(coalesce(a.share_factor, 1)), 1) AS cv
  FROM bars b LEFT JOIN actions a ON a.symbol = b.symbol AND a.data_date <= b.data_date GROUP BY 1, 2),
n AS (SELECT b.*, cp, cv, close / cp AS c, high / cp AS h, low / cp AS l, volume / cv AS v FROM bars b JOIN c0 USING (symbol, data_date)),
n2 AS (SELECT *, greatest(h - l, abs(h - lag(c) OVER {_BY}), abs(l - lag(c) OVER {_BY})) AS tr FROM n),
pf AS (SELECT symbol, data_date, close, turnover, volume,
  CASE WHEN data_date - lag(data_date, 19) OVER w <= 700 THEN avg(c) OVER (PARTITION BY symbol ORDER BY data_date ROWS 19 PRECEDING) * cp END AS ma20,
  CASE WHEN data_date - lag(data_date, 14) OVER w <= 700 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY data_date ROWS 13 PRECEDING) * cp END AS atr14,
  CASE WHEN data_date - lag(data_date, 19) OVER w <= 700 THEN max(h) OVER (PARTITION BY symbol ORDER BY data_date ROWS 19 PRECEDING) * cp END AS res,
  min(l) OVER (PARTITION BY symbol ORDER BY data_date ROWS 9 PRECEDING) * cp AS swing,
  CASE WHEN data_date - lag(data_date, 19) OVER w <= 700 THEN avg(v) OVER (PARTITION BY symbol ORDER BY data_date ROWS 19 PRECEDING) * cv END AS av,
  CASE WHEN data_date - lag(data_date, 5) OVER w <= 700 THEN c / lag(c, 5) OVER w - 1 END AS ret5,
  CASE WHEN data_date - lag(data_date, 1) OVER w <= 700 THEN c / lag(c) OVER w - 1 END AS chg,
  high = low AND low = close AS flat FROM n2 WINDOW w AS (PARTITION BY symbol ORDER BY data_date))"""


_PRICE_SQL = WV("bars", "actions") + f""", {_PIT}
SELECT symbol, data_date, {R("chg", 6)} AS change_pct, {R("atr14", 4)} AS atr14, {R("ma20", 4)} AS ma20, {R("swing", 4)} AS recent_swing_low,
 {R("res", 4)} AS resistance_high, {R("(close - ma20) / ma20", 6)} AS close_vs_ma20_pct, {R("av", 3)} AS avg_volume, {R("ret5", 6)} AS ret5,
 CASE WHEN chg IS NOT NULL THEN chg >= 0.095 AND flat END AS is_limit_locked FROM pf"""


def _price_columns(p):
    return p.select("symbol", "data_date", _r("change_pct", F.col("change_pct"), 6), *[
        F.col(c) for c in ("atr14", "ma20", "recent_swing_low", "resistance_high")],
        _r("close_vs_ma20_pct", F.col("close_vs_ma20_pct"), 6), _r("avg_volume", F.col("avg_volume"), 3), _r("ret5", F.col("ret5"), 6), "is_limit_locked")


@query("price_features", _PRICE_SQL)
def price_features(spark, sf):
    return _price_columns(feat.price_features(V.bars(spark, sf), V.actions(spark, sf), CFG))


@query("price_features_maintained", _PRICE_SQL)
def price_features_maintained(spark, sf):
    """Built once from facts of which a tenth of the symbols had wrong and missing rows in 1997; then only what the
    corrected facts reach is built again. Equal to the full build."""
    base = f"{shared_folder(spark)}/tapeworks-{uuid.uuid4().hex}"
    facts, features = (VersionedDays(spark, f"{base}/{t}", ["symbol", "data_date"]) for t in ("facts", "features"))
    right = materialise(V.bars(spark, sf))
    actions = materialise(V.actions(spark, sf))
    hit = (F.col("symbol") % 10 == 3) & (F.year("data_date") == 1997)
    wrong = right.withColumns({c: F.when(hit, F.col(c) * 1.05).otherwise(F.col(c)) for c in ("close", "high", "volume")})
    wrong = wrong.where(~hit | (F.dayofyear("data_date") % 4 != 0))
    build = lambda rows: feat.price_features(rows, actions.join(rows.select("symbol").distinct(), "symbol", "left_semi"), CFG)
    facts.rewrite(wrong)
    features.rewrite(build(facts.read()))
    corrected = right.where(hit)
    facts.rewrite(corrected)
    maintain.rebuild(features, facts, corrected, CFG["features"]["ma_rows"], build)
    discard(right), discard(actions)
    return _price_columns(features.read())


def _panel(spark, sf):
    return reports.flow_panel(V.bars(spark, sf), V.flows(spark, sf), V.actions(spark, sf), None)


_PANEL = f"""{_ADJ}, pan AS (SELECT a.symbol, a.data_date, close * pf AS close, turnover, turnover / volume * pf AS avg_price, volume / 1000 * sf AS vol,
  (foreign_net + trust_net + dealer_self_net + coalesce(dealer_hedge_net, 0)) / 1000.0::DOUBLE * sf AS net, foreign_net / 1000.0::DOUBLE * sf AS fgn
  FROM adj a JOIN flows f USING (symbol, data_date))"""

_DIV = """dv0 AS (SELECT *, CASE WHEN lag(close) OVER w IS NOT NULL THEN close / lag(close) OVER w - 1 END AS x FROM pan WINDOW w AS (PARTITION BY symbol ORDER BY data_date)),
dv AS (SELECT symbol, data_date, close, turnover, count(*) OVER f AS pts, last(close) OVER f / first(close) OVER f - 1 AS pr, sum(net) OVER f AS inst_net, sum(vol) OVER f AS vs,
  CASE WHEN count(*) OVER f >= 2 THEN last(close) OVER f / first(close) OVER f - 1 END AS price_return,
  CASE WHEN count(x) OVER g >= 2 THEN corr(x, net) OVER g END AS cor FROM dv0
  WINDOW f AS (PARTITION BY symbol ORDER BY data_date ROWS 59 PRECEDING), g AS (PARTITION BY symbol ORDER BY data_date ROWS 58 PRECEDING)),
ds AS (SELECT *, inst_net / vs AS fr, CASE WHEN pts < 10 OR price_return IS NULL THEN 'neutral' WHEN price_return <= -0.03 AND inst_net / vs >= 0.05 THEN 'bullish_div'
  WHEN price_return >= 0.03 AND inst_net / vs <= -0.05 THEN 'bearish_div' WHEN price_return >= 0.03 AND inst_net / vs >= 0.05 THEN 'aligned_up'
  WHEN price_return <= -0.03 AND inst_net / vs <= -0.05 THEN 'aligned_down' ELSE 'neutral' END AS status FROM dv)"""


@query("divergence_series", WV("bars", "flows", "actions") + f""", {_PANEL}, {_DIV}
SELECT symbol, data_date, {R("price_return", 5)} AS price_return, {R("inst_net", 4)} AS inst_net, {R("fr", 5)} AS flow_ratio, status FROM ds""")
def divergence_series(spark, sf):
    d = flows.divergence(_panel(spark, sf), 60, CFG["divergence"], volume="volume_lots")
    return d.select("symbol", "data_date", _r("price_return", F.col("price_return"), 5), _r("inst_net", F.col("inst_net"), 4),
                    _r("flow_ratio", F.col("flow_ratio"), 5), "status")


@query("price_flow_correlation", WV("bars", "flows", "actions") + f""", {_PANEL}, {_DIV}
SELECT symbol, data_date, {R("cor", 4)} AS corr FROM ds""")
def price_flow_correlation(spark, sf):
    d = flows.divergence(_panel(spark, sf), 60, CFG["divergence"], volume="volume_lots")
    return d.select("symbol", "data_date", _r("corr", F.col("price_flow_corr"), 4))


_COST = """cs AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY data_date) AS k FROM pan),
cb(symbol, k, pos, cost) AS (SELECT symbol, CAST(0 AS BIGINT), 0::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT symbol FROM cs) UNION ALL
 SELECT cs.symbol, cs.k, CASE WHEN net > 0 THEN pos + net WHEN net < 0 THEN greatest(0, pos + net) ELSE pos END,
  CASE WHEN net > 0 THEN CASE WHEN pos <= 0 THEN avg_price ELSE (pos * cost + net * avg_price) / (pos + net) END WHEN net < 0 AND pos + net <= 0 THEN NULL ELSE cost END
 FROM cb JOIN cs ON cs.symbol = cb.symbol AND cs.k = cb.k + 1)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("cost_basis", _recursive(WV("bars", "flows", "actions")) + f""", {_PANEL}, {_COST}
SELECT cs.symbol, cs.data_date, {R("cb.pos", 4)} AS position, {R("cb.cost", 3)} AS cost FROM cs JOIN cb ON cs.symbol = cb.symbol AND cs.k = cb.k""")
def cost_basis(spark, sf):
    c = flows.cost_basis(_panel(spark, sf), "avg_price", "net")
    return c.select("symbol", "data_date", _r("position", F.col("position"), 4), _r("cost", F.col("cost"), 3))


@query("divergence_scan", _recursive(WV("stock", "bars", "flows", "actions")) + f""", {_PANEL}, {_DIV}, {_COST},
l AS (SELECT max(data_date) AS d FROM bars),
x AS (SELECT ds.*, cb.cost, cs.avg_price, lag(ds.close) OVER (PARTITION BY ds.symbol ORDER BY ds.data_date) AS pc FROM ds JOIN cs USING (symbol, data_date) JOIN cb ON cb.symbol = cs.symbol AND cb.k = cs.k),
y AS (SELECT *, avg_price / cost - 1 AS prem FROM x WHERE data_date = (SELECT d FROM l))
SELECT symbol, name, data_date, turnover, status, {R("y.close / pc - 1", 5)} AS change_pct, {R("price_return", 5)} AS price_return, {R("fr", 5)} AS flow_ratio,
 {R("prem", 5)} AS premium_pct, CASE WHEN prem IS NULL THEN 'unknown' WHEN prem > 0.01 THEN 'profit' WHEN prem < -0.01 THEN 'loss' ELSE 'flat' END AS cost_state,
 {R("100 * cume_dist() OVER (ORDER BY price_return)", 1)} AS mom_pct FROM y JOIN stock USING (symbol)""")
def divergence_scan(spark, sf):
    s = reports.divergence_scan(_panel(spark, sf), V.stock(spark, sf), CFG, 60)
    return s.select("symbol", "name", "data_date", "turnover", "status", _r("change_pct", F.col("change_pct"), 5), _r("price_return", F.col("price_return"), 5),
                    _r("flow_ratio", F.col("flow_ratio"), 5), _r("premium_pct", F.col("premium_pct"), 5), "cost_state", "mom_pct")


@query("divergence_ranking", WV("bars", "flows", "actions") + f""", {_PANEL}, {_DIV},
d AS (SELECT * FROM ds WHERE data_date = (SELECT max(data_date) FROM bars) AND turnover >= 20000),
k AS (SELECT *, CASE status WHEN 'bullish_div' THEN 0 WHEN 'aligned_up' THEN 1 WHEN 'neutral' THEN 2 WHEN 'aligned_down' THEN 3 ELSE 4 END AS rk FROM d)
SELECT symbol, status, CAST(rk AS BIGINT) AS status_rank, {R("fr", 5)} AS flow_ratio FROM k ORDER BY rk, CASE WHEN rk <= 1 THEN -fr ELSE fr END, symbol LIMIT 50""")
def divergence_ranking(spark, sf):
    d = flows.divergence(_panel(spark, sf), 60, CFG["divergence"], volume="volume_lots")
    d = d.where(F.col("data_date") == reports.latest_date(d))
    return reports.divergence_ranking(d, None, 20000, 50).select("symbol", "status", F.col("status_rank").cast("bigint").alias("status_rank"),
                                                               _r("flow_ratio", F.col("flow_ratio"), 5))


@query("flow_panel", WV("bars", "flows", "actions") + f""", {_PANEL},
s AS (SELECT *, CAST(sign(fgn) AS INT) AS sg FROM pan),
g AS (SELECT *, CASE WHEN row_number() OVER {_BY} > 1 AND sg IS NOT DISTINCT FROM lag(sg) OVER {_BY} THEN 0 ELSE 1 END AS st FROM s), r AS (SELECT *, sum(st) OVER {_BY} AS run FROM g)
SELECT symbol, data_date, {R("close", 4)} AS close, {R("fgn", 5)} AS foreign_lots, {R("sum(fgn) OVER (PARTITION BY symbol ORDER BY data_date ROWS 4 PRECEDING)", 4)} AS foreign_5d,
 {R("sum(net) OVER (PARTITION BY symbol ORDER BY data_date ROWS 59 PRECEDING)", 3)} AS inst_60d, CAST(row_number() OVER (PARTITION BY symbol, run ORDER BY data_date) * sg AS INT) AS foreign_streak FROM r""")
def flow_panel(spark, sf):
    p = reports.panel_summary(_panel(spark, sf))
    return p.select("symbol", "data_date", _r("close", F.col("close"), 4), _r("foreign_lots", F.col("foreign"), 5), _r("foreign_5d", F.col("foreign_5d"), 4),
                    _r("inst_60d", F.col("inst_60d"), 3), "foreign_streak")


@query("market_regime", WV("bars", "actions", "idx", "cal") + f"""
, i AS (SELECT *, row_number() OVER (ORDER BY data_date) AS k, index_close / lag(index_close) OVER (ORDER BY data_date) - 1 AS r FROM idx),
m AS (SELECT *, CASE WHEN k >= 20 THEN avg(index_close) OVER (ORDER BY data_date ROWS 19 PRECEDING) END AS s, CASE WHEN k >= 60 THEN avg(index_close) OVER (ORDER BY data_date ROWS 59 PRECEDING) END AS l FROM i),
v AS (SELECT *, CASE WHEN k >= 25 THEN regr_slope(s, k) OVER (ORDER BY data_date ROWS 4 PRECEDING) END AS sl, CASE WHEN k >= 21 THEN stddev_samp(r) OVER (ORDER BY data_date ROWS 19 PRECEDING) END AS vol FROM m),
p AS (SELECT b.symbol, b.data_date, b.close, c.day_no, lag(b.close) OVER w AS pc, lag(c.day_no) OVER w AS pd, lag(b.data_date) OVER w AS pdate
  FROM bars b JOIN cal c USING (data_date) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.data_date)),
f AS (SELECT p.symbol, p.data_date, coalesce(product(a.adj_factor), 1) AS kf FROM p LEFT JOIN actions a ON a.symbol = p.symbol AND a.data_date > p.pdate AND a.data_date <= p.data_date GROUP BY 1, 2),
br AS (SELECT data_date, count(*) FILTER (close - pc * kf > 1e-9 AND pd = day_no - 1) AS up, count(*) FILTER (close - pc * kf < -1e-9 AND pd = day_no - 1) AS dn FROM p JOIN f USING (symbol, data_date) GROUP BY 1)
SELECT data_date, up AS advancers, dn AS decliners, {R("s", 2)} AS ma_short, {R("l", 2)} AS ma_long, {R("vol", 6)} AS volatility_pct,
 {R("greatest(-1, least(1, CASE WHEN s IS NULL THEN 0 WHEN index_close > s THEN 0.25::DOUBLE ELSE -0.25::DOUBLE END + CASE WHEN l IS NULL THEN 0 WHEN index_close > l THEN 0.2::DOUBLE ELSE -0.2::DOUBLE END + CASE WHEN sl IS NULL THEN 0 ELSE 0.2::DOUBLE * tanh(sl / s * 60 / 0.02::DOUBLE * 0.01::DOUBLE) END + 0.25::DOUBLE * CASE WHEN up + dn > 0 THEN (up - dn) / (up + dn)::DOUBLE ELSE 0 END + CASE WHEN vol IS NULL THEN 0 WHEN vol > 0.03 THEN -0.1::DOUBLE ELSE 0.05::DOUBLE END))", 5)} AS market_trend_score
FROM v JOIN br USING (data_date)""")
def market_regime(spark, sf):
    m = regime.build_market(V.index(spark, sf), V.bars(spark, sf), V.actions(spark, sf), CFG)
    return m.select("data_date", "advancers", "decliners", "ma_short", "ma_long", _r("volatility_pct", F.col("volatility_pct"), 6),
                    _r("market_trend_score", F.col("market_trend_score"), 5))


def feature_tables(spark, sf, with_ticks: bool = False):
    """The tables a real run finds stored: bars and flows are written once, not re-aggregated per branch."""
    bars, flow = materialise(V.bars(spark, sf)), materialise(V.flows(spark, sf))
    t = {"prices": bars, "actions": V.actions(spark, sf), "institutional": flow, "margin": flow, "lending": flow, "holders": V.holders_weekly(spark, sf), "stock": V.stock(spark, sf)}
    if with_ticks:
        t["ticks"] = V.ticks(spark, sf)
    return t


def _z(src: str, value: str, out: str) -> str:
    """CTE <out>: winsorised z of ``value`` per date over the known rows of ``src``."""
    return f"""{out}q AS (SELECT data_date, quantile_cont({value}, 0.01) AS lo, quantile_cont({value}, 0.99) AS hi, count(*) AS n FROM {src} WHERE {value} IS NOT NULL GROUP BY 1),
{out}c AS (SELECT symbol, data_date, n, greatest(lo, least(hi, {value})) AS v FROM {src} JOIN {out}q USING (data_date) WHERE {value} IS NOT NULL),
{out}m AS (SELECT data_date, avg(v) AS m, stddev_pop(v) AS s FROM {out}c GROUP BY 1),
{out} AS (SELECT symbol, data_date, CASE WHEN n < 2 THEN NULL WHEN s = 0 THEN 0 ELSE greatest(-5, least(5, (v - m) / s)) END AS z FROM {out}c JOIN {out}m USING (data_date))"""


FEATURE_SQL = f"""{_PIT},
fw AS (SELECT f.symbol, f.data_date, day_no, pf.av, sum(foreign_net) OVER r AS f5, sum(trust_net) OVER r AS t5, sum(dealer_self_net) OVER r + coalesce(sum(dealer_hedge_net) OVER r, 0) AS d5,
  margin_balance - last_value(margin_balance IGNORE NULLS) OVER b5 AS m5, short_balance - last_value(short_balance IGNORE NULLS) OVER b5 AS s5,
  sbl_balance AS lb, last_value(sbl_balance IGNORE NULLS) OVER b20 AS lb0,
  last_value(CASE WHEN margin_balance IS NOT NULL THEN f.data_date END IGNORE NULLS) OVER b5 AS md, last_value(CASE WHEN short_balance IS NOT NULL THEN f.data_date END IGNORE NULLS) OVER b5 AS sd,
  last_value(CASE WHEN sbl_balance IS NOT NULL THEN f.data_date END IGNORE NULLS) OVER b20 AS ld
  FROM flows f JOIN cal USING (data_date) JOIN pf USING (symbol, data_date)
  WINDOW r AS (PARTITION BY f.symbol ORDER BY day_no RANGE BETWEEN 4 PRECEDING AND CURRENT ROW), b5 AS (PARTITION BY f.symbol ORDER BY day_no RANGE BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING),
   b20 AS (PARTITION BY f.symbol ORDER BY day_no RANGE BETWEEN UNBOUNDED PRECEDING AND 20 PRECEDING)),
st AS (SELECT symbol, data_date, CASE WHEN day_no >= 5 THEN f5 / av END AS fo, CASE WHEN day_no >= 5 THEN t5 / av END AS tr, CASE WHEN day_no >= 5 THEN d5 / av END AS de,
  CASE WHEN data_date - md <= 700 THEN m5 * 1000 / av END AS ma, CASE WHEN data_date - sd <= 700 THEN s5 * 1000 / av END AS sh,
  CASE WHEN data_date - ld <= 700 AND lb0 > 0 THEN (lb - lb0) / lb0::DOUBLE END AS sb FROM fw),
{_z("st", "fo", "zf")}, {_z("st", "tr", "zt")}, {_z("st", "de", "zd")}, {_z("st", "ma", "zm")}, {_z("st", "sh", "zs")}, {_z("st", "sb", "zb")},
hp AS (SELECT symbol, data_date AS snap, large_ratio + super_large_ratio AS big, retail_ratio AS ret, holder_count AS hc, data_date + 6 AS vis, lag(data_date) OVER w AS ps,
  lag(large_ratio + super_large_ratio) OVER w AS pb, lag(retail_ratio) OVER w AS pr, lag(holder_count) OVER w AS pc, lead(data_date + 6) OVER w AS nv FROM hweek WINDOW w AS (PARTITION BY symbol ORDER BY data_date)),
hd AS (SELECT hp.*, cal.data_date, cal.data_date - ps <= 60 AS two FROM hp JOIN cal ON cal.data_date >= vis AND cal.data_date <= least(snap + 60, coalesce(nv - 1, snap + 60))),
hm AS (SELECT data_date, (SELECT count(*) FROM bars b WHERE b.data_date = hd.data_date) AS today, count(*) FILTER (two) AS multi FROM hd GROUP BY 1),
hx AS (SELECT hd.symbol, hd.data_date, CASE WHEN multi / today::DOUBLE >= 0.5 THEN CASE WHEN two THEN big - pb END WHEN b.symbol IS NOT NULL THEN big END AS lg,
  CASE WHEN multi / today::DOUBLE >= 0.5 THEN CASE WHEN two THEN ret - pr END WHEN b.symbol IS NOT NULL THEN ret END AS rt,
  CASE WHEN multi / today::DOUBLE >= 0.5 AND two AND pc > 0 AND hc > 0 THEN (hc - pc) / pc::DOUBLE END AS ch
  FROM hd JOIN hm USING (data_date) LEFT JOIN bars b ON b.symbol = hd.symbol AND b.data_date = hd.data_date),
{_z("hx", "lg", "zl")}, {_z("hx", "rt", "zr")}, {_z("hx", "ch", "zh")},
im AS (SELECT data_date, industry AS symbol, median(ret5) AS mid FROM pf JOIN stock USING (symbol) WHERE ret5 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5), {_z("im", "mid", "zi")},
feat AS (SELECT pf.*, zf.z AS foreign_5d_z, zt.z AS trust_5d_z, zd.z AS dealer_5d_z, zm.z AS margin_balance_change_z, zs.z AS short_balance_change_z, zb.z AS sbl_change_z,
  zl.z AS large_holder_ratio_change_z, zr.z AS retail_holder_ratio_change_z, zh.z AS holder_count_change_z, CASE WHEN ret5 IS NOT NULL THEN tanh(zi.z / 2) END AS industry_trend_score,
  s.industry, s.name FROM pf JOIN stock s USING (symbol) LEFT JOIN zf USING (symbol, data_date) LEFT JOIN zt USING (symbol, data_date) LEFT JOIN zd USING (symbol, data_date) LEFT JOIN zm USING (symbol, data_date)
  LEFT JOIN zs USING (symbol, data_date) LEFT JOIN zb USING (symbol, data_date) LEFT JOIN zl USING (symbol, data_date) LEFT JOIN zr USING (symbol, data_date) LEFT JOIN zh USING (symbol, data_date)
  LEFT JOIN zi ON zi.symbol = s.industry AND zi.data_date = pf.data_date)"""

_ZCOLS = ["foreign_5d_z", "trust_5d_z", "dealer_5d_z", "margin_balance_change_z", "short_balance_change_z", "sbl_change_z",
          "large_holder_ratio_change_z", "retail_holder_ratio_change_z", "holder_count_change_z", "industry_trend_score"]


@query("feature_build", WV("stock", "bars", "flows", "actions", "cal", "hweek") + f""", {FEATURE_SQL}
SELECT symbol, data_date, {R("ma20", 4)} AS ma20, {", ".join(f"{R(c, 4)} AS {c}" for c in _ZCOLS)} FROM feat""")
def feature_build(spark, sf):
    f = feat.build_features(feature_tables(spark, sf), CFG)
    return f.select("symbol", "data_date", "ma20", *[_r(c, F.col(c), 4) for c in _ZCOLS])


@query("feature_build_with_ticks")
def feature_build_with_ticks(spark, sf):
    """All feature groups at once; the trade symbols and dates differ from the bars', so rows-only."""
    return feat.build_features(feature_tables(spark, sf, True), CFG)


@query("holder_change_or_level", WV("bars", "cal", "hweek") + f"""
, hp AS (SELECT symbol, data_date AS snap, large_ratio + super_large_ratio AS big, retail_ratio AS ret, data_date + 6 AS vis, lag(data_date) OVER w AS ps,
  lag(large_ratio + super_large_ratio) OVER w AS pb, lag(retail_ratio) OVER w AS pr, lead(data_date + 6) OVER w AS nv FROM hweek WINDOW w AS (PARTITION BY symbol ORDER BY data_date)),
hd AS (SELECT hp.*, cal.data_date, cal.data_date - ps <= 60 AS two FROM hp JOIN cal ON cal.data_date >= vis AND cal.data_date <= least(snap + 60, coalesce(nv - 1, snap + 60))),
hm AS (SELECT data_date, (SELECT count(*) FROM bars b WHERE b.data_date = hd.data_date) AS today, count(*) FILTER (two) AS multi FROM hd GROUP BY 1)
SELECT hd.symbol, hd.data_date, {R("CASE WHEN multi / today::DOUBLE >= 0.5 THEN CASE WHEN two THEN big - pb END WHEN b.symbol IS NOT NULL THEN big END", 5)} AS large,
 {R("CASE WHEN multi / today::DOUBLE >= 0.5 THEN CASE WHEN two THEN ret - pr END WHEN b.symbol IS NOT NULL THEN ret END", 5)} AS retail
FROM hd JOIN hm USING (data_date) LEFT JOIN bars b ON b.symbol = hd.symbol AND b.data_date = hd.data_date""")
def holder_change_or_level(spark, sf):
    from tapeworks.operators.calendar import market_calendar
    b = V.bars(spark, sf)
    h = feat.holder_changes(V.holders_weekly(spark, sf), market_calendar(b), b.select("symbol", "data_date"), CFG)
    return h.select("symbol", "data_date", _r("large", F.col("large"), 5), _r("retail", F.col("retail"), 5))
