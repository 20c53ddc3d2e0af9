"""Cross-sectional scores, rank statistics and factor research."""
from pyspark.sql import functions as F

from tapeworks.config import DEFAULTS
from tapeworks.functions.numbers import net_return, rounded
from tapeworks.operators import backtest, calendar, cross_section, order_stats, research, rolling
from tapeworks.plans import models
from tapeworks.plans import views as V
from tapeworks.plans.catalog.registry import R, query
from tapeworks.session import discard, materialise, sent_whole

WV = V.with_views
_BY = "(PARTITION BY symbol ORDER BY data_date)"
_C = DEFAULTS["backtest"]


def _r(name, col, n):
    return rounded(col, n).alias(name)


# factor rows: flow ratio and momentum of every bar, with the net return of the next h bars
_FACTORS = f"""fac AS (SELECT symbol, data_date, f.foreign_net / b.volume AS flow, f.trust_net / b.volume AS trust,
  b.close / lag(b.close, 5) OVER w - 1 AS mom5 FROM bars b JOIN flows f USING (symbol, data_date) WINDOW w AS (PARTITION BY symbol ORDER BY data_date))"""
_NETS = """nets AS (SELECT b.symbol, b.data_date, h.k AS horizon, (x.ex * (1 - 0.005425::DOUBLE) - x.entry * (1 + 0.002425::DOUBLE)) / (x.entry * (1 + 0.002425::DOUBLE)) AS net
  FROM (SELECT symbol, data_date, lead(open) OVER w AS entry, lead(data_date) OVER w AS nd, lead(close, 1) OVER w AS e1, lead(close, 5) OVER w AS e5,
    lead(close, 20) OVER w AS e20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY data_date)) b JOIN cal USING (data_date),
  (VALUES (1), (5), (20)) h(k), LATERAL (SELECT b.entry AS entry, CASE h.k WHEN 1 THEN b.e1 WHEN 5 THEN b.e5 ELSE b.e20 END AS ex) x
  WHERE b.nd = cal.next_date AND x.ex IS NOT NULL AND x.entry > 0)"""


def _rank(x: str, part: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE)")


def _ic(rows: str, x: str, y: str, part: str, min_names: int) -> str:
    """CTEs rk and ic over a row set without NULLs in x and y."""
    return f"""rk AS (SELECT *, {_rank(x, part)} AS rx, {_rank(y, part)} AS ry FROM {rows}),
ic AS (SELECT {part}, count(*) AS n, CASE WHEN count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN corr(rx, ry) END AS ic FROM rk GROUP BY {part}
  HAVING count(*) >= {min_names} AND count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1)"""


def _nw(src: str, part: str, lag: str, max_lag: int) -> str:
    """CTE nw: mean, naive and Newey-West t of ``ic`` per ``part``."""
    gam = " ".join(
        f"+ CASE WHEN {lag} >= {i} THEN 2 * (1 - {i} / ({lag} + 1.0::DOUBLE)) * coalesce(sum(g{i}), 0) / count(*) ELSE 0 END" for i in range(1, max_lag + 1))
    cols = ", ".join(f"d * lag(d, {i}) OVER (PARTITION BY {part} ORDER BY data_date) AS g{i}" for i in range(1, max_lag + 1))
    return f"""dv AS (SELECT *, ic - avg(ic) OVER (PARTITION BY {part}) AS d FROM {src}),
gm AS (SELECT *, {cols} FROM dv),
nw AS (SELECT {part}, count(*) AS n_days, avg(ic) AS mean, avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS t_naive,
 avg(ic) / sqrt((sum(d * d) / count(*) {gam}) / count(*)) AS t_nw, avg((ic > 0)::INT) AS positive_share FROM gm GROUP BY {part})"""


def factors(spark, sf, bars=None):
    j = (V.bars(spark, sf) if bars is None else bars).join(V.flows(spark, sf).select("symbol", "data_date", "foreign_net", "trust_net"), ["symbol", "data_date"])
    return j.select("symbol", "data_date", (F.col("foreign_net") / F.col("volume")).alias("flow"),
                    (F.col("trust_net") / F.col("volume")).alias("trust"),
                    (F.col("close") / F.lag("close", 5).over(rolling.series()) - 1).alias("mom5"))


def nets(spark, sf, horizons=(1, 5, 20), bars=None):
    b = V.bars(spark, sf) if bars is None else bars
    e = backtest.entry_bars(b, [h for h in horizons])
    nxt = calendar.market_calendar(b).select("data_date", F.col("next_date").alias("entry_date"))
    nxt = nxt if bars is None else sent_whole(nxt)
    j = b.select("symbol", "data_date").join(nxt, "data_date").join(e, ["symbol", "entry_date"])
    return j.select("symbol", "data_date", F.explode(F.array(*[F.struct(
        F.lit(h).alias("horizon"), net_return(F.col("entry_price"), F.col(f"exit_{h}"), _C).alias("net")) for h in horizons])).alias("x")
    ).select("symbol", "data_date", "x.*").where("net IS NOT NULL")


def joined(spark, sf, horizons=(1, 5, 20), bars=None):
    """Factors with realised returns; ranked several times over, so written once. So are the bars behind them."""
    own = materialise(V.bars(spark, sf)) if bars is None else bars
    rows = materialise(factors(spark, sf, own).join(nets(spark, sf, horizons, own), ["symbol", "data_date"]))
    if bars is None:
        discard(own)
    return rows


@query("winsor_z", WV("bars") + f"""
, q AS (SELECT data_date, quantile_cont(turnover, 0.01) AS lo, quantile_cont(turnover, 0.99) AS hi, count(*) AS n FROM bars GROUP BY 1),
c AS (SELECT symbol, data_date, n, greatest(lo, least(hi, turnover)) AS v FROM bars JOIN q USING (data_date)),
m AS (SELECT data_date, avg(v) AS m, stddev_pop(v) AS s FROM c GROUP BY 1)
SELECT symbol, data_date, {R("CASE WHEN n < 2 THEN NULL WHEN s = 0 THEN 0 ELSE greatest(-5, least(5, (v - m) / s)) END", 6)} AS z FROM c JOIN m USING (data_date)""")
def winsor_z(spark, sf):
    z = cross_section.winsor_z(V.bars(spark, sf), ["data_date"], "turnover", "z")
    return z.select("symbol", "data_date", _r("z", F.col("z"), 6))


@query("cs_percentile", WV("bars") + f"""
SELECT symbol, data_date, {R("100 * (" + _rank("volume", "data_date") + " - 0.5) / count(*) OVER (PARTITION BY data_date)", 1)} AS score FROM bars""")
def cs_percentile(spark, sf):
    p = order_stats.percentile_score(V.bars(spark, sf), ["data_date"], "volume", "p", None)
    return p.select("symbol", "data_date", _r("score", F.col("p"), 1))


@query("momentum_pct", WV("bars", "flows") + f""", {_FACTORS}
SELECT symbol, data_date, {R("100 * cume_dist() OVER (PARTITION BY data_date ORDER BY mom5)", 4)} AS mom_pct FROM fac WHERE mom5 IS NOT NULL""")
def momentum_pct(spark, sf):
    p = order_stats.share_at_or_below(factors(spark, sf).where("mom5 IS NOT NULL"), ["data_date"], "mom5", "p")
    return p.select("symbol", "data_date", _r("mom_pct", F.col("p") * 100, 4))


@query("daily_rank_ic", WV("bars", "flows", "cal") + f""", {_FACTORS}, {_NETS},
j AS (SELECT * FROM fac JOIN nets USING (symbol, data_date) WHERE horizon = 5), {_ic("j", "flow", "net", "data_date", 20)}
SELECT data_date, n, {R("ic", 6)} AS ic FROM ic""")
def daily_rank_ic(spark, sf):
    j = joined(spark, sf, (5,))
    return research.rank_ic(j, ["data_date"], "flow", "net", 20).select("data_date", "n", _r("ic", F.col("ic"), 6))


@query("newey_west", WV("bars", "flows", "cal") + f""", {_FACTORS}, {_NETS},
j AS (SELECT * FROM fac JOIN nets USING (symbol, data_date)), {_ic("j", "flow", "net", "horizon, data_date", 20)}, {_nw("ic", "horizon", "(horizon - 1)", 19)}
SELECT horizon, n_days, {R("mean", 6)} AS mean, {R("t_naive", 4)} AS t_naive, {R("t_nw", 4)} AS t_nw, {R("positive_share", 6)} AS positive_share FROM nw""")
def newey_west(spark, sf):
    j = joined(spark, sf)
    ics = research.rank_ic(j, ["horizon", "data_date"], "flow", "net", 20)
    nw = research.newey_west(ics, ["horizon"], "ic", F.col("horizon") - 1, 19)
    return nw.select("horizon", "n_days", _r("mean", F.col("mean"), 6), _r("t_naive", F.col("t_naive"), 4),
                     _r("t_nw", F.col("t_nw"), 4), _r("positive_share", F.col("positive_share"), 6))


@query("pooled_spearman", WV("bars", "flows", "cal") + f""", {_FACTORS}, {_NETS},
j AS (SELECT *, 1 AS one FROM fac JOIN nets USING (symbol, data_date) WHERE horizon = 5), {_ic("j", "flow", "net", "one", 30)}
SELECT n, {R("ic", 6)} AS rho FROM ic""")
def pooled_spearman(spark, sf):
    j = joined(spark, sf, (5,))
    return research.pooled_spearman(j, "flow", "net").select("n", _r("rho", F.col("rho"), 6))


@query("decile_table", WV("bars", "flows", "cal") + f""", {_FACTORS}, {_NETS},
j AS (SELECT flow, net FROM fac JOIN nets USING (symbol, data_date) WHERE horizon = 5),
e AS (SELECT list_sort(list_distinct(quantile_cont(flow, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM j),
b AS (SELECT net, greatest(1, len(list_filter(edges, lambda x: x < flow))) AS bucket FROM j, e)
SELECT CAST(bucket AS INT) AS bucket, count(*) AS n, {R("avg(net)", 6)} AS avg_net FROM b GROUP BY 1""")
def decile_table(spark, sf):
    j = joined(spark, sf, (5,))
    return research.quantile_buckets(j, "flow", 10).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), _r("avg_net", F.avg("net"), 6))


@query("quintile_spread", WV("bars", "flows", "cal") + f""", {_FACTORS}, {_NETS},
j AS (SELECT *, row_number() OVER (ORDER BY flow, data_date, symbol) - 1 AS i, count(*) OVER () AS m FROM fac JOIN nets USING (symbol, data_date) WHERE horizon = 5)
SELECT CAST(1 + (i >= m * 1 // 5)::INT + (i >= m * 2 // 5)::INT + (i >= m * 3 // 5)::INT + (i >= m * 4 // 5)::INT AS INT) AS bucket,
 count(*) AS n, {R("avg(net)", 6)} AS avg_net, {R("min(flow)", 6)} AS edge FROM j GROUP BY 1""")
def quintile_spread(spark, sf):
    j = joined(spark, sf, (5,))
    return research.position_buckets(j, [], "flow", "data_date", ["symbol"]).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), _r("avg_net", F.avg("net"), 6), _r("edge", F.min("flow"), 6))


@query("monotone_steps", WV("bars", "flows", "cal") + f""", {_FACTORS}, {_NETS},
j AS (SELECT horizon, net, row_number() OVER (PARTITION BY horizon ORDER BY flow, data_date, symbol) - 1 AS i, count(*) OVER (PARTITION BY horizon) AS m
 FROM fac JOIN nets USING (symbol, data_date)),
q AS (SELECT horizon, 1 + (i >= m * 1 // 5)::INT + (i >= m * 2 // 5)::INT + (i >= m * 3 // 5)::INT + (i >= m * 4 // 5)::INT AS bucket, avg(net) AS a FROM j GROUP BY 1, 2),
s AS (SELECT *, a > lag(a) OVER (PARTITION BY horizon ORDER BY bucket) AS up FROM q)
SELECT horizon, count(*) FILTER (up) AS rises, {R("arg_max(a, bucket) - arg_min(a, bucket)", 6)} AS spread FROM s GROUP BY 1""")
def monotone_steps(spark, sf):
    j = joined(spark, sf)
    t = research.position_buckets(j, ["horizon"], "flow", "data_date", ["symbol"]).groupBy("horizon", "bucket").agg(F.avg("net").alias("a"))
    m = research.monotone_steps(t, ["horizon"], "bucket", "a")
    return m.select("horizon", "rises", _r("spread", F.col("spread"), 6))


_SPLIT = """sp AS (SELECT data_date, CASE WHEN i < m // 2 THEN 'train' WHEN i >= m // 2 + 20 THEN 'test' ELSE 'embargo' END AS segment
 FROM (SELECT data_date, row_number() OVER (ORDER BY data_date) - 1 AS i, count(*) OVER () AS m FROM cal))"""


@query("train_embargo_test", WV("cal") + f", {_SPLIT} SELECT segment, count(*) AS days, min(data_date) AS first_day, max(data_date) AS last_day FROM sp GROUP BY 1")
def train_embargo_test(spark, sf):
    s = research.split_by_days(V.bars(spark, sf), 20)
    return s.groupBy("segment").agg(F.count(F.lit(1)).alias("days"), F.min("data_date").alias("first_day"), F.max("data_date").alias("last_day"))


_LONG = "lng AS (SELECT symbol, data_date, factor, value FROM fac UNPIVOT (value FOR factor IN (flow, trust, mom5)))"


@query("factor_ic_grid", WV("bars", "flows", "cal") + f""", {_FACTORS}, {_NETS}, {_LONG},
j AS (SELECT * FROM lng JOIN nets USING (symbol, data_date)), {_ic("j", "value", "net", "factor, horizon, data_date", 20)},
{_nw("ic", "factor, horizon", "(horizon - 1)", 19)}
SELECT factor, horizon, n_days, {R("mean", 6)} AS ic, {R("t_nw", 4)} AS t_nw FROM nw""")
def factor_ic_grid(spark, sf):
    j = joined(spark, sf)
    long = cross_section.melt(j, ["symbol", "data_date", "horizon", "net"], ["flow", "trust", "mom5"])
    ics = research.rank_ic(long, ["factor", "horizon", "data_date"], "value", "net", 20)
    discard(j)
    nw = research.newey_west(ics, ["factor", "horizon"], "ic", F.col("horizon") - 1, 19)
    return nw.select("factor", "horizon", "n_days", _r("ic", F.col("mean"), 6), _r("t_nw", F.col("t_nw"), 4))


@query("weight_schemes_oos", WV("bars", "flows", "cal") + f""", {_FACTORS}, {_NETS}, {_SPLIT}, {_LONG},
z AS (SELECT symbol, data_date, factor, value FROM lng WHERE factor <> 'mom5'),
j AS (SELECT * FROM z JOIN nets USING (symbol, data_date) JOIN sp USING (data_date) WHERE horizon = 5 AND segment = 'train'),
{_ic("j", "value", "net", "factor, data_date", 20)}, ti AS (SELECT factor, avg(ic) AS ic FROM ic GROUP BY 1),
wt AS (SELECT 'config' AS scheme, factor, CASE factor WHEN 'flow' THEN 0.25::DOUBLE ELSE 0.3::DOUBLE END AS w FROM ti UNION ALL
 SELECT 'sign', factor, sign(ic)::DOUBLE FROM ti UNION ALL SELECT 'train_ic', factor, ic FROM ti),
cb AS (SELECT symbol, data_date, scheme, round(sum(w * value), 10) AS value FROM z JOIN wt USING (factor) GROUP BY 1, 2, 3),
j2 AS (SELECT * FROM cb JOIN nets USING (symbol, data_date) JOIN sp USING (data_date) WHERE horizon = 5 AND segment = 'test'),
rk2 AS (SELECT *, {_rank("value", "scheme, data_date")} AS rx, {_rank("net", "scheme, data_date")} AS ry FROM j2),
ic2 AS (SELECT scheme, data_date, corr(rx, ry) AS ic FROM rk2 GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT scheme, count(*) AS n_days, {R("avg(ic)", 5)} AS ic FROM ic2 GROUP BY 1""")
def weight_schemes_oos(spark, sf):
    bars = materialise(V.bars(spark, sf))
    rows, split = joined(spark, sf, (5,), bars), sent_whole(research.split_by_days(bars, 20))
    discard(bars)
    long = cross_section.melt(rows, ["symbol", "data_date"], ["flow", "trust"])
    net = rows.select("symbol", "data_date", "horizon", "net")
    train = long.join(split.where("segment = 'train'"), "data_date")
    ics = research.factor_grid(train, net, 20).groupBy("factor").agg(F.avg("ic").alias("ic"))
    weights = materialise(research.weights_frame(ics, {"flow": 0.25, "trust": 0.3}))
    combined = research.combine(long, weights).withColumn("value", F.round("value", 10)).join(
        split.where("segment = 'test'"), "data_date").join(net, ["symbol", "data_date"])
    ic = research.rank_ic(combined, ["scheme", "data_date"], "value", "net", 20)
    discard(rows)
    return ic.groupBy("scheme").agg(F.count(F.lit(1)).alias("n_days"), _r("ic", F.avg("ic"), 5))


@query("factor_verdict", WV("bars", "flows", "cal") + f""", {_FACTORS}, {_NETS}, {_SPLIT}, {_LONG},
j AS (SELECT * FROM lng JOIN nets USING (symbol, data_date) JOIN sp USING (data_date) WHERE horizon = 5 AND segment <> 'embargo'),
{_ic("j", "value", "net", "factor, segment, data_date", 20)}, {_nw("ic", "factor, segment", "4", 4)},
p AS (SELECT factor, max(mean) FILTER (segment = 'train') AS tr, max(mean) FILTER (segment = 'test') AS te, max(t_nw) FILTER (segment = 'test') AS t,
 max(n_days) FILTER (segment = 'test') AS days FROM nw GROUP BY 1)
SELECT factor, {R("tr", 6)} AS train_ic, {R("te", 6)} AS test_ic, CASE WHEN tr IS NULL OR te IS NULL OR days < 20 THEN 'insufficient'
 WHEN sign(tr) = sign(te) AND abs(t) > 2 THEN 'robust' ELSE 'failed' END AS verdict FROM p""")
def factor_verdict(spark, sf):
    long = cross_section.melt(joined(spark, sf, (5,)), ["symbol", "data_date", "net"], ["flow", "trust", "mom5"])
    j = long.join(
        research.split_by_days(V.bars(spark, sf), 20).where("segment <> 'embargo'"), "data_date")
    ics = research.rank_ic(j, ["factor", "segment", "data_date"], "value", "net", 20)
    nw = research.newey_west(ics, ["factor", "segment"], "ic", 4, 4)

    def pick(seg, c):
        return F.max(F.when(F.col("segment") == seg, F.col(c)))

    p = nw.groupBy("factor").agg(pick("train", "mean").alias("tr"), pick("test", "mean").alias("te"),
                                 pick("test", "t_nw").alias("t"), pick("test", "n_days").alias("days"))
    return p.select("factor", _r("train_ic", F.col("tr"), 6), _r("test_ic", F.col("te"), 6), research.verdict(
        F.col("tr"), F.col("te"), F.col("t"), F.col("days"), F.lit(True), 20).alias("verdict"))


@query("regime_ic", WV("bars", "flows", "cal", "idx") + f""", {_FACTORS}, {_NETS},
rg AS (SELECT data_date, CASE WHEN index_close / lag(index_close, 4) OVER (ORDER BY data_date) - 1 > 0 THEN 'bull' WHEN lag(index_close, 4) OVER (ORDER BY data_date) IS NOT NULL THEN 'other' END AS regime FROM idx),
j AS (SELECT * FROM fac JOIN nets USING (symbol, data_date) JOIN rg USING (data_date) WHERE horizon = 5 AND regime IS NOT NULL), {_ic("j", "flow", "net", "regime, data_date", 20)}
SELECT regime, count(*) AS n_days, {R("avg(ic)", 6)} AS ic FROM ic GROUP BY 1""")
def regime_ic(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(1)).orderBy("data_date")
    trend = F.col("index_close") / F.lag("index_close", 4).over(w) - 1
    rg = V.index(spark, sf).withColumn("t", trend).where("t IS NOT NULL").select(
        "data_date", F.when(F.col("t") > 0, "bull").otherwise("other").alias("regime"))
    j = joined(spark, sf, (5,)).join(rg, "data_date")
    ic = research.rank_ic(j, ["regime", "data_date"], "flow", "net", 20)
    return ic.groupBy("regime").agg(F.count(F.lit(1)).alias("n_days"), _r("ic", F.avg("ic"), 6))


@query("rank_residual", WV("bars", "flows") + f""", {_FACTORS},
k AS (SELECT symbol, data_date, {_rank("flow", "data_date")} AS fr, {_rank("trust", "data_date")} AS br FROM fac),
m AS (SELECT data_date, count(*) AS n, avg(fr) AS mf, avg(br) AS mb, covar_pop(fr, br) / nullif(var_pop(br), 0) AS s FROM k GROUP BY 1)
SELECT symbol, data_date, {R("fr - (mf + s * (br - mb))", 5)} AS residual FROM k JOIN m USING (data_date) WHERE n >= 3 AND s IS NOT NULL""")
def rank_residual(spark, sf):
    r = research.residualise(factors(spark, sf), ["data_date"], "flow", "trust")
    return r.select("symbol", "data_date", _r("residual", F.col("residual"), 5))


@query("group_spread", WV("bars", "flows", "cal") + f""", {_FACTORS}, {_NETS},
j AS (SELECT * FROM fac JOIN nets USING (symbol, data_date) WHERE horizon = 5),
d AS (SELECT data_date, count(*) FILTER (flow >= 0.3) AS n_high, count(*) FILTER (flow < -0.3) AS n_low,
 avg(net) FILTER (flow >= 0.3) - avg(net) FILTER (flow < -0.3) AS spread FROM j GROUP BY 1)
SELECT data_date, n_high, n_low, {R("spread", 6)} AS spread FROM d WHERE n_high >= 5 AND n_low >= 5""")
def group_spread(spark, sf):
    j = joined(spark, sf, (5,))
    g = research.group_spread(j, ["data_date"], F.col("flow") >= 0.3, F.col("flow") < -0.3, "net", 5)
    return g.select("data_date", "n_high", "n_low", _r("spread", F.col("spread"), 6))


@query("industry_trend", WV("stock", "bars") + f"""
, r AS (SELECT symbol, data_date, close / lag(close, 5) OVER {_BY} - 1 AS ret5 FROM bars),
m AS (SELECT data_date, industry, median(ret5) AS mid FROM r JOIN stock USING (symbol) WHERE ret5 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
q AS (SELECT data_date, quantile_cont(mid, 0.01) AS lo, quantile_cont(mid, 0.99) AS hi, count(*) AS n FROM m GROUP BY 1),
c AS (SELECT data_date, industry, n, greatest(lo, least(hi, mid)) AS v FROM m JOIN q USING (data_date)),
s AS (SELECT data_date, avg(v) AS mv, stddev_pop(v) AS sd FROM c GROUP BY 1)
SELECT data_date, industry, {R("tanh(CASE WHEN sd = 0 THEN 0 ELSE greatest(-5, least(5, (v - mv) / sd)) END / 2)", 6)} AS industry_trend_score
FROM c JOIN s USING (data_date) WHERE n >= 2""")
def industry_trend(spark, sf):
    from tapeworks.plans.features import industry_trend as trend
    r = V.bars(spark, sf).select("symbol", "data_date", rolling.change(F.col("close"), 5, rolling.series()).alias("ret5"))
    t = trend(r, V.stock(spark, sf), DEFAULTS)
    return t.select("data_date", "industry", _r("industry_trend_score", F.col("industry_trend_score"), 6))


def _model_rows(spark, sf):
    net = nets(spark, sf, (5,)).select("symbol", "data_date", "net")
    split = research.split_by_days(V.bars(spark, sf), 20)
    return materialise(factors(spark, sf).join(net, ["symbol", "data_date"], "left").join(split, "data_date"))


# three columns, so the normal equations of the standardised columns are written out (Cramer's rule, penalty 1)
@query("ridge_factor_model", WV("bars", "flows", "cal") + f""", {_FACTORS}, {_NETS}, {_SPLIT},
m AS (SELECT symbol, data_date, segment, net, flow, trust, mom5 FROM fac JOIN nets USING (symbol, data_date) JOIN sp USING (data_date)
 WHERE horizon = 5 AND segment <> 'embargo' AND net IS NOT NULL),
md AS (SELECT median(flow) AS a, median(trust) AS b, median(mom5) AS c FROM m WHERE segment = 'train'),
x AS (SELECT symbol, data_date, segment, net, coalesce(flow, a) AS x1, coalesce(trust, b) AS x2, coalesce(mom5, c) AS x3 FROM m, md),
st AS (SELECT count(*) AS n, avg(net) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3,
 count(*) + 1 AS g, count(*) * corr(x1, x2) AS p, count(*) * corr(x1, x3) AS q, count(*) * corr(x2, x3) AS r,
 count(*) * covar_pop(x1, net) / stddev_pop(x1) AS v1, count(*) * covar_pop(x2, net) / stddev_pop(x2) AS v2,
 count(*) * covar_pop(x3, net) / stddev_pop(x3) AS v3 FROM x WHERE segment = 'train'),
bt AS (SELECT *, g * (g * g - r * r) - p * (p * g - r * q) + q * (p * r - g * q) AS det FROM st),
pr AS (SELECT symbol, data_date, segment, net, {R("""my
 + (v1 * (g * g - r * r) - p * (v2 * g - r * v3) + q * (v2 * r - g * v3)) / det * (x1 - m1) / s1
 + (g * (v2 * g - r * v3) - v1 * (p * g - r * q) + q * (p * v3 - v2 * q)) / det * (x2 - m2) / s2
 + (g * (g * v3 - v2 * r) - p * (p * v3 - v2 * q) + v1 * (p * r - g * q)) / det * (x3 - m3) / s3""", 9)} AS prediction FROM x, bt),
{_ic("pr", "prediction", "net", "segment, data_date", 20)}
SELECT segment, count(*) AS n_days, {R("avg(ic)", 6)} AS ic FROM ic GROUP BY 1""")
def ridge_factor_model(spark, sf):
    """Rank IC of the ridge prediction by segment."""
    _, scored = models.fit_and_score(_model_rows(spark, sf), ["flow", "trust", "mom5"], "net")
    known = scored.where("net IS NOT NULL").withColumn("prediction", rounded(F.col("prediction"), 9))
    ic = research.rank_ic(known, ["segment", "data_date"], "prediction", "net", 20)
    return ic.groupBy("segment").agg(F.count(F.lit(1)).alias("n_days"), _r("ic", F.avg("ic"), 6))


@query("gbm_importance")
def gbm_importance(spark, sf):
    model, _ = models.fit_and_score(_model_rows(spark, sf), ["flow", "trust", "mom5"], "net", kind="gbm")
    return models.importances(model, ["flow", "trust", "mom5"], V.table(spark, sf, "supplier"))
