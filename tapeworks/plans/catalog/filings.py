"""Insider filings as of a date."""
from pyspark.sql import functions as F

from tapeworks.functions.numbers import rounded
from tapeworks.operators import cross_section, filings
from tapeworks.operators.calendar import market_calendar, usable_window
from tapeworks.plans import views as V
from tapeworks.plans.catalog.registry import R, query
from tapeworks.session import materialise

WV = V.with_views
AS_OF, TARGET = "1999-03-31 15:00:00", "1999-03-31"
# several report dates and sources per (symbol, month): only the newest visible one counts
_VIS = f"""vis AS (SELECT * FROM holdings WHERE available_at <= TIMESTAMP '{AS_OF}'),
ver AS (SELECT symbol, data_date, source, report_date, max(available_at) AS a FROM vis GROUP BY 1, 2, 3, 4),
bst AS (SELECT symbol, data_date, source, report_date FROM ver QUALIFY row_number() OVER (PARTITION BY symbol, data_date ORDER BY a DESC, (source = 'openapi') DESC, report_date DESC) = 1),
cur AS (SELECT vis.* FROM vis JOIN bst USING (symbol, data_date, source, report_date)),
ppl AS (SELECT symbol, data_date, holder_name, max(current_shares) AS c, max(pledged_shares) AS p, bool_or(starts_with(title, '大股東')) AS mj FROM cur GROUP BY 1, 2, 3),
mon AS (SELECT symbol, data_date, count(*) AS holders, CASE WHEN count(c) = count(*) THEN sum(c) END AS total,
  CASE WHEN count(c) = count(*) AND sum(c) > 0 AND count(*) FILTER (c > 0 AND p IS NULL) = 0 THEN sum(p) FILTER (c > 0) / sum(c)::DOUBLE END AS ratio FROM ppl GROUP BY 1, 2),
chg AS (SELECT a.symbol, a.data_date, count(*) AS n, CASE WHEN count(*) FILTER (a.c IS NOT NULL AND b.c IS NOT NULL) = count(*) AND sum(b.c) > 0 THEN (sum(a.c) - sum(b.c)) / sum(b.c)::DOUBLE END AS change_pct,
  CASE WHEN count(*) FILTER (a.mj AND b.mj) > 0 AND count(*) FILTER (a.mj AND b.mj AND a.c IS NOT NULL AND b.c IS NOT NULL) = count(*) FILTER (a.mj AND b.mj)
   AND sum(b.c) FILTER (a.mj AND b.mj) > 0 THEN (sum(a.c) FILTER (a.mj AND b.mj) - sum(b.c) FILTER (a.mj AND b.mj)) / (sum(b.c) FILTER (a.mj AND b.mj))::DOUBLE END AS major_change_pct
  FROM ppl a JOIN ppl b ON a.symbol = b.symbol AND a.holder_name = b.holder_name AND a.data_date = last_day(b.data_date + 1) GROUP BY 1, 2)"""


def _at():
    return F.lit(AS_OF).cast("timestamp")


def _r(name, col, n):
    return rounded(col, n).alias(name)


@query("latest_visible_version", WV("holdings") + f""", {_VIS} SELECT symbol, data_date, source, report_date, count(*) AS n FROM cur GROUP BY ALL""")
def latest_visible_version(spark, sf):
    return filings.visible_versions(V.holdings(spark, sf), _at()).groupBy("symbol", "data_date", "source", "report_date").agg(
        F.count(F.lit(1)).alias("n"))


@query("continuing_members", WV("holdings") + f""", {_VIS} SELECT symbol, data_date, n AS continuing, {R("change_pct", 6)} AS change_pct, {R("major_change_pct", 6)} AS major_change_pct FROM chg""")
def continuing_members(spark, sf):
    c = filings.continuing_change(filings.holders(filings.visible_versions(V.holdings(spark, sf), _at())))
    return c.select("symbol", "data_date", "continuing", _r("change_pct", F.col("change_pct"), 6), _r("major_change_pct", F.col("major_change_pct"), 6))


_HOLD = f"""{_VIS}, lst AS (SELECT mon.*, ch.change_pct, ch.major_change_pct, mon.ratio - pv.ratio AS pchg FROM mon LEFT JOIN chg ch USING (symbol, data_date)
  LEFT JOIN mon pv ON pv.symbol = mon.symbol AND mon.data_date = last_day(pv.data_date + 1) QUALIFY row_number() OVER (PARTITION BY mon.symbol ORDER BY mon.data_date DESC) = 1),
hf AS (SELECT * FROM lst WHERE (1999 * 12 + 3) - (year(data_date) * 12 + month(data_date)) <= 2)"""


@query("holder_features", WV("holdings") + f""", {_HOLD}
SELECT symbol, data_date AS holding_month, CAST(total AS BIGINT) AS total, {R("change_pct", 6)} AS change_pct, {R("ratio", 6)} AS pledge_ratio, {R("pchg", 6)} AS pledge_ratio_change,
 {R("major_change_pct", 6)} AS major_change_pct FROM hf""")
def holder_features(spark, sf):
    h = filings.holding_features(V.holdings(spark, sf), F.lit(TARGET).cast("date"), _at())
    return h.select("symbol", "holding_month", "total", *[_r(c, F.col(c), 6) for c in (
        "change_pct", "pledge_ratio", "pledge_ratio_change", "major_change_pct")])


def _resolve(src: str, start: str, as_of: str = f"TIMESTAMP '{AS_OF}'") -> str:
    return f"""sn AS (SELECT *, row_number() OVER (ORDER BY row_hash) AS rid FROM {src} WHERE available_at <= {as_of}),
cd AS (SELECT a.rid AS by_rid, a.symbol, b.rid AS vic FROM sn a LEFT JOIN sn b ON a.symbol = b.symbol AND b.data_date = a.amends_report_date AND a.reporter_role = b.reporter_role
  AND a.reporter_name = b.reporter_name AND a.rid <> b.rid WHERE a.amends_report_date IS NOT NULL AND a.amends_report_date >= {start}),
cn AS (SELECT by_rid, any_value(symbol) AS symbol, count(vic) AS n, max(vic) AS vic FROM cd GROUP BY 1),
lv AS (SELECT sn.*, method_category = 'market' AND rid NOT IN (SELECT vic FROM cn WHERE n = 1)
  AND NOT coalesce(CAST(superseded_on + 1 AS TIMESTAMP) + INTERVAL 8 HOUR <= {as_of}, false) AS live,
  planned_own_shares + planned_trust_shares AS tot, coalesce(transfer_shares <> planned_own_shares + planned_trust_shares, false) AS bad FROM sn),
rs AS (SELECT lv.symbol, count(*) FILTER (live) AS n_live, bool_or(live AND bad) AS inconsistent, coalesce(bool_or(am.symbol IS NOT NULL), false) AS ambiguous,
  count(*) FILTER (live AND tot IS NOT NULL AND NOT bad) AS known, sum(tot) FILTER (live) AS s FROM lv LEFT JOIN (SELECT DISTINCT symbol FROM cn WHERE n <> 1) am ON am.symbol = lv.symbol GROUP BY 1),
tr AS (SELECT symbol, ambiguous, inconsistent, n_live > 0 OR ambiguous AS listed, CASE WHEN NOT ambiguous AND NOT inconsistent AND known = n_live THEN s END AS shares FROM rs)"""


# every declaration, resolved by symbol and quarter as of the last one
_QUARTER = "rc AS (SELECT * REPLACE (symbol * 1000 + 4 * (year(data_date) - 1990) + quarter(data_date) AS symbol) FROM declarations)"


@query("amendment_self_join", WV("declarations") + f""", {_QUARTER}, {_resolve("rc", "DATE '0001-01-01'", "(SELECT max(available_at) FROM declarations)")}
SELECT symbol // 1000 AS symbol, symbol % 1000 AS quarter, ambiguous, inconsistent, listed, CAST(shares AS BIGINT) AS shares FROM tr""")
def amendment_self_join(spark, sf):
    d = V.declarations(spark, sf)
    quarter = 4 * (F.year("data_date") - 1990) + F.quarter("data_date")
    r = filings.resolve_transfers(d.withColumn("symbol", F.col("symbol") * 1000 + quarter), d.agg(F.max("available_at")).scalar())
    return r.select(F.floor(F.col("symbol") / 1000).alias("symbol"), (F.col("symbol") % 1000).alias("quarter"), "ambiguous", "inconsistent", "listed", "shares")


@query("amendment_resolution_full", WV("declarations") + f""", {_resolve("declarations", "DATE '1999-03-01'")}
SELECT symbol, ambiguous, inconsistent, listed, CAST(shares AS BIGINT) AS shares FROM tr""")
def amendment_resolution_full(spark, sf):
    return filings.resolve_transfers(V.declarations(spark, sf), _at(), F.lit("1999-03-01").cast("date")).select("symbol", "ambiguous", "inconsistent", "listed", "shares")


_WIN = f"""win AS (SELECT data_date FROM cal WHERE CAST(data_date + 1 AS TIMESTAMP) + INTERVAL 8 HOUR <= TIMESTAMP '{AS_OF}' AND data_date <= DATE '{TARGET}' ORDER BY data_date DESC LIMIT 8)"""
_RATIO = f"""{_HOLD}, {_WIN}, rc AS (SELECT * FROM declarations WHERE data_date BETWEEN (SELECT min(data_date) FROM win) AND DATE '{TARGET}'),
{_resolve("rc", "(SELECT min(data_date) FROM win)")},
cov AS (SELECT market FROM bars JOIN stock USING (symbol) WHERE data_date IN (SELECT data_date FROM win) GROUP BY 1 HAVING count(DISTINCT data_date) = (SELECT count(*) FROM win))"""


def _shadow(spark, sf):
    b, st = V.bars(spark, sf), V.stock(spark, sf)
    target = F.lit(TARGET).cast("date")
    usable = (F.col("data_date").cast("timestamp") + F.expr("INTERVAL 32 HOURS") <= _at()) & (F.col("data_date") <= target)
    win = usable_window(market_calendar(b), usable, 8).select("data_date")
    coverage = b.join(st, "symbol").select("market", "data_date", 
                                                 F.when(F.col("market").isin("ASIA", "EUROPE"), "forward").when(F.col("market") == "AFRICA", "backfill")
                                                 .when(F.col("symbol") % 2 == 0, "forward").otherwise("backfill").alias("ingestion_mode"))
    return filings.shadow_features(st.select("symbol", "market"), V.holdings(spark, sf), V.declarations(spark, sf), coverage, win, target, _at())


@query("transfer_ratio", WV("stock", "bars", "cal", "holdings", "declarations") + f""", {_RATIO}
SELECT st.symbol, hf.data_date AS holding_month, {R("CASE WHEN cov.market IS NULL OR coalesce(hf.total, 0) <= 0 THEN NULL WHEN NOT coalesce(tr.listed, false) THEN 0 ELSE tr.shares / hf.total::DOUBLE END", 7)} AS sale_ratio
FROM stock st LEFT JOIN hf USING (symbol) LEFT JOIN tr USING (symbol) LEFT JOIN cov USING (market)""")
def transfer_ratio(spark, sf):
    return _shadow(spark, sf).select("symbol", "holding_month", _r("sale_ratio", F.col("transfer_market_sale_ratio"), 7))


_SALE = "CASE WHEN cov.market IS NULL OR coalesce(hf.total, 0) <= 0 THEN NULL WHEN NOT coalesce(tr.listed, false) THEN 0 ELSE tr.shares / hf.total::DOUBLE END"


@query("shadow_features_z", WV("stock", "bars", "cal", "holdings", "declarations") + f""", {_RATIO},
raw AS (SELECT st.symbol, unnest(['insider_holding_change_pct', 'insider_pledge_ratio', 'insider_pledge_ratio_change', 'major_holder_change_pct', 'transfer_market_sale_ratio']) AS factor,
 unnest([hf.change_pct, hf.ratio, hf.pchg, hf.major_change_pct, {_SALE}]) AS x FROM stock st LEFT JOIN hf USING (symbol) LEFT JOIN tr USING (symbol) LEFT JOIN cov USING (market)),
v AS (SELECT * FROM raw WHERE x IS NOT NULL), q AS (SELECT factor, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM v GROUP BY 1),
c AS (SELECT symbol, factor, greatest(lo, least(hi, x)) AS x FROM v JOIN q USING (factor)),
m AS (SELECT factor, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM c GROUP BY 1)
SELECT symbol, factor, {R("CASE WHEN n < 2 THEN NULL WHEN s = 0 THEN 0 ELSE greatest(-5, least(5, (x - m) / s)) END", 5)} AS z FROM c JOIN m USING (factor)""")
def shadow_features_z(spark, sf):
    raw = materialise(_shadow(spark, sf))
    long = cross_section.melt(raw, ["symbol", "data_date"], list(filings.RAW_COLUMNS))
    z = cross_section.winsor_z(long, ["data_date", "factor"], "value", "z")
    return z.select("symbol", "factor", _r("z", F.col("z"), 5))


def _class(modes: str) -> str:
    return f"""CASE WHEN {modes} IS NULL OR len({modes}) = 0 OR len(list_filter({modes}, lambda x: x NOT IN ('forward', 'backfill'))) > 0 THEN 'unknown' WHEN NOT list_contains({modes}, 'backfill') THEN 'point_in_time_safe'
 WHEN NOT list_contains({modes}, 'forward') THEN 'backfill_derived' ELSE 'mixed' END"""


@query("transfer_provenance", WV("stock", "bars", "cal", "holdings", "declarations") + f""", {_RATIO},
cm AS (SELECT market, list(DISTINCT CASE WHEN market IN ('ASIA', 'EUROPE') THEN 'forward' WHEN market = 'AFRICA' THEN 'backfill' WHEN symbol % 2 = 0 THEN 'forward' ELSE 'backfill' END) AS m
 FROM bars JOIN stock USING (symbol) JOIN cov USING (market) WHERE data_date IN (SELECT data_date FROM win) GROUP BY 1),
mm AS (SELECT symbol, list(DISTINCT coalesce(ingestion_mode, '?')) AS m FROM sn GROUP BY 1),
hm AS (SELECT symbol, data_date, list(DISTINCT coalesce(ingestion_mode, '?')) AS m FROM cur GROUP BY 1, 2),
hp AS (SELECT hf.symbol, a.m AS now, list_distinct(a.m || coalesce(b.m, [])) AS two FROM hf JOIN hm a USING (symbol, data_date) LEFT JOIN hm b ON b.symbol = hf.symbol AND hf.data_date = last_day(b.data_date + 1)),
al AS (SELECT st.symbol, hp.two, list_distinct(coalesce(cm.m, ['?']) || coalesce(mm.m, []) || coalesce(hp.now, ['?'])) AS m FROM stock st LEFT JOIN cm USING (market) LEFT JOIN mm USING (symbol) LEFT JOIN hp USING (symbol))
SELECT symbol, {_class("two")} AS holding_provenance, {_class("m")} AS transfer_provenance FROM al""")
def transfer_provenance(spark, sf):
    return _shadow(spark, sf).select("symbol", "holding_provenance", "transfer_provenance")


@query("disclosure_times", """SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS month_end, greatest(CAST(last_day(CAST(o_orderdate AS DATE)) + 21 AS TIMESTAMP) + INTERVAL 8 HOUR,
 CAST(CAST(o_orderdate AS DATE) + 41 AS TIMESTAMP) + INTERVAL 8 HOUR) AS holding_at, CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP) + INTERVAL 8 HOUR AS declaration_at FROM orders""")
def disclosure_times(spark, sf):
    from tapeworks.functions import dates as dt
    day, month = F.to_date("o_orderdate"), F.last_day("o_orderdate")
    return V.table(spark, sf, "orders").select(
        month.alias("month_end"), dt.available_holding(month, F.date_add(day, 40)).alias("holding_at"),
        dt.available_declaration(day).alias("declaration_at")).distinct()
