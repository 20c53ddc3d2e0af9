"""Grouped statistics: counts, medians, breadth, coverage, strict sums."""
from pyspark.sql import functions as F

from tapeworks.config import DEFAULTS
from tapeworks.functions.numbers import rounded
from tapeworks.operators import calendar, filings, order_stats, research
from tapeworks.plans import regime, reports
from tapeworks.plans import views as V
from tapeworks.plans.catalog.registry import R, query
from tapeworks.sources.reports import summarise_levels

W = V.with_views


@query("action_counts", f"""SELECT o_orderstatus AS action, count(*) AS n, {R("avg(CAST(o_totalprice AS DECIMAL(18,2)))", 1)} AS avg_score
FROM orders GROUP BY 1""")
def action_counts(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("action"),
                                            F.col("o_totalprice").cast("decimal(18,2)").alias("chip_score"))
    return reports.action_counts(o)


@query("industry_median_matrix", W("stock", "bars", "flows") + f"""
, last_days AS (SELECT DISTINCT data_date FROM bars ORDER BY data_date DESC LIMIT 60)
SELECT industry, data_date, count(*) AS n, {R("median(close)", 4)} AS price, {R("median(turnover)", 2)} AS turnover,
 {R("median(margin_balance)", 2)} AS margin
FROM bars JOIN stock USING (symbol) LEFT JOIN flows USING (symbol, data_date) WHERE data_date IN (SELECT data_date FROM last_days)
GROUP BY 1, 2 HAVING count(*) >= 5""")
def industry_median_matrix(spark, sf):
    out = reports.industry_matrix(V.bars(spark, sf), V.stock(spark, sf), V.flows(spark, sf).select(
        "symbol", "data_date", "margin_balance"), 60, 5, {"price": "close", "turnover": "turnover", "margin": "margin_balance"})
    return out.select("industry", "data_date", "n", rounded(F.col("price"), 4).alias("price"),
                      rounded(F.col("turnover"), 2).alias("turnover"), rounded(F.col("margin"), 2).alias("margin"))


@query("industry_order", W("stock", "bars") + f"""
, cells AS (SELECT nation AS industry, data_date, count(*) AS n, median(turnover) AS v FROM bars JOIN stock USING (symbol) GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT industry, max(n) AS n_max, {R("max(v) FILTER (data_date = (SELECT max(data_date) FROM cells))", 2)} AS latest FROM cells GROUP BY 1""")
def industry_order(spark, sf):
    st = V.stock(spark, sf).select("symbol", F.col("nation").alias("industry"))
    cells = reports.industry_matrix(V.bars(spark, sf), st, None, None, 3, {"v": "turnover"})
    return reports.industry_order(cells, "v").select("industry", "n_max", rounded(F.col("latest"), 2).alias("latest"))


@query("breadth", W("bars", "actions", "cal") + """
, p AS (SELECT b.symbol, b.data_date, b.close, c.day_no, lag(b.close) OVER w AS pc, lag(c.day_no) OVER w AS pd, lag(b.data_date) OVER w AS pdate
  FROM bars b JOIN cal c USING (data_date) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.data_date)),
f AS (SELECT p.symbol, p.data_date, coalesce(product(a.adj_factor), 1) AS k FROM p LEFT JOIN actions a
  ON a.symbol = p.symbol AND a.data_date > p.pdate AND a.data_date <= p.data_date GROUP BY 1, 2)
SELECT data_date, count(*) FILTER (close - pc * k > 1e-9 AND pd = day_no - 1) AS advancers,
 count(*) FILTER (close - pc * k < -1e-9 AND pd = day_no - 1) AS decliners FROM p JOIN f USING (symbol, data_date) GROUP BY 1""")
def breadth(spark, sf):
    return regime.breadth(V.bars(spark, sf), V.actions(spark, sf))


@query("pivot_symbol_week", W("bars") + f"""
, d AS (SELECT DISTINCT data_date FROM bars ORDER BY data_date DESC LIMIT 2)
SELECT symbol, {R("max(close) FILTER (data_date = (SELECT min(data_date) FROM d))", 4)} AS prev,
 {R("max(close) FILTER (data_date = (SELECT max(data_date) FROM d))", 4)} AS cur FROM bars WHERE data_date IN (SELECT data_date FROM d) GROUP BY 1""")
def pivot_symbol_week(spark, sf):
    b = V.bars(spark, sf)
    two = b.select("data_date").distinct().orderBy(F.col("data_date").desc()).limit(2).withColumn("slot", F.when(
        F.col("data_date") == reports.latest_date(b), "cur").otherwise("prev"))
    wide = b.join(two, "data_date").groupBy("symbol").pivot("slot", ["prev", "cur"]).agg(F.avg("close"))
    return wide.select("symbol", rounded(F.col("prev"), 4).alias("prev"), rounded(F.col("cur"), 4).alias("cur"))


@query("coverage_span", """SELECT 'lineitem' AS source, count(DISTINCT CAST(l_shipdate AS DATE)) AS days, min(CAST(l_shipdate AS DATE)) AS first_date,
 max(CAST(l_shipdate AS DATE)) AS last_date, count(*) AS rows FROM lineitem UNION ALL
SELECT 'orders', count(DISTINCT CAST(o_orderdate AS DATE)), min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), count(*) FROM orders
UNION ALL SELECT 'events', count(DISTINCT CAST(ts AS DATE)), min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), count(*) FROM events""")
def coverage_span(spark, sf):
    return reports.coverage_span({
        "lineitem": V.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("data_date")),
        "orders": V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("data_date")),
        "events": V.table(spark, sf, "events").select(F.to_date("ts").alias("data_date"))})


@query("row_counts", "SELECT 'lineitem' AS source, count(*) AS n FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def row_counts(spark, sf):
    def one(t):
        return V.table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("source"), "n")
    return one("lineitem").unionByName(one("events"))


@query("tick_daily_stats", W("ticks") + """
, last_days AS (SELECT DISTINCT data_date FROM ticks ORDER BY data_date DESC LIMIT 20)
SELECT data_date, count(DISTINCT symbol) AS symbols, count(*) AS ticks FROM ticks WHERE data_date IN (SELECT data_date FROM last_days) GROUP BY 1""")
def tick_daily_stats(spark, sf):
    return reports.tick_daily(V.ticks(spark, sf), 20)


@query("level_buckets", W("levels") + """
SELECT symbol, data_date, CAST(coalesce(sum(ratio) FILTER (level BETWEEN 1 AND 8), 0) AS DOUBLE) AS retail_ratio,
 CAST(coalesce(sum(ratio) FILTER (level BETWEEN 9 AND 11), 0) AS DOUBLE) AS medium_ratio,
 CAST(coalesce(sum(ratio) FILTER (level BETWEEN 12 AND 14), 0) AS DOUBLE) AS large_ratio,
 CAST(coalesce(sum(ratio) FILTER (level = 15), 0) AS DOUBLE) AS super_large_ratio,
 max(holder_count) FILTER (level = 17) AS holder_count FROM levels GROUP BY 1, 2""")
def level_buckets(spark, sf):
    rows = V.holder_levels(spark, sf).withColumn("available_at", F.date_add("data_date", 5))
    return summarise_levels(rows, DEFAULTS["holders"]).drop("available_at")


@query("average_turnover_top", W("bars") + f"""
SELECT symbol, {R("avg(CAST(turnover AS DECIMAL(18,2)))", 2)} AS avg_turnover FROM bars
WHERE data_date > (SELECT max(data_date) FROM bars) - 210 GROUP BY 1 ORDER BY avg(CAST(turnover AS DECIMAL(18,2))) DESC, symbol LIMIT 30""")
def average_turnover_top(spark, sf):
    b = V.bars(spark, sf)
    since = F.date_sub(reports.latest_date(b), 210)
    return b.where(F.col("data_date") > since).groupBy("symbol").agg(
        F.avg(F.col("turnover").cast("decimal(18,2)")).alias("t")).orderBy(F.col("t").desc(), "symbol").limit(30).select(
        "symbol", rounded(F.col("t"), 2).alias("avg_turnover"))


@query("strict_sum_null", W("holdings") + """
, p AS (SELECT symbol, data_date, holder_name, max(current_shares) AS current, max(pledged_shares) AS pledged FROM holdings GROUP BY 1, 2, 3)
SELECT symbol, data_date, count(*) AS holders, CAST(CASE WHEN count(current) = count(*) THEN sum(current) END AS BIGINT) AS total FROM p GROUP BY 1, 2""")
def strict_sum_null(spark, sf):
    return filings.month_totals(filings.holders(V.holdings(spark, sf))).select("symbol", "data_date", "holders", "total")


@query("covered_turnover", W("bars") + f"""
, d AS (SELECT * FROM bars WHERE data_date = (SELECT max(data_date) FROM bars)), t AS (SELECT * FROM d ORDER BY turnover DESC, symbol LIMIT 20)
SELECT symbol, turnover, {R("(SELECT sum(turnover) FROM t) / (SELECT sum(turnover) FROM d)", 4)} AS covered FROM t""")
def covered_turnover(spark, sf):
    b = V.bars(spark, sf)
    day = b.where(F.col("data_date") == reports.latest_date(b))
    return reports.market_heat(day, 20).select("symbol", "turnover", rounded(F.col("covered"), 4).alias("covered"))


@query("missing_rates", W("flows") + f"""
, l AS (SELECT data_date, 'margin_balance' AS factor, margin_balance IS NOT NULL AS known FROM flows UNION ALL
 SELECT data_date, 'short_balance', short_balance IS NOT NULL FROM flows UNION ALL SELECT data_date, 'sbl_balance', sbl_balance IS NOT NULL FROM flows),
d AS (SELECT factor, data_date, count(*) FILTER (known) AS k, count(*) AS n FROM l GROUP BY 1, 2)
SELECT factor, {R("sum(n - k) / sum(n)::DOUBLE", 6)} AS missing_rate, CAST(min(k) AS BIGINT) AS min_names, count(*) AS days, {R("median(k)", 1)} AS median_names
FROM d GROUP BY 1""")
def missing_rates(spark, sf):
    out = research.coverage_by_factor(V.flows(spark, sf), ["margin_balance", "short_balance", "sbl_balance"])
    return out.select("factor", rounded(F.col("missing_rate"), 6).alias("missing_rate"), "min_names", "days",
                      rounded(F.col("median_names"), 1).alias("median_names"))


@query("provenance_classes", W("holdings") + """
SELECT symbol, data_date, CASE WHEN bool_or(ingestion_mode IS NULL) THEN 'unknown'
 WHEN bool_and(ingestion_mode = 'forward') THEN 'point_in_time_safe' WHEN bool_and(ingestion_mode = 'backfill') THEN 'backfill_derived'
 ELSE 'mixed' END AS provenance FROM holdings GROUP BY 1, 2""")
def provenance_classes(spark, sf):
    return V.holdings(spark, sf).groupBy("symbol", "data_date").agg(
        filings.provenance_class(filings.mode_set("ingestion_mode")).alias("provenance"))


@query("provenance_counts", W("holdings") + """
, c AS (SELECT data_date, current_shares AS v, CASE ingestion_mode WHEN 'forward' THEN 'point_in_time_safe' WHEN 'backfill' THEN 'backfill_derived'
  ELSE 'unknown' END AS prov FROM holdings WHERE current_shares IS NOT NULL),
d AS (SELECT data_date, count(*) FILTER (prov = 'point_in_time_safe') AS s FROM c GROUP BY 1)
SELECT count(*) FILTER (prov = 'point_in_time_safe') AS safe, count(*) FILTER (prov = 'backfill_derived') AS backfill,
 count(*) FILTER (prov = 'unknown') AS mixed_unknown, (SELECT count(*) FROM d WHERE s >= 60) AS honest_days FROM c""")
def provenance_counts(spark, sf):
    h = V.holdings(spark, sf).withColumn("prov", F.when(F.col("ingestion_mode") == "forward", "point_in_time_safe").when(
        F.col("ingestion_mode") == "backfill", "backfill_derived").otherwise("unknown"))
    return research.provenance_counts(h, "current_shares", "prov", 60)


@query("group_quantiles", W("bars") + f"""
SELECT data_date, count(*) AS n, {R("quantile_cont(turnover, 0.05)", 4)} AS q05, {R("quantile_cont(turnover, 0.5)", 4)} AS q50,
 {R("quantile_cont(turnover, 0.99)", 4)} AS q99 FROM bars GROUP BY 1""")
def group_quantiles(spark, sf):
    q = order_stats.quantiles(V.bars(spark, sf), ["data_date"], "turnover", {"q05": 0.05, "q50": 0.5, "q99": 0.99})
    return q.select("data_date", F.col("_n").alias("n"), *[rounded(F.col(c), 4).alias(c) for c in ("q05", "q50", "q99")])


@query("calendar_numbered", W("cal") + "SELECT data_date, day_no, next_date FROM cal")
def calendar_numbered(spark, sf):
    return calendar.market_calendar(V.bars(spark, sf)).withColumn("day_no", F.col("day_no").cast("bigint"))


@query("dashboard", W("bars", "idx") + f"""
, r AS (SELECT symbol, data_date, {R("100 * (rank() OVER (PARTITION BY data_date ORDER BY turnover) + (count(*) OVER (PARTITION BY data_date, turnover) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY data_date)", 1)} AS s FROM bars),
d AS (SELECT *, CASE WHEN s >= 75 THEN 'BUY' WHEN s >= 65 THEN 'WATCH' WHEN s >= 40 THEN 'HOLD' ELSE 'AVOID' END AS action FROM r
  WHERE data_date = (SELECT max(data_date) FROM r)),
m AS (SELECT data_date, index_close, lag(index_close) OVER (ORDER BY data_date) AS prev FROM idx)
SELECT data_date, (SELECT count(*) FROM d) AS total, (SELECT {R("avg(s)", 1)} FROM d) AS avg_score, (SELECT count(*) FROM d WHERE action = 'BUY') AS buy,
 (SELECT count(*) FROM d WHERE action = 'WATCH') AS watch, (SELECT count(*) FROM d WHERE action = 'HOLD') AS hold,
 (SELECT count(*) FROM d WHERE action = 'AVOID') AS avoid, {R("index_close", 4)} AS index_close, {R("index_close - prev", 2)} AS index_change,
 (SELECT string_agg(symbol, ',' ORDER BY s DESC, symbol) FROM (SELECT symbol, s FROM d ORDER BY s DESC, symbol LIMIT 10)) AS top
FROM m WHERE data_date = (SELECT max(data_date) FROM d)""")
def dashboard(spark, sf):
    b = V.bars(spark, sf)
    s = order_stats.percentile_score(b, ["data_date"], "turnover", "_p", None).withColumn(
        "chip_score", rounded(F.col("_p"), 1))
    c = F.col("chip_score")
    s = s.withColumn("action", F.when(c >= 75, "BUY").when(c >= 65, "WATCH").when(c >= 40, "HOLD").otherwise("AVOID"))
    market = V.index(spark, sf).withColumn("advancers", F.lit(0)).withColumn("decliners", F.lit(0)).withColumn(
        "market_trend_score", F.lit(None).cast("double"))
    return reports.dashboard(s, market).select(
        "data_date", "total", "avg_score", "buy", "watch", "hold", "avoid", rounded(F.col("index_close"), 4).alias("index_close"),
        "index_change", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))

