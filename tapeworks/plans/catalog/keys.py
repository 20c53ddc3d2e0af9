"""Look-ups, filters, joins, sets, merges."""
from pyspark.sql import functions as F

from tapeworks.config import DEFAULTS, version_of
from tapeworks.functions.numbers import rounded
from tapeworks.functions.text import is_stock_symbol, row_hash
from tapeworks.operators import adjust, calendar, joins, merge, order_stats
from tapeworks.plans import reports
from tapeworks.plans import views as V
from tapeworks.plans.catalog.registry import R, query

W = V.with_views


@query("latest_per_symbol", W("bars") + f"""
SELECT symbol, max(data_date) AS data_date, {R("arg_max(close, data_date)", 4)} AS close,
  arg_max(volume, data_date) AS volume FROM bars GROUP BY symbol""")
def latest_per_symbol(spark, sf):
    return joins.latest_per_key(V.bars(spark, sf), ["symbol"], "data_date").select(
        "symbol", "data_date", rounded(F.col("close"), 4).alias("close"), "volume")


@query("on_or_before", W("bars") + f"""
SELECT symbol, max(data_date) AS data_date, {R("arg_max(close, data_date)", 4)} AS close
FROM bars WHERE data_date <= DATE '1998-06-30' GROUP BY symbol""")
def on_or_before(spark, sf):
    return joins.on_or_before(V.bars(spark, sf), ["symbol"], F.lit("1998-06-30").cast("date")).select(
        "symbol", "data_date", rounded(F.col("close"), 4).alias("close"))


@query("date_range_scan", """SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS data_date, l_quantity AS quantity
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-04-01'""")
def date_range_scan(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
                    & (F.col("l_shipdate") < F.lit("1998-04-01").cast("timestamp"))).select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("data_date"), F.col("l_quantity").alias("quantity"))


@query("last_n_rows", W("bars") + f"""
SELECT symbol, data_date, {R("close", 4)} AS close FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY data_date DESC) <= 20""")
def last_n_rows(spark, sf):
    return joins.last_rows(V.bars(spark, sf), ["symbol"], 20, "data_date").select(
        "symbol", "data_date", rounded(F.col("close"), 4).alias("close"))


_FUT = """fut AS (SELECT l_returnflag AS contract, CAST(date_trunc('month', l_shipdate) AS DATE) AS data_date,
  CAST(l_linenumber AS INT) AS contract_month, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2, 3)"""


def _futures(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("contract"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("data_date"),
        F.col("l_linenumber").alias("contract_month")).agg(
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).cast("bigint").alias("volume"))


@query("front_contract", f"""WITH {_FUT} SELECT contract, data_date, contract_month, volume FROM fut
QUALIFY row_number() OVER (PARTITION BY contract, data_date ORDER BY volume DESC NULLS LAST, contract_month DESC) = 1""")
def front_contract(spark, sf):
    return joins.best_per_key(_futures(spark, sf), ["contract", "data_date"], "volume", "contract_month")


@query("market_day_with_previous", W("bars", "idx") + f"""
SELECT data_date, {R("index_close", 4)} AS index_close, {R("lag(index_close) OVER (ORDER BY data_date)", 4)} AS prev_close
FROM idx""")
def market_day_with_previous(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(1)).orderBy("data_date")
    return V.index(spark, sf).select(
        "data_date", rounded(F.col("index_close"), 4).alias("index_close"),
        rounded(F.lag("index_close").over(w), 4).alias("prev_close"))


@query("universe_filter", """SELECT CASE WHEN regexp_matches(code, '^[0-9]{4}$') AND code NOT LIKE '00%' THEN code END AS symbol, count(*) AS n
FROM (SELECT CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END AS code FROM part) GROUP BY 1""")
def universe_filter(spark, sf):
    """Parts by whole code; all codes outside the universe are counted under a NULL symbol."""
    key = F.col("p_partkey").cast("string")
    code = F.when(F.length(key) < 4, F.lpad(key, 4, "0")).otherwise(key)
    return V.table(spark, sf, "part").select(F.when(is_stock_symbol(code), code).alias("symbol")).groupBy(
        "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("turnover_topk", W("bars") + """
SELECT symbol, data_date, turnover FROM bars WHERE turnover >= 20000 ORDER BY turnover DESC, symbol, data_date LIMIT 200""")
def turnover_topk(spark, sf):
    return V.bars(spark, sf).where("turnover >= 20000").orderBy(
        F.col("turnover").desc(), "symbol", "data_date").limit(200).select("symbol", "data_date", "turnover")


@query("trading_today", W("bars") + """
SELECT b.symbol, count(*) AS n FROM bars b WHERE b.symbol IN (SELECT symbol FROM bars WHERE data_date = (SELECT max(data_date) FROM bars))
GROUP BY 1""")
def trading_today(spark, sf):
    b = V.bars(spark, sf)
    today = b.where(F.col("data_date") == reports.latest_date(b)).select("symbol").distinct()
    return b.join(today, "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("version_mismatch", f"""SELECT count(*) AS n FROM orders WHERE
(CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'O' THEN '{version_of(DEFAULTS)}' ELSE 'old' END)
IS DISTINCT FROM '{version_of(DEFAULTS)}'""")
def version_mismatch(spark, sf):
    v = F.when(F.col("o_orderstatus") == "O", version_of(DEFAULTS)).when(F.col("o_orderstatus") != "F", "old")
    return V.table(spark, sf, "orders").withColumn("config_version", v).where(
        ~F.col("config_version").eqNullSafe(F.lit(version_of(DEFAULTS)))).agg(F.count(F.lit(1)).alias("n"))


@query("select_version", """WITH v AS (SELECT o_orderpriority AS config_version, count(*) AS n FROM orders GROUP BY 1),
pick AS (SELECT config_version FROM v ORDER BY (config_version = '9-NONE') DESC, n DESC, config_version DESC LIMIT 1)
SELECT config_version, n FROM v WHERE config_version = (SELECT config_version FROM pick)""")
def select_version(spark, sf):
    from tapeworks.operators import research
    o = V.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "config_version")
    return research.select_version(o, "9-NONE").groupBy("config_version").agg(F.count(F.lit(1)).alias("n"))


@query("liquidity_filter", W("bars") + f"""
SELECT symbol, {R("median(turnover)", 2)} AS median_turnover FROM bars GROUP BY symbol HAVING median(turnover) >= 100000""")
def liquidity_filter(spark, sf):
    return reports.liquid_symbols(V.bars(spark, sf), 100000).select(
        "symbol", rounded(F.col("median_turnover"), 2).alias("median_turnover"))


@query("completeness", W("bars") + """
, d AS (SELECT data_date, 'bars' AS dataset, count(*) AS rows, CAST(60 AS BIGINT) AS required FROM bars GROUP BY 1
 UNION ALL SELECT CAST(date_trunc('week', o_orderdate) AS DATE), 'orders', count(*), CAST(40 AS BIGINT) FROM orders GROUP BY 1)
SELECT data_date, dataset, rows, required, rows >= required AS complete,
 CASE WHEN rows < required THEN dataset || ': ' || rows || ' < ' || required END AS reason FROM d""")
def completeness(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("data_date"))
    return calendar.completeness({"bars": V.bars(spark, sf), "orders": orders}, {"bars": 60, "orders": 40})


@query("features_join_stock", W("stock", "bars") + f"""
SELECT b.symbol, name, industry, data_date, {R("close", 4)} AS close FROM bars b JOIN stock USING (symbol)""")
def features_join_stock(spark, sf):
    return V.bars(spark, sf).join(V.stock(spark, sf), "symbol").select(
        "symbol", "name", "industry", "data_date", rounded(F.col("close"), 4).alias("close"))


@query("signals_left_prices", W("bars", "actions") + f"""
SELECT a.symbol, a.data_date, {R("a.adj_factor", 6)} AS adj_factor, b.volume FROM actions a LEFT JOIN bars b USING (symbol, data_date)""")
def signals_left_prices(spark, sf):
    return V.actions(spark, sf).join(V.bars(spark, sf).select("symbol", "data_date", "volume"), ["symbol", "data_date"], "left").select(
        "symbol", "data_date", rounded(F.col("adj_factor"), 6).alias("adj_factor"), "volume")


@query("missing_days", W("cal") + """
, have AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS data_date FROM orders WHERE o_totalprice > 490000)
SELECT data_date FROM cal WHERE data_date NOT IN (SELECT data_date FROM have)""")
def missing_days(spark, sf):
    src = V.table(spark, sf, "orders").where("o_totalprice > 490000").select(
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("data_date"))
    return calendar.missing_days(V.bars(spark, sf), src)


@query("missing_days_per_market", W("stock", "cal") + """
, src AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS data_date, o_orderstatus AS market FROM orders
  WHERE o_totalprice > 450000)
SELECT data_date, market FROM cal CROSS JOIN (VALUES ('F'), ('O'), ('P')) m(market)
WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.data_date = cal.data_date AND src.market = m.market)""")
def missing_days_per_market(spark, sf):
    src = V.table(spark, sf, "orders").where("o_totalprice > 450000").select(
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("data_date"), F.col("o_orderstatus").alias("market"))
    return calendar.missing_per_label(V.bars(spark, sf), src, "market", ["F", "O", "P"])


@query("asof_join", W("bars", "actions") + f"""
SELECT b.symbol, b.data_date, a.data_date AS asof_date, {R("a.adj_factor", 6)} AS adj_factor
FROM bars b ASOF LEFT JOIN actions a ON b.symbol = a.symbol AND b.data_date >= a.data_date""")
def asof_join(spark, sf):
    out = joins.asof_join(V.bars(spark, sf).select("symbol", "data_date"), V.actions(spark, sf), ["symbol"], ["adj_factor"])
    return out.select("symbol", "data_date", "asof_date", rounded(F.col("adj_factor"), 6).alias("adj_factor"))


@query("asof_join_chunked", W("ticks") + f"""
, q AS (SELECT symbol, ts, price AS quote FROM ticks WHERE side = 1), t AS (SELECT symbol, ts, seq FROM ticks WHERE side = -1)
SELECT t.symbol, t.seq, q.ts AS quote_ts, {R("q.quote", 2)} AS quote FROM t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.ts >= q.ts""")
def asof_join_chunked(spark, sf):
    t = V.ticks(spark, sf)
    quotes = t.where("side = 1").select("symbol", "ts", F.col("price").alias("quote"))
    return joins.asof_join(t.where("side = -1").select("symbol", "ts", "seq"), quotes, ["symbol"], ["quote"], time="ts",
                           cut=True, right_time="quote_ts").select(
        "symbol", "seq", "quote_ts", rounded(F.col("quote"), 2).alias("quote"))


@query("range_join_events", W("bars", "actions") + f"""
SELECT b.symbol, b.data_date, {R("coalesce(product(a.adj_factor), 1)", 8)} AS factor
FROM bars b LEFT JOIN actions a ON a.symbol = b.symbol AND a.data_date > b.data_date AND a.adj_factor > 0 GROUP BY 1, 2""")
def range_join_events(spark, sf):
    return adjust.back_adjust(V.bars(spark, sf).select("symbol", "data_date"), V.actions(spark, sf), []).select(
        "symbol", "data_date", rounded(F.col("price_scale"), 8).alias("factor"))


@query("next_market_day_entry", W("bars", "cal") + f"""
SELECT b.symbol, b.data_date, cal.next_date AS entry_date, {R("e.open", 4)} AS entry_price
FROM bars b JOIN cal USING (data_date) JOIN bars e ON e.symbol = b.symbol AND e.data_date = cal.next_date""")
def next_market_day_entry(spark, sf):
    b = V.bars(spark, sf)
    nxt = calendar.market_calendar(b).select("data_date", F.col("next_date").alias("entry_date"))
    entry = b.select("symbol", F.col("data_date").alias("entry_date"), rounded(F.col("open"), 4).alias("entry_price"))
    return b.select("symbol", "data_date").join(nxt, "data_date").join(entry, ["symbol", "entry_date"]).select(
        "symbol", "data_date", "entry_date", "entry_price")


@query("covered_every_day", W("bars", "cal", "stock") + """
, win AS (SELECT data_date FROM cal ORDER BY data_date DESC LIMIT 60)
SELECT nation, count(DISTINCT data_date) AS days FROM bars JOIN stock USING (symbol) WHERE data_date IN (SELECT data_date FROM win)
GROUP BY 1 HAVING count(DISTINCT data_date) = (SELECT count(*) FROM win)""")
def covered_every_day(spark, sf):
    b = V.bars(spark, sf)
    win = calendar.recent_dates(b, 60)
    return calendar.covered_every_day(b.join(V.stock(spark, sf), "symbol"), win, "nation")


@query("series_assembly", W("bars", "flows") + f"""
SELECT f.symbol, f.data_date, {R("b.close", 4)} AS close, f.foreign_net, f.margin_balance FROM flows f LEFT JOIN bars b USING (symbol, data_date)
WHERE f.data_date >= DATE '1999-01-01'""")
def series_assembly(spark, sf):
    since = "data_date >= DATE '1999-01-01'"
    return V.flows(spark, sf).where(since).join(V.bars(spark, sf).where(since), ["symbol", "data_date"], "left").select(
        "symbol", "data_date", rounded(F.col("close"), 4).alias("close"), "foreign_net", "margin_balance")


@query("market_context_join", W("bars", "idx") + f"""
SELECT b.symbol, b.data_date, {R("close / index_close", 6)} AS relative FROM bars b LEFT JOIN idx USING (data_date)""")
def market_context_join(spark, sf):
    return V.bars(spark, sf).join(V.index(spark, sf), "data_date", "left").select(
        "symbol", "data_date", rounded(F.col("close") / F.col("index_close"), 6).alias("relative"))


@query("row_sequence", """SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, l_extendedprice, CAST(row_number() OVER (
 PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS INT) AS row_seq
 FROM lineitem""")
def row_sequence(spark, sf):
    return joins.occurrence_number(V.table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], [
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], cut=True).select(
        "l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "row_seq")


@query("collapse_duplicates", """SELECT l_orderkey, l_linenumber, count(*) AS duplicate_count, min(l_partkey) AS first_part
FROM lineitem GROUP BY 1, 2""")
def collapse_duplicates(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.collapse_duplicates(li, ["l_orderkey", "l_linenumber"], "l_partkey").select(
        "l_orderkey", "l_linenumber", "duplicate_count", F.col("l_partkey").alias("first_part"))


@query("calendar_union", W("bars") + """
SELECT DISTINCT data_date FROM bars UNION SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) FROM orders""")
def calendar_union(spark, sf):
    o = V.table(spark, sf, "orders").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("data_date"))
    return calendar.market_calendar(V.bars(spark, sf), o).select("data_date")


@query("continuing_names", """SELECT c_custkey AS symbol FROM customer INTERSECT SELECT o_custkey FROM orders""")
def continuing_names(spark, sf):
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol")).intersect(
        V.table(spark, sf, "orders").select(F.col("o_custkey").alias("symbol")))


@query("gaps_after_start", W("cal") + """
, src AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS data_date FROM orders WHERE o_totalprice > 480000 AND o_orderdate >= TIMESTAMP '1996-03-01'),
f AS (SELECT min(data_date) AS first_day FROM src)
SELECT 'orders' AS source, (SELECT count(*) FROM src) AS days, (SELECT min(data_date) FROM src) AS first_date,
 (SELECT max(data_date) FROM src) AS last_date,
 (SELECT count(*) FROM cal, f WHERE cal.data_date >= f.first_day AND cal.data_date NOT IN (SELECT data_date FROM src)) AS missing,
 (SELECT count(*) FROM cal, f WHERE cal.data_date < f.first_day) AS starts_late""")
def gaps_after_start(spark, sf):
    o = V.table(spark, sf, "orders").where("o_totalprice > 480000 AND o_orderdate >= TIMESTAMP '1996-03-01'").select(
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("data_date"))
    return calendar.gaps(calendar.market_calendar(V.bars(spark, sf)), {"orders": o}).drop("missing_dates")


@query("month_spans", W("bars") + """
, m AS (SELECT DISTINCT date_trunc('month', data_date)::DATE AS month FROM bars), b AS (SELECT min(data_date) AS lo, max(data_date) AS hi FROM bars)
SELECT g.month::DATE AS month, greatest(g.month::DATE, lo) AS first_day, least(last_day(g.month::DATE), hi) AS last_day
FROM b, LATERAL (SELECT unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH)) AS month) g""")
def month_spans(spark, sf):
    b = V.bars(spark, sf).agg(F.min("data_date").alias("lo"), F.max("data_date").alias("hi"))
    months = b.select("lo", "hi", F.explode(F.sequence(
        F.trunc("lo", "month"), F.col("hi"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.select("month", F.greatest("month", "lo").alias("first_day"), F.least(F.last_day("month"), F.col("hi")).alias("last_day"))


@query("upsert_columns", """WITH n AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS o_totalprice
 FROM orders WHERE o_orderpriority = '2-HIGH')
SELECT o.o_orderkey, o.o_custkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE o.o_totalprice END AS o_totalprice
FROM orders o LEFT JOIN n USING (o_orderkey)""")
def upsert_columns(spark, sf):
    old = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = V.table(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").select(
        "o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("o_totalprice"))
    return merge.upsert(old, new, ["o_orderkey"], update=["o_totalprice"])


@query("insert_absent", """SELECT o_custkey AS symbol, 'orders' AS origin FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1
UNION ALL SELECT s_suppkey, 'supplier' FROM supplier""")
def insert_absent(spark, sf):
    master = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), F.lit("supplier").alias("origin"))
    seen = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.lit("orders").alias("origin"))
    return merge.insert_absent(master, seen, ["symbol"])


@query("enrich_master", """SELECT c_custkey, coalesce(s_name, c_name) AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def enrich_master(spark, sf):
    master = V.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    facts = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"))
    return merge.enrich(master, facts, ["c_custkey"], ["name"])


@query("merge_owned_columns", W("actions") + f"""
, fc AS (SELECT symbol, data_date, adj_factor + 1 AS adj_factor, 2.0 AS share_factor FROM actions WHERE share_factor IS NULL)
SELECT symbol, data_date, {R("a.adj_factor", 6)} AS adj_factor, {R("coalesce(fc.share_factor, a.share_factor)", 6)} AS share_factor
FROM actions a LEFT JOIN fc USING (symbol, data_date)""")
def merge_owned_columns(spark, sf):
    a = V.actions(spark, sf)
    forecast = a.where("share_factor IS NULL").select(
        "symbol", "data_date", (F.col("adj_factor") + 1).alias("adj_factor"), F.lit(2.0).alias("share_factor"))
    out = merge.merge_owned({"actual": a, "forecast": forecast}, ["symbol", "data_date"],
                            {"adj_factor": ["actual"], "share_factor": ["forecast", "actual"]})
    return out.select("symbol", "data_date", *[rounded(F.col(c), 6).alias(c) for c in ("adj_factor", "share_factor")])


@query("first_observed", """SELECT o_custkey, min(o_orderdate) AS o_orderdate, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status,
 arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price FROM orders GROUP BY 1""")
def first_observed(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("obs", F.struct("o_orderdate", "o_orderkey"))
    out = merge.first_observed(o.select("o_custkey", "obs", "o_orderstatus", "o_totalprice"), ["o_custkey"], "obs", ["o_orderstatus"])
    return out.select("o_custkey", F.col("obs.o_orderdate").alias("o_orderdate"), F.col("o_orderstatus").alias("first_status"),
                      F.col("o_totalprice").alias("last_price"))


@query("clear_derived_factor", W("actions") + f"""
SELECT symbol, data_date, {R("CASE WHEN symbol % 2 = 0 AND abs(share_factor - 1 / adj_factor) < 1e-6 THEN NULL ELSE share_factor END", 6)} AS share_factor FROM actions""")
def clear_derived_factor(spark, sf):
    return merge.clear_derived_factor(V.actions(spark, sf), F.col("symbol") % 2 == 0).select(
        "symbol", "data_date", rounded(F.col("share_factor"), 6).alias("share_factor"))


@query("normalise_spelling", """WITH f AS (SELECT o_custkey, CASE o_orderstatus WHEN 'P' THEN 'O' ELSE o_orderstatus END AS market,
 o_orderstatus <> 'P' AS was_right, o_orderkey FROM orders)
SELECT o_custkey, market, arg_max(o_orderkey, (was_right, o_orderkey)) AS o_orderkey FROM f GROUP BY 1, 2""")
def normalise_spelling(spark, sf):
    o = V.table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("market"), "o_orderkey")
    return merge.normalise_spelling(o, "market", {"P": "O"}, ["o_custkey", "market"], "o_orderkey")


@query("row_hash", """SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, ''),
 CAST(CAST(o_orderdate AS DATE) AS VARCHAR), o_orderpriority)) AS row_hash FROM orders""")
def row_hash_query(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate")).withColumn(
        "s", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return o.select("o_orderkey", row_hash("o_orderkey", "s", "d", "o_orderpriority").alias("row_hash"))


@query("source_priority", W("bars", "actions") + f"""
, fb AS (SELECT symbol, data_date, adj_factor AS close FROM actions)
SELECT symbol, data_date, {R("coalesce(b.close, fb.close)", 4)} AS close FROM bars b FULL JOIN fb USING (symbol, data_date)""")
def source_priority(spark, sf):
    own = V.bars(spark, sf).select("symbol", "data_date", "close")
    fb = V.actions(spark, sf).select("symbol", "data_date", F.col("adj_factor").alias("close"))
    return joins.by_source_priority([own, fb], ["symbol", "data_date"]).select(
        "symbol", "data_date", rounded(F.col("close"), 4).alias("close"))


@query("event_window", W("bars", "actions") + """
, t AS (SELECT symbol, arg_max(data_date, (turnover, data_date)) AS as_of FROM bars GROUP BY 1)
SELECT a.symbol, t.as_of, a.data_date FROM actions a JOIN t USING (symbol) WHERE a.data_date > t.as_of - 45 AND a.data_date <= t.as_of""")
def event_window(spark, sf):
    at = V.bars(spark, sf).groupBy("symbol").agg(F.max_by("data_date", F.struct("turnover", "data_date")).alias("as_of"))
    return reports.event_window(V.actions(spark, sf), at, 45).select("symbol", "as_of", "data_date")


@query("already_available", W("hweek") + """
SELECT symbol, data_date, retail_ratio FROM hweek
WHERE CAST(data_date + 5 AS TIMESTAMP) + INTERVAL 18 HOUR <= TIMESTAMP '1999-06-30 15:00:00'""")
def already_available(spark, sf):
    return V.holders_weekly(spark, sf).where(
        F.col("available_at") <= F.lit("1999-06-30 15:00:00").cast("timestamp")).select("symbol", "data_date", "retail_ratio")


@query("rebuild_dates", W("cal") + "SELECT data_date FROM cal WHERE day_no > 100 AND data_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def rebuild_dates(spark, sf):
    return calendar.market_calendar(V.bars(spark, sf)).where("day_no > 100").where(
        F.col("data_date").between("1997-01-01", "1999-12-31")).select("data_date")


@query("feature_payload", """SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status FROM orders""")
def feature_payload(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct(
        F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))).alias("payload"))
    return o.select("o_orderkey", F.get_json_object("payload", "$.price").try_cast("double").alias("price"),
                    F.get_json_object("payload", "$.status").alias("status"))


@query("json_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events""")
def json_props(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.try_variant_get(
        F.try_parse_json("props"), "$.k", "bigint").alias("k"), "event_type")


@query("percentile_rank_plain", W("bars") + f"""
SELECT symbol, data_date, {R("100 * cume_dist() OVER (PARTITION BY data_date ORDER BY turnover)", 6)} AS pct FROM bars""")
def percentile_rank_plain(spark, sf):
    return order_stats.share_at_or_below(V.bars(spark, sf), ["data_date"], "turnover", "p").select(
        "symbol", "data_date", rounded(F.col("p") * 100, 6).alias("pct"))
