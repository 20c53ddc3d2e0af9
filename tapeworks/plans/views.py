"""The market tables derived from the driver's business tables, and the same views as SQL text.

One weekly bar per supplier and ship week stands for a daily bar; events are trades. Everything is
computed from the given tables, so work grows with them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HORIZON_DAYS = 7


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stock(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.col("r_name").alias("market"),
        F.col("r_name").alias("industry"), F.col("n_name").alias("nation"))


def _week(c: str) -> Column:
    return F.to_date(F.date_trunc("week", c))


def _money(c: Column) -> Column:
    """Exact sums whatever the partitioning: two decimals are all the data has."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, data_date, open, high, low, close, volume, turnover. One partial aggregate by (symbol, week)."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), _week("l_shipdate").alias("data_date"), "l_shipdate", "l_orderkey",
        "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "p")
    return li.groupBy("symbol", "data_date").agg(
        F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", at).alias("close"), _money(F.col("l_quantity")).alias("volume"),
        _money(F.col("l_extendedprice")).alias("turnover"))


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Net flows and balances by (symbol, week); a balance is NULL in weeks without its kind of row."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), _week("l_shipdate").alias("data_date"), "l_returnflag", "l_linestatus",
        "l_discount", F.col("l_quantity").cast("bigint").alias("q"))
    q, flag, status = F.col("q"), F.col("l_returnflag"), F.col("l_linestatus")
    parity = F.when(F.round(F.col("l_discount") * 100).cast("int") % 2 == 0, q).otherwise(-q)
    return li.groupBy("symbol", "data_date").agg(
        F.sum(F.when(flag == "R", q).when(flag == "A", -q).otherwise(0)).alias("foreign_net"),
        F.sum(F.when(status == "O", q).otherwise(-q)).alias("trust_net"),
        F.sum(parity).alias("dealer_self_net"),
        F.sum(F.when(flag == "N", q)).alias("dealer_hedge_net"),
        F.sum(F.when(flag == "N", q)).alias("margin_balance"),
        F.sum(F.when(flag == "A", q)).alias("short_balance"),
        F.sum(F.when(status == "F", q)).alias("sbl_balance"))


def n_symbols(spark: SparkSession, sf: str) -> Column:
    return table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders as corporate actions: one per (symbol, week), the one with the highest order key."""
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        (F.col("o_custkey") % n_symbols(spark, sf)).alias("symbol"), _week("o_orderdate").alias("data_date"),
        "o_orderkey", (1 - (F.floor("o_totalprice") % 1000) / 20000.0).alias("adj_factor"))
    agg = o.groupBy("symbol", "data_date").agg(
        F.max_by("adj_factor", "o_orderkey").alias("adj_factor"), F.max("o_orderkey").alias("_k"))
    return agg.select("symbol", "data_date", "adj_factor", F.when(
        F.col("_k") % 3 == 0, 1 / F.col("adj_factor")).alias("share_factor"))


def index(spark: SparkSession, sf: str, stored: DataFrame | None = None) -> DataFrame:
    """Turnover-weighted price of the whole market per week; from ``stored`` bars if they are there already."""
    return (bars(spark, sf) if stored is None else stored).groupBy("data_date").agg(
        (_money(F.col("turnover")) / _money(F.col("volume"))).alias("index_close"))


def n_tick_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """How many symbols the events are traded under: it grows with the users, about fifteen of them to a symbol."""
    return table(spark, sf, "events").agg(F.greatest(F.lit(10), 1 + F.floor(F.max("user_id") / 15)).alias("n"))


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as trades."""
    return tick_columns(table(spark, sf, "events"), n_tick_symbols(spark, sf).scalar())


def tick_columns(e: DataFrame, symbols: Column) -> DataFrame:
    price = F.round(F.col("value") + 100, 2)
    wide = (F.col("event_id") % 4) != 0
    return e.select(
        (F.col("user_id") % symbols).alias("symbol"), F.to_date("ts").alias("data_date"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), price.alias("price"), (1 + F.col("event_id") % 50).cast("bigint").alias("volume"),
        F.when(wide, price - 0.01 * (F.col("event_id") % 3)).alias("bid_price"),
        F.when(wide, price + 0.01 * (F.col("event_id") % 5)).alias("ask_price"),
        F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1)
        .otherwise(0).alias("side"))


def holder_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as holder-distribution records: level 1..17, holders, ratio."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), _week("l_shipdate").alias("data_date"),
        (1 + F.col("l_partkey") % 17).cast("int").alias("level"), F.col("l_quantity").cast("bigint").alias("holder_count"),
        F.col("l_discount").cast("decimal(10,2)").alias("ratio"))


def holders_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly holder summary: small, middle and big line items as shares of the week's quantity."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), _week("l_shipdate").alias("data_date"), F.col("l_quantity").alias("q"))
    q = F.col("q")

    def share(cond: Column) -> Column:
        return F.round(100.0 * _money(F.when(cond, q).otherwise(0.0)) / _money(q), 6)

    agg = li.groupBy("symbol", "data_date").agg(
        share(q <= 15).alias("retail_ratio"), share((q > 15) & (q <= 30)).alias("medium_ratio"),
        share((q > 30) & (q <= 45)).alias("large_ratio"), share(q > 45).alias("super_large_ratio"),
        F.count(F.lit(1)).alias("holder_count"))
    return agg.withColumn("available_at", F.date_add("data_date", 5).cast("timestamp") + F.expr("INTERVAL 18 HOURS"))


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as insider holdings: seven named holders per symbol, two sources, several report dates."""
    k, n = F.col("o_orderkey"), n_symbols(spark, sf)
    month = F.last_day("o_orderdate")
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % n).alias("symbol"), month.alias("data_date"),
        F.when(k % 2 == 0, "openapi").otherwise("mops_web").alias("source"),
        F.date_add(month, (10 + (k % 3) * 5).cast("int")).alias("report_date"),
        F.date_add(month, (21 + (k % 3) * 5).cast("int")).cast("timestamp").alias("available_at"),
        F.when(k % 5 == 0, "大股東").otherwise("董事").alias("title"), F.concat(F.lit("H"), (k % 7).cast("string")).alias("holder_name"),
        F.when(k % 11 != 0, F.floor("o_totalprice").cast("bigint")).alias("current_shares"),
        F.when(k % 13 != 0, F.floor(F.col("o_totalprice") / 10).cast("bigint")).alias("pledged_shares"),
        F.when(k % 3 == 0, "forward").when(k % 3 == 1, "backfill").alias("ingestion_mode"), k.alias("row_seq"))


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as transfer declarations; part of them amend a filing 28 days earlier."""
    k, n = F.col("o_orderkey"), n_symbols(spark, sf)
    day = F.to_date("o_orderdate")
    own = F.floor(F.col("o_totalprice") / 100).cast("bigint")
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % n).alias("symbol"), day.alias("data_date"), F.lpad(k.cast("string"), 12, "0").alias("row_hash"),
        (F.date_add(day, 1).cast("timestamp") + F.expr("INTERVAL 8 HOURS")).alias("available_at"),
        F.col("o_orderstatus").alias("reporter_role"), F.concat(F.lit("P"), (k % 2).cast("string")).alias("reporter_name"),
        F.when(k % 4 == 0, "gift").otherwise("market").alias("method_category"),
        F.when(k % 17 != 0, own).alias("planned_own_shares"), F.lit(0).cast("bigint").alias("planned_trust_shares"),
        F.when(k % 9 == 0, own).when(k % 101 == 0, own + 1).alias("transfer_shares"),
        F.when(k % 6 == 0, F.date_sub(day, 28)).alias("amends_report_date"),
        F.when(k % 10 == 3, F.date_add(day, 3)).alias("superseded_on"),
        F.when(k % 3 == 0, "forward").otherwise("backfill").alias("ingestion_mode"))


# --- the same views for the SQL side -------------------------------------------------------------

SQL: dict[str, str] = {
    "stock": """stock AS (SELECT s_suppkey AS symbol, s_name AS name, r_name AS market, r_name AS industry,
  n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "bars": """bars AS (SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS data_date,
  first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS close,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS turnover FROM lineitem GROUP BY 1, 2)""",
    "flows": """flows AS (SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS data_date,
  CAST(sum(CASE l_returnflag WHEN 'R' THEN l_quantity WHEN 'A' THEN -l_quantity ELSE 0 END) AS BIGINT) AS foreign_net,
  CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END) AS BIGINT) AS trust_net,
  CAST(sum(CASE WHEN CAST(round(l_discount * 100) AS INT) % 2 = 0 THEN l_quantity ELSE -l_quantity END) AS BIGINT) AS dealer_self_net,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS BIGINT) AS dealer_hedge_net,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS BIGINT) AS margin_balance,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS BIGINT) AS short_balance,
  CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS BIGINT) AS sbl_balance FROM lineitem GROUP BY 1, 2)""",
    "actions": """actions AS (SELECT symbol, data_date, adj_factor, CASE WHEN k % 3 = 0 THEN 1 / adj_factor END AS share_factor
  FROM (SELECT o_custkey % (SELECT count(*) FROM supplier) AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS data_date,
    arg_max(1 - (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 20000.0::DOUBLE, o_orderkey) AS adj_factor, max(o_orderkey) AS k
    FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2))""",
    "idx": """idx AS (SELECT data_date, CAST(sum(CAST(turnover AS DECIMAL(18,2))) AS DOUBLE)
  / CAST(sum(CAST(volume AS DECIMAL(18,2))) AS DOUBLE) AS index_close FROM bars GROUP BY 1)""",
    "ticks": """ticks AS (SELECT user_id % (SELECT greatest(10, 1 + max(user_id) // 15) FROM events) AS symbol, CAST(ts AS DATE) AS data_date, ts, event_id AS seq,
  round(value + 100, 2) AS price, 1 + event_id % 50 AS volume,
  CASE WHEN event_id % 4 <> 0 THEN round(value + 100, 2) - 0.01::DOUBLE * (event_id % 3) END AS bid_price,
  CASE WHEN event_id % 4 <> 0 THEN round(value + 100, 2) + 0.01::DOUBLE * (event_id % 5) END AS ask_price,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS side FROM events)""",
    "cal": """cal AS (SELECT data_date, CAST(row_number() OVER (ORDER BY data_date) AS BIGINT) AS day_no,
  lead(data_date) OVER (ORDER BY data_date) AS next_date FROM (SELECT DISTINCT data_date FROM bars))""",
    "levels": """levels AS (SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS data_date,
  CAST(1 + l_partkey % 17 AS INT) AS level, CAST(l_quantity AS BIGINT) AS holder_count,
  CAST(l_discount AS DECIMAL(10,2)) AS ratio FROM lineitem)""",
    "hweek": """hweek AS (SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS data_date,
  round(100.0::DOUBLE * sum(CASE WHEN l_quantity <= 15 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS retail_ratio,
  round(100.0::DOUBLE * sum(CASE WHEN l_quantity > 30 AND l_quantity <= 45 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS large_ratio,
  round(100.0::DOUBLE * sum(CASE WHEN l_quantity > 45 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS super_large_ratio,
  count(*) AS holder_count FROM lineitem GROUP BY 1, 2)""",
    "holdings": """holdings AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS symbol, last_day(CAST(o_orderdate AS DATE)) AS data_date,
  CASE WHEN o_orderkey % 2 = 0 THEN 'openapi' ELSE 'mops_web' END AS source,
  last_day(CAST(o_orderdate AS DATE)) + CAST(10 + (o_orderkey % 3) * 5 AS INT) AS report_date,
  CAST(last_day(CAST(o_orderdate AS DATE)) + CAST(21 + (o_orderkey % 3) * 5 AS INT) AS TIMESTAMP) AS available_at,
  CASE WHEN o_orderkey % 5 = 0 THEN '大股東' ELSE '董事' END AS title, 'H' || (o_orderkey % 7) AS holder_name,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS current_shares,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice / 10) AS BIGINT) END AS pledged_shares,
  CASE o_orderkey % 3 WHEN 0 THEN 'forward' WHEN 1 THEN 'backfill' END AS ingestion_mode FROM orders)""",
    "declarations": """declarations AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS symbol, CAST(o_orderdate AS DATE) AS data_date,
  lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS row_hash,
  CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP) + INTERVAL 8 HOUR AS available_at,
  o_orderstatus AS reporter_role, 'P' || (o_orderkey % 2) AS reporter_name,
  CASE WHEN o_orderkey % 4 = 0 THEN 'gift' ELSE 'market' END AS method_category,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice / 100) AS BIGINT) END AS planned_own_shares,
  CAST(0 AS BIGINT) AS planned_trust_shares,
  CASE WHEN o_orderkey % 9 = 0 THEN CAST(floor(o_totalprice / 100) AS BIGINT)
    WHEN o_orderkey % 101 = 0 THEN CAST(floor(o_totalprice / 100) AS BIGINT) + 1 END AS transfer_shares,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) - 28 END AS amends_report_date,
  CASE WHEN o_orderkey % 10 = 3 THEN CAST(o_orderdate AS DATE) + 3 END AS superseded_on,
  CASE WHEN o_orderkey % 3 = 0 THEN 'forward' ELSE 'backfill' END AS ingestion_mode FROM orders)""",
}

_NEEDS = {"idx": ["bars"], "cal": ["bars"]}


def with_views(*names: str) -> str:
    """``WITH`` clause holding the named views and whatever they need, in order."""
    order: list[str] = []
    for n in names:
        for dep in [*_NEEDS.get(n, []), n]:
            if dep not in order:
                order.append(dep)
    return "WITH " + ",\n".join(SQL[n] for n in order)
