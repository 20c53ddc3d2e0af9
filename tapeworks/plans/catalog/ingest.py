"""Parsing queries: lenient numbers, calendar text, report grids, HTML pages."""
from pyspark.sql import functions as F

from tapeworks.config import DEFAULTS
from tapeworks.functions import dates as dt
from tapeworks.functions.numbers import filing_shares, lenient_double, lenient_long, rounded
from tapeworks.functions.text import method_category, website
from tapeworks.plans import views as V
from tapeworks.plans.catalog.jobs import in_blocks
from tapeworks.plans.catalog.registry import R, query
from tapeworks.sources import reports as rep

WV = V.with_views


@query("lenient_numbers", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {R("o_totalprice", 2)} END AS as_double,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(trunc(o_totalprice) AS BIGINT) END AS as_long FROM orders""")
def lenient_numbers(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "--").otherwise(
        F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" "))).alias("t"))
    return o.select("o_orderkey", rounded(lenient_double("t"), 2).alias("as_double"), lenient_long("t").alias("as_long"))


@query("roc_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS slash, CAST(o_orderdate AS DATE) AS cjk, CASE WHEN year(o_orderdate) >= 2011 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) END AS compact,
 last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders""")
def roc_dates(spark, sf):
    y = (F.year("o_orderdate") - 1911).cast("string")
    y3 = F.lpad(y, 3, "0")
    o = V.table(spark, sf, "orders").select(
        "o_orderkey", F.concat_ws("/", y, F.month("o_orderdate"), F.day("o_orderdate")).alias("s"),
        F.concat(y, F.lit("年"), F.date_format("o_orderdate", "MM"), F.lit("月"), F.date_format("o_orderdate", "dd"), F.lit("日")).alias("c"),
        F.concat(y3, F.date_format("o_orderdate", "MMdd")).alias("k"), F.concat(y3, F.date_format("o_orderdate", "MM")).alias("m"))
    return o.select("o_orderkey", dt.roc_slash("s").alias("slash"), dt.roc_cjk("c").alias("cjk"), dt.roc_compact("k").alias("compact"),
                    dt.roc_month_end("m").alias("month_end"))


#: Supplier keys as codes: the 9,000 four-digit ones dealt round.
_CODE = "CAST(1000 + s % 9000 AS VARCHAR)"


def _code(key: str):
    return (1000 + F.col(key) % 9000).cast("string")


@query("report_grid", f"""WITH p AS (SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS d, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2)
SELECT {_CODE} AS symbol, d AS data_date, CAST(q AS BIGINT) AS volume, {R("q * 1.5::DOUBLE", 2)} AS close, {R("q * 2.25::DOUBLE", 2)} AS turnover
FROM p""")
def report_grid(spark, sf):
    """Daily price reports rebuilt as JSON payloads with all rows of the day, and parsed back by header name.

    The second exchange's reports carry the odd days; there a row without a close is dropped.
    """
    li = V.table(spark, sf, "lineitem")
    per = li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("d")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    row = F.array(F.concat(_code("l_suppkey"), F.lit(" ")), F.lit("n"), F.format_number("q", 0), F.format_number(F.col("q") * 1.5, 2),
                  F.lit("--"), F.format_number(F.col("q") * 2.25, 2))
    untraded = F.array(F.lit("1234"), F.lit("idle"), F.lit("0"), F.lit("---"), F.lit("--"), F.lit("0"))
    out = []
    for market, odd, names in (("TWSE", 0, ("證券代號", "證券名稱", "成交股數", " 收盤價", "開盤價", "成交金額")),
                               ("TPEx", 1, ("代號", "名稱", "成交股數", "收盤", "開盤", "成交金額(元)"))):
        grid = in_blocks(per.where(F.dayofmonth("d") % 2 == odd), ["d"], "l_suppkey").groupBy("d", "block").agg(F.collect_list(row).alias("rows"))
        data = F.concat("rows", F.array(untraded)) if market == "TPEx" else F.col("rows")
        payload = F.to_json(F.struct(F.array(*map(F.lit, names)).alias("fields"), data.alias("data")))
        out.append(rep.prices(grid.select(F.lit("prices").alias("source"), F.col("d").alias("data_date"), payload.alias("payload")), market))
    p = out[0].unionByName(out[1])
    return p.select("symbol", "data_date", "volume", rounded(F.col("close"), 2).alias("close"), rounded(F.col("turnover"), 2).alias("turnover"))


@query("html_rows", """WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1)) AS x, generate_subscripts(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, CAST(pos AS INT) AS pos, trim(regexp_replace(regexp_extract_all(x, '(?s)<a[^>]*>(.*?)</a>', 1)[1], '<[^>]+>', '', 'g')) AS cell FROM r""")
def html_rows(spark, sf):
    """List items of every page as rows: the same extraction the table pages use."""
    h = rep.html_rows(V.table(spark, sf, "pages"), "html", ["page_id"], r"(?s)<li[^>]*>(.*?)</li>", r"(?s)<a[^>]*>(.*?)</a>")
    return h.select("page_id", "pos", F.get("cells", F.lit(0)).alias("cell"))


@query("html_paragraphs", """SELECT page_id, CAST(len(regexp_extract_all(x, '(?s)<p>(.*?)</p>', 1)) AS INT) AS paragraphs
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<article>(.*?)</article>', 1)) AS x FROM pages)""")
def html_paragraphs(spark, sf):
    """Paragraph cells per article of a page."""
    h = rep.html_rows(V.table(spark, sf, "pages"), "html", ["page_id"], r"(?s)<article>(.*?)</article>", r"(?s)<p>(.*?)</p>")
    return h.select("page_id", F.size("cells").alias("paragraphs"))


@query("website_normalised", """SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '^(https?)://([^/?#:]+)', 2)), '^([a-z0-9-]+\\.)+[a-z]{2,}$')
 THEN lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) || regexp_extract(url, '^https?://[^/?#:]+(:[0-9]+)?([^?#]*)', 2) END AS website FROM pages""")
def website_normalised(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", website("url").alias("website"))


@query("method_categories", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'gift' WHEN 1 THEN 'market' WHEN 2 THEN 'market' WHEN 3 THEN 'unknown' WHEN 4 THEN 'private' ELSE 'unknown' END AS category FROM orders""")
def method_categories(spark, sf):
    names = F.array(*[F.lit(x) for x in ("贈與", "一般交易", "鉅額逐筆交易 (每日得轉讓股數限制)", "一般交易及贈與", "洽特定人", "")])
    return V.table(spark, sf, "orders").select("o_orderkey", method_category(F.get(names, (F.col("o_orderkey") % 6).cast("int"))).alias("category"))


@query("filing_share_counts", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS shares FROM orders""")
def filing_share_counts(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "-").when(k == 1, F.format_number("o_totalprice", 2)).otherwise(F.format_number(F.floor("o_totalprice"), 0))
    return V.table(spark, sf, "orders").select("o_orderkey", filing_shares(text).alias("shares"))


@query("distribution_records", f"""WITH g AS (SELECT l_suppkey AS s, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, 1 + l_partkey % 17 AS level, CAST(sum(l_quantity) AS BIGINT) AS h FROM lineitem GROUP BY 1, 2, 3)
SELECT {_CODE} AS symbol, d AS data_date, {", ".join(f"CAST(coalesce(sum(h) FILTER (level BETWEEN {a} AND {b}), 0) AS DOUBLE) AS {n}" for n, a, b in (("retail_ratio", 1, 8), ("medium_ratio", 9, 11), ("large_ratio", 12, 14), ("super_large_ratio", 15, 15)))},
 CAST(max(h) FILTER (level = 17) AS BIGINT) AS holder_count FROM g GROUP BY 1, 2""")
def distribution_records(spark, sf):
    """Holder distribution rebuilt as flat JSON lists (names with a byte-order mark) and parsed back."""
    g = V.table(spark, sf, "lineitem").groupBy(
        "l_suppkey", F.to_date(F.date_trunc("month", "l_shipdate")).alias("d"), (1 + F.col("l_partkey") % 17).alias("level")).agg(
        F.sum("l_quantity").cast("bigint").alias("h"))
    rec = F.create_map(
        F.lit("\ufeff資料日期"), F.date_format("d", "yyyyMMdd"), F.lit("證券代號"), F.concat(_code("l_suppkey"), F.lit("  ")),
        F.lit("持股分級"), F.col("level").cast("string"), F.lit("人數"), F.format_number("h", 0), F.lit("股數"), F.lit("0"),
        F.lit("占集保庫存數比例%"), F.col("h").cast("string"))
    payload = g.groupBy("l_suppkey", "d").agg(F.to_json(F.collect_list(rec)).alias("payload"))
    _, summary = rep.distribution(rep.distribution_records(payload.select("payload")), DEFAULTS["holders"])
    return summary.select("symbol", "data_date", "retail_ratio", "medium_ratio", "large_ratio", "super_large_ratio", "holder_count")


@query("vendor_ticks", """SELECT user_id AS symbol, event_id AS seq, 100 + value AS price, CASE event_id % 3 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS side,
 CASE WHEN event_id % 5 <> 0 THEN value END AS bid_price FROM events""")
def vendor_ticks(spark, sf):
    """Parallel vendor arrays back to trades: deliveries hold trades of a user and day, each in order of arrival."""
    e = V.table(spark, sf, "events")
    trade = F.struct("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"), F.col("value").alias("v"))
    e = in_blocks(e.withColumn("data_date", F.to_date("ts")), ["user_id", "data_date"], "event_id")
    day = e.groupBy("user_id", "data_date", "block").agg(F.sort_array(F.collect_list(trade)).alias("x"))
    arrays = day.select(
        F.col("user_id").alias("symbol"), "data_date", F.col("x.ts").alias("ts"), F.transform("x", lambda t: t["v"] + 100).alias("close"),
        F.col("x.event_id").alias("volume"), F.transform("x", lambda t: F.when(t["event_id"] % 5 != 0, t["v"])).alias("bid_price"),
        F.col("x.v").alias("ask_price"), F.transform("x", lambda t: t["event_id"] % 3).alias("tick_type"))
    t = rep.vendor_ticks(arrays)
    return t.select("symbol", F.col("volume").alias("seq"), "price", "side", "bid_price")


@query("payload_features", """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS absent FROM events""")
def payload_features(spark, sf):
    from tapeworks.plans.models import feature_frame
    return feature_frame(V.table(spark, sf, "events").select("event_id", "props"), "props", ["k", "absent"])


@query("weekdays", """WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders),
d AS (SELECT CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS data_date FROM b)
SELECT data_date FROM d WHERE dayofweek(data_date) NOT IN (0, 6) AND data_date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 400000)""")
def weekdays(spark, sf):
    """Weekdays inside the span of the orders that lack a large order: the list a backfill walks."""
    o = V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("data_date"), "o_totalprice")
    span = o.agg(F.min("data_date").alias("lo"), F.max("data_date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("data_date")).where(~F.dayofweek("data_date").isin(1, 7))
    return days.join(o.where("o_totalprice > 400000").select("data_date").distinct(), "data_date", "left_anti")
