"""Ingest jobs end to end: report payloads with many rows built from the sample tables, and parsed back."""
from pyspark.sql import functions as F

from tapeworks.functions.text import amendment
from tapeworks.plans import views as V
from tapeworks.plans.catalog.registry import R, query
from tapeworks.functions.numbers import rounded
from tapeworks.sources import reports as rep

#: The jobs round factors to 8 digits; both sides are compared at 6.
#: One order is one report line: customer as code, day, and numbers from the keys. The 9,000 four-digit codes are dealt
#: round, so every customer is in the universe; several of them may share a code.
_O = """o AS (SELECT CAST(1000 + o_custkey % 9000 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k, o_custkey AS c,
 o_orderkey % 100000 - 50000 AS a FROM orders)"""
LINES = 5000  # lines of a payload, about


def _orders(spark, sf):
    return V.table(spark, sf, "orders").select(
        (1000 + F.col("o_custkey") % 9000).cast("string").alias("symbol"), F.to_date("o_orderdate").alias("d"),
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 100000 - 50000).alias("a"))


def _number(c, digits=0):
    """A number as reports print it; unknown as a dash."""
    return F.coalesce(F.format_number(c, digits), F.lit("--"))


def _roc(day, sep="/"):
    return F.concat_ws(sep, (F.year(day) - 1911).cast("string"), F.date_format(day, "MM"), F.date_format(day, "dd"))


def in_blocks(rows, by, key):
    """``rows`` with ``block``: a group of ``by`` with many rows is cut into blocks of about LINES, so no payload grows with it."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    return rows.join(counts, by).withColumn("block", F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / LINES))).drop("__n")


def _landed(rows, cells, fields, nested=False, by="d", key="k"):
    """Payloads of a day with all its lines; ``nested`` puts the grid behind an empty table."""
    days = in_blocks(rows, [by], key).groupBy(by, "block").agg(F.collect_list(F.array(*cells)).alias("data"))
    grid = F.struct(F.array(*map(F.lit, fields)).alias("fields"), F.col("data"))
    if nested:
        empty = F.struct(F.array(F.lit("x")).alias("fields"), F.array().cast("array<array<string>>").alias("data"))
        grid = F.struct(F.array(empty, grid).alias("tables"))
    return days.select(F.lit("job").alias("source"), F.col(by).alias("data_date"), F.to_json(grid).alias("payload"))


_INST = """, CASE WHEN k % 7 <> 0 THEN k % 1000 END AS dealer_self_net, -c AS dealer_hedge_net FROM o"""


@query("job_institutional", f"WITH {_O} SELECT symbol, d AS data_date, a + CASE WHEN k % 11 <> 0 THEN c - 700 ELSE 0 END AS foreign_net, c AS trust_net{_INST}")
def job_institutional(spark, sf):
    o = _orders(spark, sf)
    cells = [F.col("symbol"), _number("a"), _number(F.when(F.col("k") % 11 != 0, F.col("c") - 700)), _number("c"), _number(F.when(F.col("k") % 7 != 0, F.col("k") % 1000)), _number(-F.col("c"))]
    names = ["證券代號", "外陸資買賣超股數(不含外資自營商)", "外資自營商買賣超股數", "投信買賣超股數", "自營商買賣超股數(自行買賣)", "自營商買賣超股數(避險)"]
    return rep.institutional(_landed(o, cells, names)).drop("available_at")


@query("job_institutional_second", f"WITH {_O} SELECT symbol, d AS data_date, a AS foreign_net, c AS trust_net{_INST}")
def job_institutional_second(spark, sf):
    at = {0: F.col("symbol"), 10: _number("a"), 13: _number("c"), 16: _number(F.when(F.col("k") % 7 != 0, F.col("k") % 1000)), 19: _number(-F.col("c"))}
    cells = [at.get(i, F.lit("7")) for i in range(24)]
    return rep.institutional(_landed(_orders(spark, sf), cells, ["x"] * 24, nested=True), by_position=True).drop("available_at")


_LOTS = """k % 900 AS margin_buy, k % 800 AS margin_sell, k % 70000 AS margin_balance, CASE WHEN k % 5 <> 0 THEN k % 60 END AS short_sell,
 k % 50 AS short_cover, c AS short_balance"""


def _lots():
    return [_number(F.col("k") % 900), _number(F.col("k") % 800), _number(F.col("k") % 70000), _number(F.when(F.col("k") % 5 != 0, F.col("k") % 60)), _number(F.col("k") % 50), _number("c")]


@query("job_margin", f"WITH {_O} SELECT symbol, d AS data_date, {_LOTS} FROM o")
def job_margin(spark, sf):
    at = dict(zip((2, 3, 6, 9, 10, 12), _lots())) | {0: F.col("symbol")}
    cells = [at.get(i, F.lit("1")) for i in range(16)]
    return rep.margin(_landed(_orders(spark, sf), cells, ["買進"] * 15 + ["資券互抵"], nested=True)).drop("available_at")


@query("job_margin_second", f"WITH {_O} SELECT symbol, d AS data_date, {_LOTS} FROM o")
def job_margin_second(spark, sf):
    names = ["代號", "資買", "資賣", "資餘額", "券賣", "券買", "券餘額"]
    return rep.margin(_landed(_orders(spark, sf), [F.col("symbol"), *_lots()], names, nested=True), by_position=False).drop("available_at")


@query("job_lending", f"WITH {_O} SELECT symbol, d AS data_date, k % 9000 AS sbl_short_sell, CASE WHEN k % 3 <> 0 THEN k % 8000 END AS sbl_return, k AS sbl_balance FROM o")
def job_lending(spark, sf):
    at = {0: F.col("symbol"), 9: _number(F.col("k") % 9000), 10: _number(F.when(F.col("k") % 3 != 0, F.col("k") % 8000)), 12: _number("k")}
    return rep.lending(_landed(_orders(spark, sf), [at.get(i, F.lit("")) for i in range(14)], ["x"] * 14)).drop("available_at")


@query("job_index", f"""SELECT CAST(o_orderdate AS DATE) AS data_date, {R("count(*) * 101.25::DOUBLE", 2)} AS index_close, CAST(sum(o_orderkey) AS DOUBLE) AS turnover FROM orders GROUP BY 1""")
def job_index(spark, sf):
    days = _orders(spark, sf).groupBy("d").agg(F.count("*").alias("n"), F.sum("k").alias("k")).withColumn("m", F.trunc("d", "month"))
    cells = [_roc(F.col("d")), _number("k"), _number(F.col("n") * 101.25, 2)]
    t = rep.index_series(_landed(days, cells, ["日期", "成交金額", "發行量加權股價指數"], by="m"))
    return t.select("data_date", rounded(F.col("index_close"), 2).alias("index_close"), "turnover")


_EX = f"""CASE WHEN k % 13 <> 0 THEN (100 + k % 50)::DOUBLE ELSE 0 END AS prev_close, (100 + k % 50 - 0.5 * (k % 7))::DOUBLE AS reference_price,
 {R(R("CASE WHEN k % 13 <> 0 THEN (100 + k % 50 - 0.5 * (k % 7))::DOUBLE / (100 + k % 50) END", 8), 6)} AS adj_factor"""


def _ex():
    return [_number(F.when(F.col("k") % 13 != 0, 100 + F.col("k") % 50).otherwise(0), 2), _number(100 + F.col("k") % 50 - 0.5 * (F.col("k") % 7), 2)]


@query("job_ex_dividends", f"WITH {_O} SELECT symbol, d + 3 AS data_date, CASE k % 3 WHEN 0 THEN '權' WHEN 1 THEN '息' ELSE '權息' END AS kind, {_EX} FROM o")
def job_ex_dividends(spark, sf):
    kind = F.when(F.col("k") % 3 == 0, "權").when(F.col("k") % 3 == 1, "息").otherwise("權息")
    day = F.concat(F.regexp_replace(F.regexp_replace(_roc(F.date_add("d", 3)), "/", "年"), "年(..)$", "月$1"), F.lit("日"))
    cells = [day, F.col("symbol"), *_ex(), F.lit("1"), kind]
    names = ["資料日期", "股票代號", "除權息前收盤價", "除權息參考價", "權值+息值", "權/息"]
    t = rep.ex_dividends(_landed(_orders(spark, sf), cells, names))
    return t.select("symbol", "data_date", "kind", "prev_close", "reference_price", rounded(F.col("adj_factor"), 6).alias("adj_factor"))


@query("job_ex_dividends_second", f"""WITH {_O} SELECT symbol, d + 3 AS data_date, CASE k % 3 WHEN 0 THEN '權' WHEN 1 THEN '息' ELSE '權息' END AS kind, {_EX},
 {R("1 + (k % 90) / 1000.0::DOUBLE", 6)} AS share_factor FROM o""")
def job_ex_dividends_second(spark, sf):
    kind = F.when(F.col("k") % 3 == 0, "除權").when(F.col("k") % 3 == 1, "除息").otherwise("除權息")
    cells = [_roc(F.date_add("d", 3)), F.col("symbol"), *_ex(), F.lit("1"), kind, _number(F.col("k") % 90)]
    names = ["除權息日期", "代號", "除權息前收盤價", "除權息參考價", "權值+息值", "權/息", "每仟股無償配股"]
    t = rep.ex_dividends(_landed(_orders(spark, sf), cells, names, nested=True), with_free_shares=True)
    return t.select("symbol", "data_date", "kind", "prev_close", "reference_price", rounded(F.col("adj_factor"), 6).alias("adj_factor"),
                    rounded(F.col("share_factor"), 6).alias("share_factor"))


@query("job_rights_forecast", f"""WITH {_O} SELECT symbol, d + 20 AS data_date, CAST(d AS TIMESTAMP) + INTERVAL 15 HOUR AS available_at, '權' AS kind,
 {R("1 + (k % 50) / 400.0::DOUBLE", 6)} AS share_factor FROM o WHERE k % 50 > 0""")
def job_rights_forecast(spark, sf):
    day = F.concat(F.regexp_replace(F.regexp_replace(_roc(F.date_add("d", 20)), "/", "年"), "年(..)$", "月$1"), F.lit("日"))
    cells = [day, F.col("symbol"), F.lit("權"), ((F.col("k") % 50) / 400.0).cast("string")]
    t = rep.rights_forecast(_landed(_orders(spark, sf), cells, ["除權除息日期", "股票代號", "除權息", "無償配股率"]))
    return t.select("symbol", "data_date", "available_at", "kind", rounded(F.col("share_factor"), 6).alias("share_factor"))


@query("job_resumptions", f"""WITH {_O} SELECT symbol, d + 9 AS data_date, (100 + k % 50)::DOUBLE AS prev_close, (40 + k % 30)::DOUBLE AS reference_price,
 {R(R("(40 + k % 30)::DOUBLE / (100 + k % 50)", 8), 6)} AS adj_factor, {R(R("CASE WHEN k % 4 <> 0 THEN (100 + k % 50)::DOUBLE / (40 + k % 30) END", 8), 6)} AS share_factor FROM o""")
def job_resumptions(spark, sf):
    cells = [_roc(F.date_add("d", 9)), F.col("symbol"), _number(100 + F.col("k") % 50, 2), _number(40 + F.col("k") % 30, 2), F.when(F.col("k") % 4 == 0, "退還股款").otherwise("彌補虧損")]
    names = ["恢復買賣日期", "股票代號", "停止買賣前收盤價格", "恢復買賣參考價", "減資原因"]
    t = rep.resumptions(_landed(_orders(spark, sf), cells, names), "減資")
    return t.select("symbol", "data_date", "prev_close", "reference_price", rounded(F.col("adj_factor"), 6).alias("adj_factor"),
                    rounded(F.col("share_factor"), 6).alias("share_factor"))


@query("job_resumptions_second", f"""WITH {_O} SELECT symbol, d + 9 AS data_date, {R(R("(40 + k % 30)::DOUBLE / (100 + k % 50)", 8), 6)} AS adj_factor,
 {R(R("CASE k % 3 WHEN 0 THEN (1 + k % 9)::DOUBLE WHEN 1 THEN (500 + k % 400) / 1000.0::DOUBLE ELSE (100 + k % 50)::DOUBLE / (40 + k % 30) END", 8), 6)} AS share_factor FROM o""")
def job_resumptions_second(spark, sf):
    row = lambda label, v: F.concat(F.lit(f"<table><tr><th>{label}：</th> <td> "), v.cast("string"), F.lit("</td></tr></table>"))
    detail = (F.when(F.col("k") % 3 == 0, row("變更股票面額換股率", 1 + F.col("k") % 9)).when(F.col("k") % 3 == 1, row("每壹仟股換發新股票", 500 + F.col("k") % 400)).otherwise(""))
    compact = F.regexp_replace(_roc(F.date_add("d", 9)), "/", "")
    cells = [F.lpad(compact, 7, "0"), F.col("symbol"), _number(100 + F.col("k") % 50, 2), _number(40 + F.col("k") % 30, 2), detail]
    names = ["恢復買賣日期", "股票代號", "最後交易日之收盤價格", "減資恢復買賣開始日參考價格", "詳細資料"]
    t = rep.resumptions(_landed(_orders(spark, sf), cells, names, nested=True), "減資", True)
    return t.select("symbol", "data_date", rounded(F.col("adj_factor"), 6).alias("adj_factor"), rounded(F.col("share_factor"), 6).alias("share_factor"))


@query("job_reduction_forecast", f"""WITH {_O} SELECT symbol, d + 9 AS data_date, CAST(d AS TIMESTAMP) + INTERVAL 15 HOUR AS available_at, {R("(k % 100) / 100.0::DOUBLE", 6)} AS share_factor
FROM o WHERE k % 100 > 0""")
def job_reduction_forecast(spark, sf):
    cells = [_roc(F.date_add("d", 9)), F.col("symbol"), _number((F.col("k") % 100) / 100.0, 2)]
    t = rep.reduction_forecast(_landed(_orders(spark, sf), cells, ["恢復買賣日期", "股票代號", "減資換股率"]))
    return t.select("symbol", "data_date", "available_at", rounded(F.col("share_factor"), 6).alias("share_factor"))


@query("job_futures", f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'TX' ELSE 'TE' END AS contract, strftime(o_orderdate, '%Y%m') AS contract_month, CAST(o_orderdate AS DATE) AS data_date,
 (o_orderkey % 500)::DOUBLE AS open, (o_orderkey % 900)::DOUBLE AS close, {R("(o_orderkey % 40) / 1000.0::DOUBLE", 5)} AS change_pct, o_orderkey AS volume,
 CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 77 END AS open_interest FROM orders WHERE o_orderkey % 5 < 3 AND o_orderkey % 6 <> 0""")
def job_futures(spark, sf):
    k = F.col("o_orderkey")
    o = V.table(spark, sf, "orders")
    month = F.date_format("o_orderdate", "yyyyMM")
    raw = o.select(
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("交易日期"), F.when(k % 3 == 0, "  ").otherwise("TE").alias("契約"),
        F.when(k % 5 == 3, F.concat(month, F.lit("/"), month)).when(k % 5 == 4, "").otherwise(month).alias("到期月份(週別)"),
        _number(k % 500).alias("開盤價"), F.lit("-").alias("最高價"), F.lit("1").alias("最低價"), F.when(k % 6 == 0, "-").otherwise(_number(k % 900)).alias("收盤價"),
        F.lit("0").alias("漲跌價"), F.concat(((k % 40) / 10.0).cast("string"), F.lit("%")).alias("漲跌%"), _number(k).alias("成交量"), F.lit("-").alias("結算價"),
        F.when(k % 4 == 0, "-").otherwise((k % 77).cast("string")).alias("未沖銷契約數"), F.lit("一般").alias("交易時段"))
    night = raw.withColumn("交易時段", F.lit("盤後"))
    t = rep.futures(raw.unionByName(night))
    return t.select("contract", "contract_month", "data_date", "open", "close", rounded(F.col("change_pct"), 5).alias("change_pct"), "volume", "open_interest")


@query("job_profiles", """SELECT CAST(1000 + s_suppkey % 9000 AS VARCHAR) AS symbol, CASE s_suppkey % 4 WHEN 0 THEN '半導體' WHEN 1 THEN '水泥' WHEN 2 THEN '98' END AS industry,
 CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 1000 END AS shares_outstanding, CASE WHEN s_suppkey % 3 <> 0 THEN 'https://www.s' || s_suppkey || '.com/A' END AS website
FROM supplier""")
def job_profiles(spark, sf):
    k = F.col("s_suppkey")
    code = F.when(k % 4 == 0, "24").when(k % 4 == 1, "1").when(k % 4 == 2, "98").otherwise("")
    web = F.when(k % 3 == 0, "-").otherwise(F.concat(F.lit(" WWW.S"), k.cast("string"), F.lit(".com:80/A?x=1")))
    shares = F.when(k % 5 == 0, "x").otherwise(F.format_number(k * 1000, 0))
    symbol = F.concat((1000 + k % 9000).cast("string"), F.lit(" "))
    rec = lambda names: F.create_map(F.lit(names[0]), symbol, F.lit(names[1]), code, F.lit(names[2]), shares, F.lit(names[3]), web)
    first = rec(["公司代號", "產業別", "已發行普通股數或TDR原股發行股數", "網址"])
    second = rec(["SecuritiesCompanyCode", "SecuritiesIndustryCode", "IssueShares", "WebAddress"])
    suppliers = in_blocks(V.table(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey")
    lists = suppliers.groupBy("s_nationkey", "block").agg(F.to_json(F.collect_list(F.when(k % 2 == 0, first).otherwise(second))).alias("payload"))
    t = rep.profiles(lists.select("payload"))
    return t.select("symbol", F.nullif("industry", F.lit("")).alias("industry"), "shares_outstanding", "website")


@query("job_quotes", """SELECT user_id AS symbol, date_trunc('second', ts) AS ts, CASE WHEN event_id % 4 <> 0 THEN value ELSE value + 1 END AS open, value + 1 AS close,
 CASE WHEN event_id % 5 <> 0 THEN event_id ELSE 0 END AS volume FROM events WHERE event_id % 6 <> 0""")
def job_quotes(spark, sf):
    """Quotes of a user in answers of parallel arrays."""
    e = V.table(spark, sf, "events").select("user_id", "event_id", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    day = in_blocks(e, ["user_id"], "event_id").groupBy("user_id", "block").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", "value"))).alias("x"))
    each = lambda f: F.transform("x", f)
    quote = F.struct(
        each(lambda x: F.when(x["event_id"] % 4 != 0, x["value"])).alias("open"), each(lambda x: F.lit(None).cast("double")).alias("high"),
        F.col("x.value").alias("low"), each(lambda x: F.when(x["event_id"] % 6 != 0, x["value"] + 1)).alias("close"),
        each(lambda x: F.when(x["event_id"] % 5 != 0, x["event_id"])).alias("volume"))
    answer = F.struct(F.struct(F.array(F.struct(F.col("x.t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result")).alias("chart"))
    t = rep.quote_chart(day.select(F.col("user_id").cast("string").alias("source"), F.to_json(answer).alias("payload")))
    return t.select(F.col("source").cast("bigint").alias("symbol"), "ts", "open", "close", "volume")


@query("amendment_notes", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS amends,
 CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderdate AS DATE) + 3 END AS superseded, o_orderkey % 4 < 3 AS has_note FROM orders""")
def amendment_notes(spark, sf):
    k = F.col("o_orderkey")
    note = (F.when(k % 4 == 0, F.concat(F.lit("本單為變更 "), _roc(F.col("o_orderdate")), F.lit(" 之申報")))
            .when(k % 4 == 1, F.concat(F.lit("本單已於"), _roc(F.date_add("o_orderdate", 3)), F.lit("變更")))
            .when(k % 4 == 2, F.lit("other words")).otherwise(F.lit("  ")))
    a = amendment(note)
    return V.table(spark, sf, "orders").select("o_orderkey", a["amends"].alias("amends"), a["superseded"].alias("superseded"), a["note"].isNotNull().alias("has_note"))
