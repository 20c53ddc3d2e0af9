"""Exchange reports to rows: JSON tables located by header, CSV, HTML tables, holder distribution.

Input is the landing table (source, data_date, payload). Every job is ``from_json`` and ``explode``
plus column expressions, so files are parsed where they lie and nothing passes the driver.
"""
from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.functions import dates as dt
from tapeworks.functions.numbers import filing_shares, lenient_double, lenient_long, percent_fraction
from tapeworks.functions.text import cell, cell_at, header_pos, is_stock_symbol, website

_GRID = "fields array<string>, data array<array<string>>"
REPORT = f"struct<{_GRID}, tables:array<struct<fields:array<string>,data:array<array<string>>>>>"

# Industry codes of public company profiles.
INDUSTRIES = {
    "01": "水泥", "02": "食品", "03": "塑膠", "04": "紡織纖維", "05": "電機機械", "06": "電器電纜",
    "08": "玻璃陶瓷", "09": "造紙", "10": "鋼鐵", "11": "橡膠", "12": "汽車", "14": "建材營造",
    "15": "航運", "16": "觀光餐旅", "17": "金融保險", "18": "貿易百貨", "19": "綜合", "20": "其他",
    "21": "化學工業", "22": "生技醫療", "23": "油電燃氣", "24": "半導體", "25": "電腦及週邊",
    "26": "光電", "27": "通信網路", "28": "電子零組件", "29": "電子通路", "30": "資訊服務",
    "31": "其他電子", "32": "文化創意", "33": "農業科技", "34": "電子商務", "35": "綠能環保",
    "36": "數位雲端", "37": "運動休閒", "38": "居家生活", "80": "管理股票",
}
# Event kinds as the second exchange spells them.
EX_KINDS = {"除權": "權", "除息": "息", "除權息": "權息"}
CASH_RETURN = "退還股款"
REDUCTION = "減資"
# Labels of the detail table of a resumption.
PAR_RATIO = "變更股票面額換股率"
REDUCED_SHARES = "每壹仟股換發新股票"
REGULAR_SESSION = "一般"
# Upper share bound of the holder levels 1..14; level 15 has none.
LEVEL_BOUNDS = {1: 999, 2: 5000, 3: 10000, 4: 15000, 5: 20000, 6: 30000, 7: 40000, 8: 50000,
                9: 100000, 10: 200000, 11: 400000, 12: 600000, 13: 800000, 14: 1000000}


def _literal_map(values: Mapping[Any, Any]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def grid_rows(landing: DataFrame, need: tuple[str, ...] = ()) -> DataFrame:
    """One row per report line: (source, data_date, fields, row, pos).

    The grid is the payload itself or the first of its tables that has data and the needed headers.
    """
    schema = ("fields array<string>, data array<array<string>>, "
              "tables array<struct<fields:array<string>,data:array<array<string>>>>")
    parsed = landing.withColumn("_j", F.from_json("payload", schema))

    def fits(t: Column) -> Column:
        ok = F.size(t["data"]) > 0
        for name in need:
            ok = ok & F.array_contains(F.transform(t["fields"], lambda x: F.trim(x)), name)
        return ok

    table = F.get(F.filter("_j.tables", fits), F.lit(0))
    return parsed.select(
        "source", "data_date", F.coalesce("_j.fields", table["fields"]).alias("fields"),
        F.posexplode(F.coalesce("_j.data", table["data"])).alias("pos", "row"))


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("available_at", dt.available_daily("data_date"))


def prices(landing: DataFrame, market: str) -> DataFrame:
    """Stock and price rows of either exchange. The second one lists untraded names without a close:
    they are dropped there and kept by the first."""
    g = grid_rows(landing)
    f, r = F.col("fields"), F.col("row")
    out = g.select(
        F.trim(cell(r, f, "證券代號", "代號")).alias("symbol"), F.trim(cell(r, f, "證券名稱", "名稱")).alias("name"),
        F.lit(market).alias("market"), "data_date",
        lenient_double(cell(r, f, "開盤價", "開盤")).alias("open"), lenient_double(cell(r, f, "最高價", "最高")).alias("high"),
        lenient_double(cell(r, f, "最低價", "最低")).alias("low"), lenient_double(cell(r, f, "收盤價", "收盤")).alias("close"),
        lenient_long(cell(r, f, "成交股數")).alias("volume"),
        lenient_double(cell(r, f, "成交金額(元)", "成交金額")).alias("turnover")).where(is_stock_symbol("symbol"))
    return _stamped(out.where("close IS NOT NULL") if market == "TPEx" else out)


def institutional(landing: DataFrame, by_position: bool = False) -> DataFrame:
    """Net flows in shares; foreign includes foreign dealers."""
    g = grid_rows(landing)
    f, r = F.col("fields"), F.col("row")
    if by_position:
        g = g.where(F.size(r) > 19)
        cols = [lenient_long(cell_at(r, i)).alias(n) for i, n in (
            (10, "foreign_net"), (13, "trust_net"), (16, "dealer_self_net"), (19, "dealer_hedge_net"))]
        symbol = cell_at(r, 0)
    else:
        zero = F.lit(0).cast("bigint")
        foreign = F.coalesce(lenient_long(cell(r, f, "外陸資買賣超股數(不含外資自營商)", "外資買賣超股數")), zero)
        cols = [
            (foreign + F.coalesce(lenient_long(cell(r, f, "外資自營商買賣超股數")), zero)).alias("foreign_net"),
            lenient_long(cell(r, f, "投信買賣超股數")).alias("trust_net"),
            lenient_long(cell(r, f, "自營商買賣超股數(自行買賣)")).alias("dealer_self_net"),
            lenient_long(cell(r, f, "自營商買賣超股數(避險)")).alias("dealer_hedge_net")]
        symbol = cell(r, f, "證券代號")
    return _stamped(g.select(F.trim(symbol).alias("symbol"), "data_date", *cols).where(is_stock_symbol("symbol")))


def margin(landing: DataFrame, by_position: bool = True) -> DataFrame:
    """Margin and short balances in lots; the first exchange repeats its headers, so by position."""
    g = grid_rows(landing, ("資券互抵",) if by_position else ())
    f, r = F.col("fields"), F.col("row")
    names = ["margin_buy", "margin_sell", "margin_balance", "short_sell", "short_cover", "short_balance"]
    if by_position:
        cells = [cell_at(r, i) for i in (2, 3, 6, 9, 10, 12)]
        symbol = cell_at(r, 0)
    else:
        cells = [cell(r, f, n) for n in ("資買", "資賣", "資餘額", "券賣", "券買", "券餘額")]
        symbol = cell(r, f, "代號")
    return _stamped(g.select(F.trim(symbol).alias("symbol"), "data_date", *[
        lenient_long(c).alias(n) for c, n in zip(cells, names)]).where(is_stock_symbol("symbol")))


def lending(landing: DataFrame) -> DataFrame:
    r = F.col("row")
    g = grid_rows(landing).where(F.size(r) > 12)
    return _stamped(g.select(F.trim(cell_at(r, 0)).alias("symbol"), "data_date", *[
        lenient_long(cell_at(r, i)).alias(n) for i, n in (
            (9, "sbl_short_sell"), (10, "sbl_return"), (12, "sbl_balance"))]).where(is_stock_symbol("symbol")))


def index_series(landing: DataFrame) -> DataFrame:
    f, r = F.col("fields"), F.col("row")
    out = grid_rows(landing).select(
        dt.roc_slash(cell(r, f, "日期")).alias("data_date"),
        lenient_double(cell(r, f, "發行量加權股價指數")).alias("index_close"),
        lenient_double(cell(r, f, "成交金額")).alias("turnover"))
    return _stamped(out.where("data_date IS NOT NULL"))


def _factor(ref: Column, prev: Column) -> Column:
    return F.when(prev > 0, F.round(F.try_divide(ref, prev), 8))


def ex_dividends(landing: DataFrame, with_free_shares: bool = False) -> DataFrame:
    """Ex-dividend and ex-rights events: adj_factor = reference / previous close.

    Only the second exchange states free shares here; for the first the share factor has another
    owner (the forecast), so the column is left out and a merge cannot overwrite it.
    """
    f, r = F.col("fields"), F.col("row")
    g = grid_rows(landing)
    date = dt.roc_slash(cell(r, f, "除權息日期")) if with_free_shares else dt.roc_cjk(cell(r, f, "資料日期"))
    symbol = cell(r, f, "代號") if with_free_shares else cell(r, f, "股票代號")
    kind = F.trim(cell(r, f, "權/息"))
    prev, ref = lenient_double(cell(r, f, "除權息前收盤價")), lenient_double(cell(r, f, "除權息參考價"))
    cols = [
        F.trim(symbol).alias("symbol"), date.alias("data_date"),
        F.coalesce(F.try_element_at(_literal_map(EX_KINDS), kind), kind, F.lit("")).alias("kind"),
        prev.alias("prev_close"), ref.alias("reference_price"),
        lenient_double(cell(r, f, "權值+息值")).alias("value"), _factor(ref, prev).alias("adj_factor")]
    if with_free_shares:
        cols.append(F.round(1 + lenient_double(cell(r, f, "每仟股無償配股")) / 1000, 8).alias("share_factor"))
    return _stamped(g.select(*cols).where(is_stock_symbol("symbol") & F.col("data_date").isNotNull()))


def rights_forecast(landing: DataFrame) -> DataFrame:
    """Free-share rate ahead of the event: share_factor only, usable from the landing date."""
    f, r = F.col("fields"), F.col("row")
    free = lenient_double(cell(r, f, "無償配股率"))
    return grid_rows(landing).select(
        F.trim(cell(r, f, "股票代號")).alias("symbol"), dt.roc_cjk(cell(r, f, "除權除息日期")).alias("ex_date"),
        F.trim(cell(r, f, "除權息")).alias("kind"), F.round(1 + free, 8).alias("share_factor"),
        free.alias("_free"), dt.available_daily("data_date").alias("available_at")
    ).where(is_stock_symbol("symbol") & F.col("ex_date").isNotNull() & (F.col("_free") > 0)).select(
        "symbol", F.col("ex_date").alias("data_date"), "available_at", "kind", "share_factor")


def detail_value(html: Column, label: str) -> Column:
    """Leading number of the cell that stands beside a label in a small two-column table."""
    cells = lambda tag: F.transform(F.regexp_extract_all(html, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), lambda c: F.trim(c))
    place = F.array_position(F.transform(cells("th"), lambda t: F.rtrim(t, F.lit(":： "))), label)
    value = F.when(place > 0, F.get(cells("td"), (place - 1).cast("int")))
    return lenient_double(F.regexp_extract(value, "^[0-9.]+", 0))


def resumptions(landing: DataFrame, kind: str, second: bool = False) -> DataFrame:
    """Par changes and capital reductions at the first trading day after the halt.

    The share factor is 1/adj for pure share-count changes. When cash was paid back the first
    exchange leaves it to the forecast; the second states the exact ratio in an HTML detail.
    """
    f, r = F.col("fields"), F.col("row")
    g = grid_rows(landing)
    if second:
        date, symbol = dt.roc_compact(cell(r, f, "恢復買賣日期")), cell(r, f, "證券代號", "股票代號")
        prev = lenient_double(cell(r, f, "最後交易日之收盤價格"))
        ref = lenient_double(cell(r, f, "恢復買賣開始參考價", "減資恢復買賣開始日參考價格"))
        detail = F.coalesce(cell(r, f, "詳細資料"), F.lit(""))
        share = F.coalesce(detail_value(detail, PAR_RATIO), detail_value(detail, REDUCED_SHARES) / 1000, F.try_divide(prev, ref))
    else:
        date, symbol = dt.roc_slash(cell(r, f, "恢復買賣日期")), cell(r, f, "股票代號")
        prev, ref = lenient_double(cell(r, f, "停止買賣前收盤價格")), lenient_double(cell(r, f, "恢復買賣參考價"))
        cash = F.coalesce(cell(r, f, "減資原因").contains(CASH_RETURN), F.lit(False))
        share = F.when(~cash & (prev > 0), F.try_divide(prev, ref))
    return _stamped(g.select(
        F.trim(symbol).alias("symbol"), date.alias("data_date"), F.lit(kind).alias("kind"),
        prev.alias("prev_close"), ref.alias("reference_price"), F.lit(None).cast("double").alias("value"),
        _factor(ref, prev).alias("adj_factor"), F.round(share, 8).alias("share_factor")
    ).where(is_stock_symbol("symbol") & F.col("data_date").isNotNull()))


def reduction_forecast(landing: DataFrame) -> DataFrame:
    """Exact exchange ratio of a capital reduction: share_factor only, usable from the landing date."""
    f, r = F.col("fields"), F.col("row")
    share = lenient_double(cell(r, f, "減資換股率"))
    return grid_rows(landing).select(
        F.trim(cell(r, f, "股票代號")).alias("symbol"), dt.roc_slash(cell(r, f, "恢復買賣日期")).alias("ex_date"),
        F.lit(REDUCTION).alias("kind"), F.round(share, 8).alias("share_factor"),
        dt.available_daily("data_date").alias("available_at")
    ).where(is_stock_symbol("symbol") & F.col("ex_date").isNotNull() & (F.col("share_factor") > 0)).select(
        "symbol", F.col("ex_date").alias("data_date"), "available_at", "kind", "share_factor")


# --- holder distribution ------------------------------------------------------------------------

def distribution_records(landing: DataFrame) -> DataFrame:
    """Raw (symbol, data_date, level, holders, shares, ratio) of the flat JSON list."""
    rec = landing.select(F.explode(F.from_json("payload", "array<map<string,string>>")).alias("_m"))
    keyed = rec.select(F.map_from_entries(F.transform(F.map_entries("_m"), lambda e: F.struct(
        F.trim(F.regexp_replace(e["key"], r"\x{FEFF}", "")).alias("key"), e["value"].alias("value")))).alias("m"))
    m = F.col("m")
    return keyed.select(
        F.trim(F.try_element_at(m, F.lit("證券代號"))).alias("symbol"),
        F.try_to_date(F.trim(F.try_element_at(m, F.lit("資料日期"))), "yyyyMMdd").alias("data_date"),
        lenient_long(F.try_element_at(m, F.lit("持股分級"))).cast("int").alias("level"),
        lenient_long(F.try_element_at(m, F.lit("人數"))).alias("holder_count"),
        lenient_long(F.try_element_at(m, F.lit("股數"))).alias("shares"),
        lenient_double(F.try_element_at(m, F.lit("占集保庫存數比例%"))).alias("ratio"))


def distribution_page(pages: DataFrame) -> DataFrame:
    """Same records from the HTML page of one symbol: (symbol, data_date, html) in."""
    rows = html_rows(pages, "html", ["symbol", "data_date"])
    c = F.col("cells")
    return rows.where((F.size(c) >= 5) & F.get(c, F.lit(0)).rlike(r"^\d+$")).select(
        "symbol", "data_date", F.get(c, F.lit(0)).try_cast("int").alias("level"),
        lenient_long(F.get(c, F.lit(2))).alias("holder_count"), lenient_long(F.get(c, F.lit(3))).alias("shares"),
        lenient_double(F.get(c, F.lit(4))).alias("ratio"))


def level_class(level: Column, cfg: Mapping[str, Any]) -> Column:
    """retail / medium / large / super_large by the level's upper share bound."""
    upper = F.try_element_at(_literal_map(LEVEL_BOUNDS), level)
    return (F.when(upper.isNull(), "super_large").when(upper <= cfg["retail_max"], "retail")
            .when(upper <= cfg["large_min"], "medium").when(upper <= cfg["super_min"], "large")
            .otherwise("super_large"))


def distribution(records: DataFrame, cfg: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(long table of levels 1-15, one summary row per symbol and date; level 17 holds the total)."""
    known = records.where(is_stock_symbol("symbol") & F.col("data_date").isNotNull()).withColumn(
        "available_at", dt.available_weekly("data_date", cfg["lag_days"])).withColumn(
        "ratio", F.coalesce("ratio", F.lit(0.0)))
    return known.where(F.col("level").between(1, 15)), summarise_levels(known, cfg)


def summarise_levels(rows: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    ranked = rows.withColumn("_class", F.when(
        F.col("level").between(1, 15), level_class(F.col("level"), cfg)))

    def share(name: str) -> Column:
        return F.round(F.coalesce(F.sum(F.when(F.col("_class") == name, F.col("ratio"))), F.lit(0.0)), 6)

    return ranked.groupBy("symbol", "data_date", "available_at").agg(
        share("retail").alias("retail_ratio"), share("medium").alias("medium_ratio"),
        share("large").alias("large_ratio"), share("super_large").alias("super_large_ratio"),
        F.max(F.when(F.col("level") == 17, F.col("holder_count"))).alias("holder_count"))


def html_rows(pages: DataFrame, html: str, keep: list[str], row_pattern: str = r"(?s)<tr[^>]*>(.*?)</tr>",
              cell_pattern: str = r"(?s)<td[^>]*>(.*?)</td>") -> DataFrame:
    """One row per table line: kept columns, ``pos`` and tag-free ``cells``."""
    lines = pages.select(*keep, F.posexplode(F.regexp_extract_all(
        F.col(html), F.lit(row_pattern), F.lit(1))).alias("pos", "_line"))
    text = F.transform(F.regexp_extract_all("_line", F.lit(cell_pattern), F.lit(1)), lambda c: F.trim(
        F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\x{00A0}", " ")))
    return lines.select(*keep, "pos", text.alias("cells"))


# --- futures, profiles, quotes -------------------------------------------------------------------

FUTURES_HEADERS = {
    "交易日期": "day", "契約": "contract", "到期月份(週別)": "contract_month", "開盤價": "open", "最高價": "high",
    "最低價": "low", "收盤價": "close", "漲跌價": "change", "漲跌%": "pct", "成交量": "volume", "結算價": "settle",
    "未沖銷契約數": "oi", "交易時段": "session",
}


def read_futures_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True).option("encoding", "UTF-8").csv(path)
    return futures(raw.toDF(*[c.strip() for c in raw.columns]))


def futures(raw: DataFrame, contract: str = "TX") -> DataFrame:
    """Regular session only, no spreads, rows with a close; the change in percent as a fraction."""
    r = raw.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in FUTURES_HEADERS.items() if c in raw.columns])
    out = r.where((F.col("session") == REGULAR_SESSION) & (F.col("contract_month") != "")
                  & ~F.col("contract_month").contains("/")).select(
        F.coalesce(F.nullif("contract", F.lit("")), F.lit(contract)).alias("contract"), "contract_month",
        dt.slash_date("day").alias("data_date"),
        *[lenient_double(c).alias(c) for c in ("open", "high", "low", "close", "change")],
        percent_fraction("pct").alias("change_pct"), lenient_long("volume").alias("volume"),
        lenient_double("settle").alias("settlement_price"), lenient_long("oi").alias("open_interest"))
    return _stamped(out.where("data_date IS NOT NULL AND close IS NOT NULL"))


def profiles(landing: DataFrame) -> DataFrame:
    """Industry name, shares outstanding and website from company profiles of either exchange."""
    m = F.col("m")
    rec = landing.select(F.explode(F.from_json("payload", "array<map<string,string>>")).alias("m"))

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in names])

    code = F.trim(pick("產業別", "SecuritiesIndustryCode"))
    padded = F.when(code != "", F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code))
    shares = filing_shares(pick("已發行普通股數或TDR原股發行股數", "IssueShares"))
    return rec.select(
        F.trim(pick("公司代號", "SecuritiesCompanyCode")).alias("symbol"),
        F.coalesce(F.try_element_at(_literal_map(INDUSTRIES), padded), padded).alias("industry"),
        F.when(shares > 0, shares).alias("shares_outstanding"), website(pick("網址", "WebAddress")).alias("website")
    ).where(is_stock_symbol("symbol"))


def quote_chart(landing: DataFrame) -> DataFrame:
    """Parallel arrays of a quote service to bars: rows without a close dropped, missing o/h/l take the close."""
    schema = ("chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<"
              "open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>>>>>")
    r = landing.select("source", F.from_json("payload", schema).alias("j")).select(
        "source", F.get("j.chart.result", F.lit(0)).alias("r"))
    q = F.get(F.col("r.indicators.quote"), F.lit(0))
    bars = r.select("source", F.explode(F.arrays_zip(
        F.col("r.timestamp").alias("t"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"),
        q["close"].alias("close"), q["volume"].alias("volume"))).alias("b"))
    return bars.where("b.close IS NOT NULL").select(
        "source", F.timestamp_seconds("b.t").alias("ts"), *[
            F.coalesce(F.col(f"b.{c}"), F.col("b.close")).alias(c) for c in ("open", "high", "low")],
        "b.close", F.coalesce("b.volume", F.lit(0)).alias("volume"))


# Vendor codes of the aggressor.
TICK_TYPES = {1: 1, 2: -1}


def vendor_ticks(arrays: DataFrame) -> DataFrame:
    """Vendor columns of parallel arrays (ts in ns, close, volume, bid_price, ask_price, tick_type) to trades.

    ``seq`` is the position in the delivery, the tie-break for equal times.
    """
    z = F.arrays_zip("ts", "close", "volume", "bid_price", "ask_price", "tick_type")
    side = F.coalesce(F.try_element_at(_literal_map(TICK_TYPES), F.col("t.tick_type").cast("int")), F.lit(0))
    return arrays.select("symbol", "data_date", F.posexplode(z).alias("seq", "t")).select(
        "symbol", "data_date", F.col("seq").cast("bigint").alias("seq"),
        F.timestamp_micros((F.col("t.ts") / 1000).cast("bigint")).alias("ts"), F.col("t.close").alias("price"),
        F.col("t.volume").alias("volume"), "t.bid_price", "t.ask_price", side.alias("side"))


def chart_bars(own: DataFrame, fallback: DataFrame) -> DataFrame:
    """Own daily bars where there are any, else the fallback's; the close of the bar before the newest."""
    from tapeworks.operators.joins import by_source_priority
    bars = by_source_priority([own, fallback], ["symbol", "data_date"])
    w = Window.partitionBy("symbol").orderBy("data_date")
    return bars.withColumn("prev_close", F.lag("close").over(w))


