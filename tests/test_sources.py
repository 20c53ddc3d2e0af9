import json
from datetime import date, datetime

from pyspark.sql import functions as F

from tapeworks.config import DEFAULTS
from tapeworks.sources import filings as fil
from tapeworks.sources import landing as land
from tapeworks.sources import reports as rep

DAY = date(2026, 9, 4)


def landed(spark, payload, day=DAY):
    text = payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)
    return spark.createDataFrame([("src", day, text)], "source string, data_date date, payload string")


def grid(fields, *rows):
    return {"fields": fields, "data": [list(r) for r in rows]}


def test_price_reports(spark):
    f = ["證券代號", "證券名稱", "成交股數", "成交金額", "開盤價", "最高價", "最低價", " 收盤價 "]
    first = {"tables": [{"fields": [], "data": []}, grid(f, ["2330", "台積電", "1,262,000", "2,000,000", "100", "101", "99", "100.5"],
                                                         ["0050", "ETF", "1", "1", "1", "1", "1", "1"], ["1101", "台泥", "0", "0", "--", "--", "--", "--"])]}
    out = {r["symbol"]: r for r in rep.prices(landed(spark, first), "TWSE").collect()}
    assert set(out) == {"2330", "1101"} and out["1101"]["close"] is None
    assert (out["2330"]["volume"], out["2330"]["close"], out["2330"]["available_at"]) == (1262000, 100.5, datetime(2026, 9, 4, 15))
    second = {"tables": [grid(["代號", "名稱", "收盤", "開盤", "最高", "最低", "成交股數", "成交金額(元)"], ["6488", "環球晶", "500", "495", "505", "490", "10,000", "5,000,000"],
                              ["1111", "無", "--", "--", "--", "--", "0", "0"])]}
    out = rep.prices(landed(spark, second), "TPEx").collect()
    assert [(r["symbol"], r["turnover"], r["market"]) for r in out] == [("6488", 5e6, "TPEx")]


def test_flow_and_balance_reports(spark):
    f = ["證券代號", "外陸資買賣超股數(不含外資自營商)", "外資自營商買賣超股數", "投信買賣超股數", "自營商買賣超股數(自行買賣)", "自營商買賣超股數(避險)"]
    r = rep.institutional(landed(spark, grid(f, ["2330", "1,000", "-200", "5", "6", "--"]))).first()
    assert (r["foreign_net"], r["trust_net"], r["dealer_hedge_net"]) == (800, 5, None)
    row = ["6488"] + [str(i) for i in range(1, 24)]
    r = rep.institutional(landed(spark, {"tables": [grid(["x"] * 24, row)]}), by_position=True).first()
    assert (r["foreign_net"], r["trust_net"], r["dealer_self_net"], r["dealer_hedge_net"]) == (10, 13, 16, 19)
    m = {"tables": [grid(["a"], ["2330"]), grid(["代號"] * 12 + ["資券互抵"], ["2330"] + [str(i) for i in range(1, 16)])]}
    r = rep.margin(landed(spark, m)).first()
    assert (r["margin_buy"], r["margin_balance"], r["short_balance"]) == (2, 6, 12)
    r = rep.lending(landed(spark, grid(["x"] * 14, ["2330"] + [f"{i},000" for i in range(1, 14)]))).first()
    assert (r["sbl_short_sell"], r["sbl_return"], r["sbl_balance"]) == (9000, 10000, 12000)
    r = rep.index_series(landed(spark, grid(["日期", "成交金額", "發行量加權股價指數"], ["115/09/01", "1,000", "20,000.5"], ["bad", "1", "1"]))).collect()
    assert [(x["data_date"], x["index_close"]) for x in r] == [(date(2026, 9, 1), 20000.5)]


def test_corporate_actions(spark):
    f = ["資料日期", "股票代號", "除權息前收盤價", "除權息參考價", "權值+息值", "權/息"]
    r = rep.ex_dividends(landed(spark, grid(f, ["115年07月01日", "1101", "24.05", "23.25", "0.8", "息"]))).first()
    assert r["adj_factor"] == round(23.25 / 24.05, 8) and r["data_date"] == date(2026, 7, 1) and "share_factor" not in r.asDict()
    f = ["除權息日期", "代號", "除權息前收盤價", "除權息參考價", "權值+息值", "權/息", "每仟股無償配股"]
    r = rep.ex_dividends(landed(spark, {"tables": [grid(f, ["115/07/01", "6488", "100", "90", "10", "除權息", "50"])]}), True).first()
    assert (r["kind"], r["share_factor"]) == ("權息", 1.05)
    f = ["除權除息日期", "股票代號", "除權息", "無償配股率"]
    r = rep.rights_forecast(landed(spark, grid(f, ["115年09月09日", "2442", "權", "0.07111516"], ["115年09月09日", "1101", "息", "0"]))).collect()
    assert [(x["symbol"], x["share_factor"], x["available_at"]) for x in r] == [("2442", 1.07111516, datetime(2026, 9, 4, 15))]
    f = ["恢復買賣日期", "股票代號", "停止買賣前收盤價格", "恢復買賣參考價", "減資原因"]
    r = rep.resumptions(landed(spark, grid(f, ["115/03/09", "6949", "1490", "74.5", ""], ["115/03/09", "6176", "100", "129.2", "退還股款"])), "減資").collect()
    assert (r[0]["adj_factor"], r[0]["share_factor"], r[1]["share_factor"]) == (0.05, 20.0, None)
    f = ["恢復買賣日期", "股票代號", "最後交易日之收盤價格", "減資恢復買賣開始日參考價格", "詳細資料"]
    html = "<table><tr><th>每壹仟股換發新股票：</th> <td> 750.0</td></tr></table>"
    r = rep.resumptions(landed(spark, {"tables": [grid(f, ["1150309", "3152", "100", "120", html], ["1150309", "3153", "100", "125", ""])]}), "減資", True).collect()
    assert [x["share_factor"] for x in r] == [0.75, 0.8]
    f = ["恢復買賣日期", "股票代號", "減資換股率"]
    r = rep.reduction_forecast(landed(spark, grid(f, ["115/03/09", "6176", "0.75"]))).first()
    assert (r["kind"], r["share_factor"], r["data_date"]) == ("減資", 0.75, date(2026, 3, 9))


def test_holder_distribution(spark):
    rec = [{"﻿資料日期": "20260904", "證券代號": "2330  ", "持股分級": str(lv), "人數": "1,000", "股數": "5", "占集保庫存數比例%": str(float(lv))}
           for lv in range(1, 18)]
    records = rep.distribution_records(landed(spark, rec))
    weekly, summary = rep.distribution(records, DEFAULTS["holders"])
    s = summary.first()
    assert weekly.count() == 15 and s["holder_count"] == 1000
    assert (s["retail_ratio"], s["medium_ratio"], s["large_ratio"], s["super_large_ratio"]) == (36.0, 30.0, 39.0, 15.0)
    assert s["available_at"] == datetime(2026, 9, 9, 18)
    rows = "".join(f"<tr><td>{i}</td><td>x</td><td>1,000</td><td>5,000</td><td> {i}.5 </td></tr>" for i in (1, 15))
    page = spark.createDataFrame([("2330", DAY, f"<table><tr><th>h</th></tr>{rows}<tr><td>合計</td></tr></table>")], "symbol string, data_date date, html string")
    got = rep.distribution_page(page).collect()
    assert [(r["level"], r["holder_count"], r["ratio"]) for r in got] == [(1, 1000, 1.5), (15, 1000, 15.5)]


def test_futures_profiles_quotes(spark, tmp_path):
    p = tmp_path / "fut.csv"
    p.write_text("交易日期,契約,到期月份(週別),開盤價,最高價,最低價,收盤價,漲跌價,漲跌%,成交量,結算價,未沖銷契約數,交易時段\n"
                 "2026/09/16,TX,202609  ,100,110,90,105,5,0.84%,\"1,000\",105,50,一般\n2026/09/16,TX,202609,1,1,1,1,1,1%,1,1,1,盤後\n"
                 "2026/09/16,TX,202609/202610,1,1,1,1,1,1%,1,1,1,一般\n2026/09/16,TX,202610,-,-,-,-,-,-,0,-,0,一般\n", encoding="utf8")
    r = rep.read_futures_csv(spark, str(p)).collect()
    assert [(x["contract_month"], x["change_pct"], x["volume"], x["data_date"]) for x in r] == [("202609", 0.0084, 1000, date(2026, 9, 16))]
    prof = [{"公司代號": "2330", "產業別": "24", "已發行普通股數或TDR原股發行股數": "25,930,380,458", "網址": "https://www.tsmc.com"},
            {"SecuritiesCompanyCode": "6488", "SecuritiesIndustryCode": "1", "IssueShares": "x", "WebAddress": "-"}]
    r = rep.profiles(landed(spark, prof)).orderBy("symbol").collect()
    assert (r[0]["industry"], r[0]["shares_outstanding"], r[0]["website"]) == ("半導體", 25930380458, "https://www.tsmc.com")
    assert (r[1]["industry"], r[1]["shares_outstanding"], r[1]["website"]) == ("水泥", None, None)
    chart = {"chart": {"result": [{"timestamp": [0, 60, 120], "indicators": {"quote": [
        {"open": [1.0, None, None], "high": [2.0, None, 3.0], "low": [0.5, None, 1.0], "close": [1.5, None, 2.5], "volume": [10, None, None]}]}}]}}
    r = rep.quote_chart(landed(spark, chart)).collect()
    assert [(x["open"], x["close"], x["volume"]) for x in r] == [(1.0, 1.5, 10), (2.5, 2.5, 0)]


def _page(rows, code="2330", month="11507", market="上市公司"):
    body = "".join(f"<tr class='odd'>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in rows)
    return f"<!_co_id_hhc={code}__> 本資料由 ({market}) 資料年月：{month}<table>{body}</table>"


def test_holding_filings(spark):
    rec = [{"出表日期": "1150820", "資料年月": "11507", "公司代號": "2330", "職稱": "董事", "姓名": n, "選任時持股 ": "1", "目前持股": s, "設質股數": "0",
            "設質股數佔持股比例": "21.46%"} for n, s in (("甲", "1,000"), ("甲", "5"), ("乙", ""))]
    r = fil.holdings_json(landed(spark, rec), "TWSE").orderBy("row_seq", "holder_name").collect()
    assert [x["row_seq"] for x in r] == [0, 0, 1] and r[0]["available_at"] == datetime(2026, 8, 21, 8)
    assert {x["current_shares"] for x in r} == {1000, 5, None}
    line = ["董事", "甲", "1", "1,000", "10", "1%", "0", "0", "0%"]
    m = date(2026, 7, 31)
    pages = spark.createDataFrame([
        ("2330", "TWSE", m, _page([line, line])), ("1101", "TWSE", m, "資料庫中查無資料"), ("9999", "TWSE", m, "查無此公司資料"),
        ("1102", "TWSE", m, "busy"), ("1103", "TWSE", m, _page([line], code="1104")), ("1105", "TWSE", m, _page([line], "1105", market="上櫃公司")),
        ("1106", "TWSE", m, _page([line], "1106", month="11506")), ("1107", "TWSE", m, _page([["x"]], "1107"))],
        "symbol string, market string, data_date date, html string")
    rows, covered, bad = fil.holdings_pages(pages)
    assert sorted(r["row_seq"] for r in rows.collect()) == [0, 1]
    assert {(r["scope_key"], r["row_count"]) for r in covered.collect()} == {("2330", 2), ("1101", 0)}
    assert {r["symbol"]: r["status"] for r in bad.collect()} == {
        "9999": "no_company", "1102": "unproven", "1103": "other_company", "1105": "other_market", "1106": "other_month", "1107": "unreadable"}


def test_transfer_filings(spark):
    own, trust = "-自有持股", "-保留運用決定權信託股數"
    base = {"出表日期": "1150820", "公司代號": "2330", "申報人身分": "董事", "姓名": "甲", "預定轉讓方式及股數-轉讓方式": "一般交易",
            "預定轉讓方式及股數-轉讓股數": "1,000", "預定轉讓總股數" + own: "1,000", "預定轉讓總股數" + trust: "0", "有效轉讓期間": "1150823~1150922"}
    rows, cov = fil.transfers_json(landed(spark, [base, base, {"出表日期": "1150820", "公司代號": ""}]), "TWSE")
    r = rows.first()
    assert rows.count() == 1 and r["duplicate_count"] == 2 and r["method_category"] == "market" and r["effective_end"] == date(2026, 9, 22)
    assert r["available_at"] == datetime(2026, 8, 21, 8)
    assert [(c["data_date"], c["row_count"]) for c in cov.collect()] == [(date(2026, 8, 20), 2)]
    d = date(2026, 8, 20)
    line = ["本單為變更115/08/14 之申報", "115/08/20", "2330", "台積電", "董事", "甲", "一般交易", "1,000", "5", "", "9", "0", "1,000", "0", "8", "0", "115/08/23~115/09/22"]
    body = "<tr class='even'>" + "".join(f"<td>{c}</d>" for c in line) + "</tr>"
    pages = spark.createDataFrame([("TPEx", d, f"<table>{body}</table>"), ("TWSE", d, "無持股轉讓之情形"), ("X", d, "busy"), ("Y", date(2026, 8, 21), f"<table>{body}</table>")],
                                  "market string, data_date date, html string")
    rows, cov, bad = fil.transfer_pages(pages)
    r = rows.first()
    assert r["amends_report_date"] == date(2026, 8, 14) and r["planned_own_shares"] == 1000
    assert {(c["market"], c["row_count"]) for c in cov.collect()} == {("TPEx", 1), ("TWSE", 0)}
    assert {b["market"]: b["status"] for b in bad.collect()} == {"X": "unproven", "Y": "other_day"}


def test_same_declaration_hashes_alike_from_both_sources(spark):
    own, trust = "-自有持股", "-保留運用決定權信託股數"
    rec = {"出表日期": "1150820", "公司代號": "2330", "申報人身分": "董事", "姓名": "甲", "預定轉讓方式及股數-轉讓方式": "一般交易",
           "預定轉讓方式及股數-轉讓股數": "1,000", "每日於盤中交易最大得轉讓股數": "5", "受讓人": "", "目前持有股數" + own: "9", "目前持有股數" + trust: "0",
           "預定轉讓總股數" + own: "1,000", "預定轉讓總股數" + trust: "0", "預定轉讓後持股" + own: "8", "預定轉讓後持股" + trust: "0", "有效轉讓期間": "1150823~1150922"}
    a, _ = fil.transfers_json(landed(spark, [rec]), "TWSE")
    line = ["", "115/08/20", "2330", "台積電", "董事", "甲", "一般交易", "1,000", "5", "", "9", "0", "1,000", "0", "8", "0", "115/08/23~115/09/22"]
    page = "<table><tr class='odd'>" + "".join(f"<td>{c}</td>" for c in line) + "</tr></table>"
    b, _, _ = fil.transfer_pages(spark.createDataFrame([("TWSE", date(2026, 8, 20), page)], "market string, data_date date, html string"))
    assert a.first()["row_hash"] == b.first()["row_hash"]


def test_landing_batch_stream_and_sinks(spark, tmp_path):
    for d in ("2026-09-01", "2026-09-02"):
        f = tmp_path / "zone" / "prices" / d
        f.mkdir(parents=True)
        (f / "a.json").write_text('{"fields": ["x"],\n "data": []}')
    df = land.read_landing(spark, str(tmp_path / "zone"))
    assert {(r["source"], str(r["data_date"])) for r in df.collect()} == {("prices", "2026-09-01"), ("prices", "2026-09-02")}
    assert df.where(F.col("payload").contains("\n")).count() == 2
    q = land.stream_landing(spark, str(tmp_path / "zone")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2

    t = spark.createDataFrame([("a", date(2026, 9, 1), 1), ("b", date(2026, 9, 2), 2)], "symbol string, data_date date, v int")
    path = str(tmp_path / "tab")
    land.write_days(t, path)
    land.write_days(t.where("symbol = 'b'").withColumn("v", F.lit(5)), path, files_per_day=2)
    got = {(r["symbol"], r["v"]) for r in land.read_table(spark, path, ["symbol", "v"], start="2026-09-01").collect()}
    assert got == {("a", 1), ("b", 5)}
    plan = land.read_table(spark, path, ["symbol"], start="2026-09-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "data_date" in plan


def test_stream_upsert_is_idempotent(spark, tmp_path):
    from tapeworks.streaming.bars import write_upsert
    src = tmp_path / "in"
    rows = spark.createDataFrame([("a", date(2026, 9, 1), 1), ("b", date(2026, 9, 1), 2)], "symbol string, data_date date, v int")
    rows.write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    out = str(tmp_path / "out")
    write_upsert(stream, out, str(tmp_path / "c1"), ["symbol", "data_date"]).start().awaitTermination()
    write_upsert(stream, out, str(tmp_path / "c2"), ["symbol", "data_date"]).start().awaitTermination()
    rows.where("symbol = 'a'").withColumn("v", F.lit(9)).write.mode("append").parquet(str(src))
    write_upsert(stream, out, str(tmp_path / "c2"), ["symbol", "data_date"]).start().awaitTermination()
    assert {(r["symbol"], r["v"]) for r in spark.read.parquet(out).collect()} == {("a", 9), ("b", 2)}




def test_day_sink_keeps_every_batch_of_a_date(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    kind = "symbol string, data_date date, seq long, v int"
    for k, v in enumerate((1, 2, 3)):
        spark.createDataFrame([("a", date(2026, 9, 1), k, v), ("a", date(2026, 9, 1 + k), 9, v)], kind).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(src))
    for run in ("c1", "c2"):  # the second run delivers everything again
        land.replace_day_stream(stream, out, str(tmp_path / run), ["symbol", "seq"]).trigger(availableNow=True).start().awaitTermination()
    got = {(r["data_date"].day, r["seq"], r["v"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 9, 1), (2, 9, 2), (3, 9, 3)}


def test_upsert_takes_the_newest_of_a_batch(spark, tmp_path):
    from tapeworks.streaming.bars import write_upsert
    src, out = tmp_path / "in", str(tmp_path / "out")
    kind = "symbol string, data_date date, seq long, v int"
    spark.createDataFrame([("a", date(2026, 9, 1), 2, 20), ("a", date(2026, 9, 1), 3, 30), ("a", date(2026, 9, 1), 1, 10)], kind).write.parquet(str(src))
    write_upsert(spark.readStream.schema(kind).parquet(str(src)), out, str(tmp_path / "c"), ["symbol"], seq="seq").start().awaitTermination()
    assert [(r["seq"], r["v"]) for r in spark.read.parquet(out).collect()] == [(3, 30)]
