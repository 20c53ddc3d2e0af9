from datetime import date

from pyspark.sql import functions as F

from tapeworks.functions import dates as dt
from tapeworks.functions import numbers as num
from tapeworks.functions import text as tx
from tapeworks.config import DEFAULTS, settings, version_of


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_lenient_numbers(spark):
    assert one(spark, num.lenient_double, " 1,262,000.5 ") == 1262000.5
    assert one(spark, num.lenient_long, "1,262,000") == 1262000
    for bad in ("--", "", "X", "abc", None):
        assert one(spark, num.lenient_double, bad) is None
    assert one(spark, num.filing_shares, "1,000") == 1000
    assert one(spark, num.filing_shares, "1.5") is None
    assert one(spark, num.percent_fraction, "0.84%") == 0.0084


def test_calendar_text(spark):
    assert one(spark, dt.roc_slash, "115/09/04") == date(2026, 9, 4)
    assert one(spark, dt.roc_slash, "115/02/30") is None
    assert one(spark, dt.roc_compact, "1150309") == date(2026, 3, 9)
    assert one(spark, dt.roc_cjk, "115年09月09日") == date(2026, 9, 9)
    assert one(spark, dt.roc_month_end, "11507") == date(2026, 7, 31)
    assert one(spark, dt.roc_any, "115/8/14") == date(2026, 8, 14)
    p = one(spark, dt.roc_period, "115/03/10 ~ 115/03/12")
    assert (p["start"], p["end"]) == (date(2026, 3, 10), date(2026, 3, 12))
    p = one(spark, dt.roc_period, "1150914")
    assert (p["start"], p["end"]) == (None, None)


def test_text(spark):
    assert one(spark, tx.is_stock_symbol, "2330") is True
    assert one(spark, tx.is_stock_symbol, "0050") is False
    assert one(spark, tx.method_category, "一般交易") == "market"
    assert one(spark, tx.method_category, "贈與") == "gift"
    assert one(spark, tx.method_category, "一般交易及贈與") == "unknown"
    assert one(spark, tx.website, "WWW.ACC.com.tw") == "https://www.acc.com.tw"
    assert one(spark, tx.website, "https:// www.x.com/a") == "https://www.x.com/a"
    assert one(spark, tx.website, "none") is None
    a = one(spark, tx.amendment, "本單為變更115/08/14 之申報")
    assert a["amends"] == date(2026, 8, 14) and a["superseded"] is None
    a = one(spark, tx.amendment, "本單已於115/08/18 申報變更")
    assert a["superseded"] == date(2026, 8, 18) and a["amends"] is None


def test_costs_and_version(spark):
    r = spark.range(1).select(num.net_return(F.lit(100.0), F.lit(100.0), DEFAULTS["backtest"]).alias("r")).first()["r"]
    assert r < 0 and abs(num.round_trip_cost(DEFAULTS["backtest"]) - 0.00785) < 1e-12
    assert version_of(settings()) == version_of(settings())
    assert version_of(settings({"signal": {"buy": 80.0}})) != version_of(settings())
    assert len(version_of(settings())) == 12


def test_prices_as_short_text(spark):
    from tapeworks.functions.numbers import short_text
    values = [12.0, 12.5, 0.25, 99.99, 1234.56, 12345.67, 123456.7, -3.1]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(short_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [f"{v:g}" for v in values]
