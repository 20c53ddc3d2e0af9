"""Column functions: calendar text, availability times, month and minute buckets."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks.functions.numbers import clean_text, col

ROC_OFFSET = 1911


def _make(y: Column, m: Column, d: Column) -> Column:
    """DATE from text parts, NULL for an impossible date."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(y.isNotNull(), text.try_cast("date"))


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def roc_slash(c: Column | str) -> Column:
    """``115/09/04`` to 2026-09-04."""
    text, rx = F.trim(col(c)), r"^\s*(\d{1,3})/(\d{1,2})/(\d{1,2})\s*$"
    year = _part(text, rx, 1).try_cast("int") + ROC_OFFSET
    return _make(year, _part(text, rx, 2), _part(text, rx, 3))


def roc_compact(c: Column | str) -> Column:
    """``1150309`` to 2026-03-09."""
    text, rx = F.trim(col(c)), r"^(\d{3})(\d{2})(\d{2})$"
    year = _part(text, rx, 1).try_cast("int") + ROC_OFFSET
    return _make(year, _part(text, rx, 2), _part(text, rx, 3))


def roc_cjk(c: Column | str) -> Column:
    """``115年09月09日`` to 2026-09-09."""
    return roc_slash(F.regexp_replace(F.regexp_replace(F.trim(col(c)), "[年月]", "/"), "日+$", ""))


def roc_any(c: Column | str) -> Column:
    text = clean_text(c)
    return F.when(text.rlike(r"^\d{7}$"), roc_compact(text)).when(
        text.rlike(r"^\d{2,3}/\d{1,2}/\d{1,2}$"), roc_slash(text))


def roc_month_end(c: Column | str) -> Column:
    """``11507`` to 2026-07-31."""
    text = clean_text(c)
    first = roc_compact(F.concat(text, F.lit("01")))
    return F.when(text.rlike(r"^\d{5}$"), F.last_day(first))


def roc_period(c: Column | str) -> Column:
    """``1150914~1151013`` to STRUCT(start, end); both NULL unless there are two parts."""
    parts = F.filter(F.split(clean_text(c), "~"), lambda x: F.trim(x) != "")
    two = F.size(parts) == 2
    return F.struct(
        F.when(two, roc_any(F.get(parts, F.lit(0)))).alias("start"),
        F.when(two, roc_any(F.get(parts, F.lit(1)))).alias("end"),
    )


def slash_date(c: Column | str) -> Column:
    """``2026/09/16`` to DATE."""
    text, rx = F.trim(col(c)), r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
    return _make(_part(text, rx, 1).try_cast("int"), _part(text, rx, 2), _part(text, rx, 3))


def at_hour(day: Column, hour: int) -> Column:
    return day.cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS")


def available_daily(day: Column | str, hour: int = 15) -> Column:
    """End-of-day facts are usable on their own date after the close."""
    return at_hour(col(day), hour)


def available_weekly(day: Column | str, lag_days: int = 5, hour: int = 18) -> Column:
    return at_hour(F.date_add(col(day), lag_days), hour)


def available_holding(month_end: Column, report: Column, day: int = 21, hour: int = 8,
                      publish_lag: int = 1) -> Column:
    """Day 21 of the next month, or the day after publication if that is later."""
    nxt = F.date_add(month_end, 1)
    rule = F.date_add(nxt, F.least(F.lit(day), F.day(F.last_day(nxt))) - 1)
    return at_hour(F.greatest(rule, F.date_add(report, publish_lag)), hour)


def available_declaration(report: Column, lag: int = 1, hour: int = 8) -> Column:
    return at_hour(F.date_add(report, lag), hour)


def minute_of(ts: Column | str) -> Column:
    return F.date_trunc("minute", col(ts))


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def local_date(ts: Column, zone: str) -> Column:
    """Calendar date of an instant in a named zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))
