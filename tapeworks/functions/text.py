"""Column functions: header lookup, hashes, categories, websites, universe test."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks.functions.dates import roc_any
from tapeworks.functions.numbers import clean_text, col

# Transfer methods of official filings.
MARKET_METHODS = ["一般交易", "盤後定價交易", "鉅額逐筆交易", "鉅額配對交易"]
SINGLE_METHODS = {"贈與": "gift", "信託": "trust", "洽特定人": "private"}
DAILY_LIMIT_NOTE = "每日得轉讓股數限制"


def is_stock_symbol(c: Column | str) -> Column:
    """Four digits that do not start with 00."""
    return F.trim(col(c)).rlike("^(?!00)[0-9]{4}$")


def header_pos(fields: Column, *names: str) -> Column:
    """1-based position of the first alias present in a header array; NULL if none is."""
    stripped = F.transform(fields, lambda x: F.trim(x))
    return F.coalesce(*[F.nullif(F.array_position(stripped, n), F.lit(0)) for n in names])


def cell(row: Column, fields: Column, *names: str) -> Column:
    """Cell of a report row found by header name (aliases in order of preference)."""
    return F.get(row, (header_pos(fields, *names) - 1).cast("int"))


def cell_at(row: Column, position: int) -> Column:
    """Cell by 0-based position, for reports with repeated headers."""
    return F.get(row, F.lit(position))


def method_category(c: Column | str) -> Column:
    """market / gift / trust / private, or unknown when not wholly one kind.

    The words between blanks and brackets must all be market methods, the note on the daily limit aside.
    """
    text = clean_text(c)
    words = F.filter(F.split(text, r"[\s()（）]+"), lambda w: ~w.isin("", DAILY_LIMIT_NOTE))
    market = F.forall(words, lambda w: w.rlike(f"^({'|'.join(MARKET_METHODS)})+$"))
    kind = F.when((F.size(words) > 0) & market, "market")
    for name, single in SINGLE_METHODS.items():
        kind = kind.when(text == name, single)
    return kind.otherwise("unknown")


def row_hash(*cols: Column | str) -> Column:
    """SHA-256 over ordered fields joined by a pipe; NULL counts as empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols]), 256)


def website(c: Column | str) -> Column:
    """``scheme://host/path`` with lower-case host, or NULL if it is not a web address."""
    text = F.regexp_replace(col(c), r"[\s\x{3000}\x{00A0}]+", "")
    stated = F.instr(text, "://") > 0
    scheme = F.when(stated, F.lower(F.substring_index(text, "://", 1))).otherwise("https")
    rest = F.when(stated, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise(text)
    authority = F.get(F.split(rest, "[/?#]"), F.lit(0))
    path = F.get(F.split(F.substring(rest, F.length(authority) + 1, F.length(rest)), "[?#]"), F.lit(0))
    host = F.lower(F.substring_index(F.substring_index(authority, "@", -1), ":", 1))
    labels = F.split(host, "[.]")
    ok = (scheme.isin("http", "https") & F.length(host).between(4, 253) & (F.size(labels) > 1)
          & F.forall(labels, lambda x: x.rlike("^[-a-z0-9]+$")) & F.element_at(labels, -1).rlike("^[a-z][a-z]+$"))
    return F.when(ok, F.concat(scheme, F.lit("://"), host, path))


# Phrases of official amendment notes; a date follows.
AMENDS_NOTE = "本單為變更"
SUPERSEDED_NOTE = "本單已於"


def amendment(note: Column | str) -> Column:
    """STRUCT(note, amends, superseded): which earlier filing this one replaces, and since when
    it is itself replaced. Any other wording is kept as text only."""
    text = clean_text(note)

    def date_after(phrase: str) -> Column:
        rest = F.when(text.contains(phrase), F.substring_index(text, phrase, -1))
        return roc_any(F.regexp_extract(F.trim(rest), "^[0-9]+/[0-9]+/[0-9]{1,2}", 0))

    return F.struct(F.nullif(text, F.lit("")).alias("note"), date_after(AMENDS_NOTE).alias("amends"),
                    date_after(SUPERSEDED_NOTE).alias("superseded"))
