"""Insider filings as of a date: visible versions, holder sums, amendments, transfer ratio."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.dates import available_declaration, month_index
from tapeworks.functions.numbers import ratio

# Title prefix of major holders, preferred source name.
MAJOR_PREFIX = "大股東"
PREFERRED_SOURCE = "openapi"
FORWARD, BACKFILL = "forward", "backfill"


def visible_versions(rows: DataFrame, as_of: Column) -> DataFrame:
    """Whole rows of the version in force per (symbol, month): latest available, then preferred source,
    then report date. Versions are never mixed."""
    seen = rows.where(F.col("available_at") <= as_of)
    version = seen.groupBy("symbol", "data_date", "source", "report_date").agg(
        F.max("available_at").alias("_at"))
    rank = F.struct(F.col("_at"), (F.col("source") == PREFERRED_SOURCE).alias("_p"), F.col("report_date"))
    best = version.groupBy("symbol", "data_date").agg(
        F.max_by(F.struct("source", "report_date"), rank).alias("_b")).select(
        "symbol", "data_date", F.col("_b.source").alias("source"), F.col("_b.report_date").alias("report_date"))
    return seen.join(best, ["symbol", "data_date", "source", "report_date"], "left_semi")


def provenance_class(modes: Column) -> Column:
    """Class of a *set* of observation modes; an unknown mode or an empty set proves nothing."""
    known = F.array_except(modes, F.array(F.lit(FORWARD), F.lit(BACKFILL)))
    unknown = (F.size(modes) == 0) | (F.size(known) > 0)
    return (F.when(modes.isNull() | unknown, "unknown")
            .when(~F.array_contains(modes, BACKFILL), "point_in_time_safe")
            .when(~F.array_contains(modes, FORWARD), "backfill_derived").otherwise("mixed"))


def mode_set(mode: str) -> Column:
    """Distinct modes of a group with NULL made visible (``collect_set`` drops NULLs); at most a
    handful of values."""
    return F.collect_set(F.coalesce(F.col(mode), F.lit("?")))


def strict_sum(value: str) -> Column:
    """Sum, or NULL when any member is unknown."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def holders(versions: DataFrame) -> DataFrame:
    """One row per person and month: largest known holding (several titles repeat the same shares)."""
    return versions.groupBy("symbol", "data_date", "holder_name").agg(
        F.max("current_shares").alias("current"), F.max("pledged_shares").alias("pledged"),
        F.max(F.col("title").startswith(MAJOR_PREFIX)).alias("is_major"))


def month_totals(people: DataFrame) -> DataFrame:
    """Total (NULL if any member is unknown) and pledge ratio per symbol and month."""
    held = F.col("current") > 0
    agg = people.groupBy("symbol", "data_date").agg(
        strict_sum("current").alias("total"), F.count(F.lit(1)).alias("holders"),
        F.count(F.when(held & F.col("pledged").isNull(), 1)).alias("_unknown"),
        F.sum(F.when(held, F.col("pledged"))).alias("_pledged"))
    ok = (F.col("total") > 0) & (F.col("_unknown") == 0)
    return agg.select("symbol", "data_date", "holders", "total", F.when(ok, ratio(
        F.coalesce("_pledged", F.lit(0)), F.col("total"))).alias("pledge_ratio"))


def continuing_change(people: DataFrame) -> DataFrame:
    """Change of the shares of people listed in both a month and the month before.

    Joining or leaving the list is not a change; one unknown member makes the result NULL.
    """
    prev = people.select(
        "symbol", "holder_name", F.last_day(F.date_add("data_date", 1)).alias("data_date"),
        F.col("current").alias("p_current"), F.col("is_major").alias("p_major"))
    both = people.join(prev, ["symbol", "data_date", "holder_name"])

    def over(keep: Column) -> Column:
        known = F.count(F.when(keep & F.col("current").isNotNull() & F.col("p_current").isNotNull(), 1))
        n = F.count(F.when(keep, 1))
        before = F.sum(F.when(keep, F.col("p_current")))
        after = F.sum(F.when(keep, F.col("current")))
        return F.when((n > 0) & (known == n) & (before > 0), ratio(after - before, before))

    return both.groupBy("symbol", "data_date").agg(
        F.count(F.lit(1)).alias("continuing"), over(F.lit(True)).alias("change_pct"),
        over(F.col("is_major") & F.col("p_major")).alias("major_change_pct"))


def holding_features(rows: DataFrame, target: Column, as_of: Column, stale_months: int = 2) -> DataFrame:
    """Newest usable month per symbol with totals, changes, pledges and provenance."""
    versions = visible_versions(rows.where(F.col("data_date") <= target), as_of)
    people = holders(versions)
    modes = versions.groupBy("symbol", "data_date").agg(
        mode_set("ingestion_mode").alias("modes"), F.min("source").alias("source"))
    month = month_totals(people).join(modes, ["symbol", "data_date"])
    prev = month.select("symbol", F.last_day(F.date_add("data_date", 1)).alias("data_date"),
                        F.col("pledge_ratio").alias("p_ratio"), F.col("modes").alias("p_modes"))
    full = month.join(prev, ["symbol", "data_date"], "left").join(
        continuing_change(people), ["symbol", "data_date"], "left")
    cols = ["data_date", "source", "total", "holders", "change_pct", "pledge_ratio", "p_ratio",
            "major_change_pct", "modes", "p_modes"]
    last = full.groupBy("symbol").agg(F.max_by(F.struct(*cols), F.col("data_date")).alias("_s"))
    last = last.select("symbol", *[F.col(f"_s.{c}").alias(c) for c in cols])
    fresh = month_index(target) - month_index(F.col("data_date")) <= stale_months
    return last.where(fresh).select(
        "symbol", F.col("data_date").alias("holding_month"), "source", "total", "holders", "change_pct",
        "pledge_ratio", (F.col("pledge_ratio") - F.col("p_ratio")).alias("pledge_ratio_change"),
        "major_change_pct", "modes",
        provenance_class(F.array_union("modes", F.coalesce("p_modes", F.array().cast("array<string>"))))
        .alias("holding_provenance"))


def declaration_total(own: Column, trust: Column, official: Column) -> tuple[Column, Column]:
    """(total, inconsistent): own + trust when both are known; a differing official total voids it."""
    both = own + trust
    bad = both.isNotNull() & official.isNotNull() & (official != both)
    return F.when(~bad, both), F.coalesce(bad, F.lit(False))


def resolve_transfers(declarations: DataFrame, as_of: Column, window_start: Column | None = None,
                      lag: int = 1, hour: int = 8) -> DataFrame:
    """Planned market sales per symbol after amendments.

    An amendment takes effect only once it is itself visible, and before the method filter (it may
    change the method). It must match exactly one earlier filing by symbol, date, role and person;
    otherwise the symbol's total is NULL.
    """
    seen = declarations.where(F.col("available_at") <= as_of)
    match = ["symbol", "data_date", "reporter_role", "reporter_name"]
    amending = F.col("amends_report_date").isNotNull()
    if window_start is not None:
        amending = amending & (F.col("amends_report_date") >= window_start)
    # Candidates are counted per match key, not paired: a filing that targets its own key is not its own candidate.
    per_key = seen.groupBy(*match).agg(F.count(F.lit(1)).alias("_cands"), F.min("row_hash").alias("_lo"),
                                       F.max("row_hash").alias("_hi"))
    amend = seen.where(amending).select(
        "symbol", F.col("amends_report_date").alias("data_date"), "reporter_role", "reporter_name",
        F.col("row_hash").alias("by_hash"),
        (F.col("amends_report_date") == F.col("data_date")).alias("_self"))
    found = amend.join(per_key, match, "left").withColumn(
        "_n", F.coalesce(F.col("_cands"), F.lit(0)) - F.col("_self").cast("int"))
    victim = F.when(F.col("_self") & (F.col("by_hash") == F.col("_lo")), F.col("_hi")).otherwise(F.col("_lo"))
    dropped = found.where("_n = 1").select(
        "symbol", "data_date", victim.alias("row_hash")).distinct().withColumn("_gone", F.lit(True))
    ambiguous = found.groupBy("symbol").agg(F.max((F.col("_n") != 1).cast("int")).alias("_amb"))
    superseded = F.coalesce(
        available_declaration(F.col("superseded_on"), lag, hour) <= as_of, F.lit(False))
    total, bad = declaration_total(F.col("planned_own_shares").cast("bigint"),
                                   F.col("planned_trust_shares").cast("bigint"), F.col("transfer_shares"))
    live = (
        seen.join(dropped, ["symbol", "data_date", "row_hash"], "left")
        .withColumn("_live", F.col("_gone").isNull() & ~superseded & (F.col("method_category") == "market"))
        .withColumn("_total", total).withColumn("_bad", bad)
    )
    agg = live.groupBy("symbol").agg(
        F.count(F.when(F.col("_live"), 1)).alias("live"),
        F.count(F.when(F.col("_live") & F.col("_total").isNotNull(), 1)).alias("_known"),
        F.sum(F.when(F.col("_live"), F.col("_total"))).alias("_sum"),
        F.max(F.when(F.col("_live"), F.col("_bad").cast("int")).otherwise(0)).alias("_bad"),
        mode_set("ingestion_mode").alias("modes"))
    joined = agg.join(ambiguous, "symbol", "left").withColumn("_amb", F.coalesce("_amb", F.lit(0)))
    void = (F.col("_amb") == 1) | (F.col("_bad") == 1) | (F.col("_known") < F.col("live"))
    return joined.select(
        "symbol", "modes", (F.col("_amb") == 1).alias("ambiguous"), (F.col("_bad") == 1).alias("inconsistent"),
        ((F.col("live") > 0) | (F.col("_amb") == 1)).alias("listed"),
        F.when(~void, F.col("_sum")).alias("shares"))


def transfer_ratio(listed: Column, shares: Column, total: Column, covered: Column) -> Column:
    """Planned sales over holdings: a true 0 only when every day is covered and nothing was filed."""
    ok = F.coalesce(covered, F.lit(False)) & (total > 0)
    return F.when(ok & ~F.coalesce(listed, F.lit(False)), F.lit(0.0)).when(ok, ratio(shares, total))


def shadow_features(universe: DataFrame, holdings: DataFrame, declarations: DataFrame, coverage: DataFrame,
                    window: DataFrame, target: Column, as_of: Column, stale_months: int = 2) -> DataFrame:
    """Raw insider features of one date for ``universe`` (symbol, market)."""
    start = window.agg(F.min("data_date")).scalar()
    days = window.select("data_date").distinct()
    n_days = days.agg(F.count(F.lit(1))).scalar()
    covered = coverage.join(days, "data_date", "left_semi").groupBy("market").agg(
        F.count_distinct("data_date").alias("_d"), mode_set("ingestion_mode").alias("cover_modes")
    ).where((F.col("_d") == n_days) & (F.col("_d") > 0)).drop("_d").withColumn("covered", F.lit(True))
    recent = declarations.where(F.col("data_date").between(start, target))
    moved = resolve_transfers(recent, as_of, start).select(
        "symbol", "listed", "shares", F.col("modes").alias("move_modes"))
    held = holding_features(holdings, target, as_of, stale_months)
    none = F.array(F.lit("?"))
    modes = F.array_union(F.coalesce("cover_modes", none), F.array_union(
        F.coalesce("move_modes", F.array().cast("array<string>")), F.coalesce("modes", none)))
    return (
        universe.join(held, "symbol", "left").join(moved, "symbol", "left").join(covered, "market", "left")
        .select(
            "symbol", target.alias("data_date"), as_of.alias("available_at"), "holding_month", "source",
            F.coalesce("holding_provenance", F.lit("unknown")).alias("holding_provenance"),
            provenance_class(modes).alias("transfer_provenance"),
            F.col("change_pct").alias("insider_holding_change_pct"),
            F.col("pledge_ratio").alias("insider_pledge_ratio"),
            F.col("pledge_ratio_change").alias("insider_pledge_ratio_change"),
            F.col("major_change_pct").alias("major_holder_change_pct"),
            transfer_ratio(F.col("listed"), F.col("shares"), F.col("total"), F.col("covered"))
            .alias("transfer_market_sale_ratio"))
    )


RAW_COLUMNS: Sequence[str] = (
    "insider_holding_change_pct", "insider_pledge_ratio", "insider_pledge_ratio_change",
    "major_holder_change_pct", "transfer_market_sale_ratio")
