"""Feature tables kept up with changed facts: only rows whose windows a change reaches are built again."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.session import discard, materialise
from tapeworks.sources.versions import VersionedDays

Build = Callable[[DataFrame], DataFrame]


def reached(keys: DataFrame, changed: DataFrame, back: int) -> DataFrame:
    """(symbol, data_date, stale, needed) for the stored rows of symbols with a change.

    ``keys`` are the (symbol, data_date) that facts hold now, ``changed`` those that were written or deleted. A row is
    stale if one of the last ``back`` rows before it, or itself, changed; a deleted row counts between its neighbours.
    It is needed if a stale row's window holds it. Rows are counted per symbol, so gaps in a series do not matter.
    """
    changed = changed.select("symbol", "data_date").distinct()
    own = keys.join(changed.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "data_date", F.lit(1).alias("here"))
    rows = own.join(changed.withColumn("hit", F.lit(1)), ["symbol", "data_date"], "full")
    w = Window.partitionBy("symbol").orderBy("data_date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.count("here").over(so_far))
    since = F.col("n") - F.max(F.when(F.col("hit") == 1, F.col("n"))).over(so_far)
    rows = rows.withColumn("stale", F.col("here").isNotNull() & F.coalesce(since <= back, F.lit(False)))
    until = F.min(F.when(F.col("stale"), F.col("n"))).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("n")
    return rows.withColumn("needed", F.coalesce(until <= back, F.lit(False))).where("here = 1").select(
        "symbol", "data_date", "stale", "needed")


def rebuild(features: VersionedDays, facts: VersionedDays, changed: DataFrame, back: int, build: Build) -> int:
    """New version of ``features`` after ``changed`` (symbol, data_date) facts; returns its number.

    ``build`` makes features from facts and looks back at most ``back`` rows of a symbol. Of all facts only the keys are
    read; whole rows come from the dates that stale rows' windows reach, and only dates with stale rows are written.
    Features of deleted facts go. With nothing stale and nothing deleted the stored version stays.
    """
    keys = facts.read().select("symbol", "data_date")
    changed = materialise(changed.select("symbol", "data_date").distinct())
    marks = materialise(reached(keys, changed, back))
    gone = materialise(changed.join(keys, ["symbol", "data_date"], "left_anti"))
    days = sorted(str(r[0]) for r in marks.where("needed").select("data_date").distinct().collect())  # calendar days
    rows = facts.read(days=days).join(marks.where("needed"), ["symbol", "data_date"], "left_semi")
    built = build(rows).join(marks.where("stale"), ["symbol", "data_date"], "left_semi")
    if not days and gone.isEmpty():
        number = features.version()
    else:
        number = features.rewrite(built, gone)
    for table in (changed, marks, gone):
        discard(table)
    return number
