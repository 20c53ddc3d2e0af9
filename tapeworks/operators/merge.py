"""Key-wise merges: upsert, insert-if-absent, column ownership, first observation.

Each merge is one aggregate over old and new rows (no pairwise join), so a key that is
repeated very often combines before the shuffle.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], *,
           update: Sequence[str] | None = None, seq: str | None = None,
           touch: str | None = None, now: Column | None = None) -> DataFrame:
    """New rows inserted; on a key clash ``update`` columns (default: all) take the new value,
    even a NULL one, and the others keep the old. ``seq`` orders repeats inside ``new``;
    ``touch`` is a time column set to ``now`` on every written row."""
    keys = list(keys)
    update = [c for c in old.columns if c not in keys] if update is None else list(update)
    tagged = old.withColumn("_o", F.lit(0)).withColumn("_q", F.lit(None).cast("bigint")).unionByName(
        new.withColumn("_o", F.lit(1)).withColumn(
            "_q", F.col(seq).cast("bigint") if seq else F.lit(None).cast("bigint")),
        allowMissingColumns=True)
    rank = F.struct("_o", "_q")
    own = [c for c in old.columns if c not in keys and c != touch]
    # one aggregate for all columns that are taken from one row: its rank is kept, shuffled and compared once
    newest, oldest = [c for c in own if c in update], [c for c in own if c not in update]
    aggs = [f(F.struct(*cs), rank).alias(name) for f, cs, name in ((F.max_by, newest, "_newest"), (F.min_by, oldest, "_oldest")) if cs]
    if touch in old.columns and touch not in keys:
        aggs.append(F.when(F.max("_o") == 1, now).otherwise(F.max(touch)).alias(touch))
    if not aggs:
        return tagged.groupBy(*keys).agg(F.lit(1)).select(*old.columns)
    return tagged.groupBy(*keys).agg(*aggs).select(*[
        F.col(f"_newest.{c}").alias(c) if c in newest else F.col(f"_oldest.{c}").alias(c) if c in oldest else F.col(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows are never touched."""
    return old.unionByName(
        new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"),
        allowMissingColumns=True)


def enrich(master: DataFrame, facts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Update known rows only: a known new value replaces the old one; nothing is inserted."""
    picked = facts.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = master.join(picked, list(keys), "left")
    return joined.select(*[
        F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
        for c in master.columns])


def merge_owned(sources: Mapping[str, DataFrame], keys: Sequence[str],
                owners: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per key from several sources; each column is taken from its owners in order
    of preference (first source with a value)."""
    keys, union = list(keys), None
    for name, df in sources.items():
        one = df.withColumn("_src", F.lit(name))
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    aggs = []
    for c, order in owners.items():
        rank = F.lit(None).cast("int")
        for i, name in reversed(list(enumerate(order))):
            rank = F.when(F.col("_src") == name, i).otherwise(rank)
        aggs.append(F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c))
    return union.groupBy(*keys).agg(*aggs)


def first_observed(df: DataFrame, keys: Sequence[str], observed: str,
                   keep_first: Sequence[str]) -> DataFrame:
    """Repeated imports folded: provenance columns from the first observation, the rest from the last."""
    keys = list(keys)
    first = [observed, *[c for c in keep_first if c != observed]]
    rest = [c for c in df.columns if c not in keys and c not in first]
    agg = df.groupBy(*keys).agg(
        F.min_by(F.struct(*first), F.col(observed)).alias("_f"),
        *([F.max_by(F.struct(*rest), F.col(observed)).alias("_l")] if rest else []))
    return agg.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in first],
                      *[F.col(f"_l.{c}").alias(c) for c in rest])


def clear_derived_factor(actions: DataFrame, is_cash_return: Column, tolerance: float = 1e-6) -> DataFrame:
    """Cash-return reductions whose share factor was merely derived as 1/adj lose it; exact ones stay."""
    derived = F.abs(F.col("share_factor") - F.try_divide(F.lit(1.0), F.col("adj_factor"))) < tolerance
    return actions.withColumn("share_factor", F.when(
        is_cash_return & F.coalesce(derived, F.lit(False)), F.lit(None)).otherwise(F.col("share_factor")))


def normalise_spelling(df: DataFrame, column: str, mapping: Mapping[str, str], keys: Sequence[str],
                       prefer: str) -> DataFrame:
    """Correct spellings; where right and wrong both existed for a key the right one stays."""
    fixed = F.coalesce(F.try_element_at(F.create_map(*[
        F.lit(x) for kv in mapping.items() for x in kv]), F.col(column)), F.col(column))
    was_right = F.col(column).eqNullSafe(fixed).cast("int")
    rows = df.withColumn("_right", was_right).withColumn(column, fixed)
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("_right", prefer)).alias("_s"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_s.{c}").alias(c) for c in df.columns])
