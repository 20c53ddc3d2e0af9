"""Factor research: rank IC, Newey-West statistics, buckets, splits, residuals, verdicts."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numbers import pearson, ratio
from tapeworks.operators import order_stats, prefix
from tapeworks.session import discard, materialise


def pearson_by(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str,
               extra: Sequence[Column] = ()) -> DataFrame:
    """Correlation per group from partial sums."""
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"),
        F.sum(F.col(x) * F.col(x)).alias("_xx"), F.sum(F.col(y) * F.col(y)).alias("_yy"),
        F.sum(F.col(x) * F.col(y)).alias("_xy"), *extra)
    return s.withColumn(out, pearson(F.col("n"), F.col("_x"), F.col("_y"), F.col("_xx"),
                                     F.col("_yy"), F.col("_xy"))).drop("_x", "_y", "_xx", "_yy", "_xy")


def rank_ic(df: DataFrame, keys: Sequence[str], x: str, y: str, min_names: int,
            out: str = "ic") -> DataFrame:
    """Spearman correlation per group (average ranks); groups that are too small or constant drop out.

    Values and ranks are written step by step, so no step's shuffle files lie beside the next one's.
    """
    keys = list(keys)
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = order_stats.average_ranks_stored(known.select(*dict.fromkeys([*keys, x, y])), keys, {x: "_rx", y: "_ry"})
    ics = materialise(pearson_by(ranked, keys, "_rx", "_ry", out).where(
        (F.col("n") >= min_names) & F.col(out).isNotNull()))
    discard(ranked)
    return ics


def newey_west(series: DataFrame, keys: Sequence[str], value: str, lags: Column | int,
               max_lags: int, order: str = "data_date") -> DataFrame:
    """Mean, naive t and Newey-West t (Bartlett weights) of an ordered series per group.

    The series has one value per trading day, so lagged products come from one window; ``lags``
    may differ by group (horizon - 1) up to ``max_lags``.
    """
    keys = list(keys)
    lags = F.lit(lags) if isinstance(lags, int) else lags
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    w = part.orderBy(order)
    s = series.where(F.col(value).isNotNull()).withColumn("_L", lags)
    s = s.withColumn("_d", F.col(value) - F.avg(value).over(part))
    s = s.withColumns({f"_g{i}": F.col("_d") * F.lag("_d", i).over(w) for i in range(1, max_lags + 1)})
    agg = s.groupBy(*keys).agg(
        F.count(value).alias("n_days"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("_sd"), F.sum(F.col("_d") * F.col("_d")).alias("_g0"),
        F.max("_L").alias("_L"), F.avg((F.col(value) > 0).cast("double")).alias("positive_share"),
        *[F.sum(f"_g{i}").alias(f"_s{i}") for i in range(1, max_lags + 1)])
    n = F.col("n_days")
    variance = F.col("_g0") / n
    for i in range(1, max_lags + 1):
        weight = 2.0 * (1.0 - F.lit(float(i)) / (F.col("_L") + 1.0))
        variance = variance + F.when(F.col("_L") >= i, weight * F.coalesce(
            F.col(f"_s{i}"), F.lit(0.0)) / n).otherwise(0.0)
    agg = agg.withColumn("_var", variance)
    enough = n >= 2
    naive = F.when(F.col("_sd") > 0, F.try_divide(F.col("mean"), F.col("_sd")) * F.sqrt(n)).otherwise(0.0)
    nw = F.when(F.col("_var") <= 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col("mean"), F.sqrt(F.when(F.col("_var") > 0, F.col("_var") / n))))
    icir = F.when(F.col("_sd") > 0, F.try_divide(F.col("mean"), F.col("_sd"))).otherwise(0.0)
    return agg.select(
        *keys, "n_days", F.when(enough, F.col("mean")).alias("mean"),
        F.when(enough, naive).alias("t_naive"), F.when(enough, nw).alias("t_nw"),
        "positive_share", F.when(enough, icir).alias("icir"))


def pooled_spearman(df: DataFrame, x: str, y: str, min_rows: int = 30) -> DataFrame:
    """One rank correlation over all rows, whatever their date."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_all", F.lit(1))
    return rank_ic(known, ["_all"], x, y, min_rows, "rho").select("n", "rho")


def split_by_days(days: DataFrame, embargo: int, symmetric: bool = False) -> DataFrame:
    """(data_date, segment): first half train, second half test, ``embargo`` days apart."""
    one = Window.partitionBy(F.lit(1))
    d = days.select("data_date").distinct().withColumn(
        "_i", F.row_number().over(one.orderBy("data_date")) - 1).withColumn(
        "_mid", F.floor(F.count(F.lit(1)).over(one) / 2))
    before, after = (embargo // 2, embargo // 2) if symmetric else (0, embargo)
    label = (F.when(F.col("_i") < F.col("_mid") - before, "train")
             .when(F.col("_i") >= F.col("_mid") + after, "test").otherwise("embargo"))
    return d.select("data_date", label.alias("segment"))


def total_position(df: DataFrame, keys: Sequence[str], value: str, day: str, tie: Sequence[str],
                   out: str = "position") -> DataFrame:
    """0-based place in a full sort of each group by value, then ``day``, then ``tie``.

    Equal values are numbered day by day, so even a value shared by most rows is spread out.
    """
    keys = list(keys)
    placed = order_stats.with_positions(df.where(F.col(value).isNotNull()), keys, value)
    placed = prefix.running_sum(placed, [*keys, value], [day], [day, *tie], F.lit(1), "_k")
    return placed.withColumn(out, F.col("_below") + F.col("_k") - 1).drop("_ties", "_below", "_k")


def position_buckets(df: DataFrame, keys: Sequence[str], value: str, day: str, tie: Sequence[str],
                     buckets: int = 5) -> DataFrame:
    """1-based bucket of the sorted position, cut at floor(n * k / buckets)."""
    p = total_position(df, keys, value, day, tie)
    bucket = F.lit(1)
    for k in range(1, buckets):
        bucket = bucket + F.when(F.col("position") >= F.floor(F.col("_n") * k / buckets), 1).otherwise(0)
    return p.withColumn("bucket", bucket).drop("_n", "position")


def quantile_buckets(df: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """Equal-frequency bucket (right-closed edges); repeated edges are dropped and renumbered."""
    known = df.where(F.col(value).isNotNull())
    names = {f"_e{k}": k / buckets for k in range(buckets)}
    edges = order_stats.quantiles(known, [], value, names).select(
        F.array_sort(F.array_distinct(F.array(*names))).alias("_edges"))
    return known.withColumn("_edges", edges.scalar()).withColumn(
        "bucket", F.greatest(F.lit(1), F.size(F.filter("_edges", lambda e: e < F.col(value))))
    ).drop("_edges")


def monotone_steps(table: DataFrame, keys: Sequence[str], bucket: str, value: str) -> DataFrame:
    """Rises between neighbouring buckets and last-minus-first spread, per group."""
    w = Window.partitionBy(*keys).orderBy(bucket)
    step = table.withColumn("_up", (F.col(value) > F.lag(value).over(w)).cast("int"))
    return step.groupBy(*keys).agg(
        F.coalesce(F.sum("_up"), F.lit(0)).alias("rises"),
        (F.max_by(value, bucket) - F.min_by(value, bucket)).alias("spread"))


def residualise(df: DataFrame, keys: Sequence[str], factor: str, baseline: str,
                out: str = "residual", min_rows: int = 3) -> DataFrame:
    """Rank of the factor with the rank of the baseline regressed out, per group."""
    keys = list(keys)
    known = df.where(F.col(factor).isNotNull() & F.col(baseline).isNotNull())
    r = order_stats.average_ranks(known, keys, {factor: "_f", baseline: "_b"})
    fit = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_f").alias("_mf"), F.avg("_b").alias("_mb"),
        F.covar_pop("_f", "_b").alias("_cov"), F.var_pop("_b").alias("_var"))
    fit = fit.where((F.col("_n") >= min_rows) & (F.col("_var") > 0))
    return r.join(fit, keys).withColumn(out, F.col("_f") - (
        F.col("_mf") + F.try_divide(F.col("_cov"), F.col("_var")) * (F.col("_b") - F.col("_mb")))
    ).drop("_f", "_b", "_n", "_mf", "_mb", "_cov", "_var")


def factor_grid(factors_long: DataFrame, returns_long: DataFrame, min_names: int) -> DataFrame:
    """Daily IC of every factor x horizon: rows (factor, horizon, data_date, ic)."""
    joined = factors_long.join(returns_long, ["symbol", "data_date"])
    return rank_ic(joined, ["factor", "horizon", "data_date"], "value", "net", min_names)


def combine(factors_long: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted factor sums per scheme; ``weights`` holds (scheme, factor, weight)."""
    return factors_long.join(weights, "factor").groupBy("symbol", "data_date", "scheme").agg(
        F.sum(F.col("weight") * F.col("value")).alias("value"))


def group_spread(df: DataFrame, keys: Sequence[str], high: Column, low: Column, value: str,
                 min_rows: int) -> DataFrame:
    """Mean of ``value`` among high rows minus low rows; groups short on either side drop out."""
    agg = df.groupBy(*keys).agg(
        F.avg(F.when(high, F.col(value))).alias("_h"), F.count(F.when(high, F.col(value))).alias("n_high"),
        F.avg(F.when(low, F.col(value))).alias("_l"), F.count(F.when(low, F.col(value))).alias("n_low"))
    return agg.where((F.col("n_high") >= min_rows) & (F.col("n_low") >= min_rows)).select(
        *keys, "n_high", "n_low", (F.col("_h") - F.col("_l")).alias("spread"))


def verdict(train: Column, test: Column, t_nw: Column, n_days: Column, honest: Column,
            min_days: int) -> Column:
    """robust only for point-in-time data with enough test days, equal signs and |t| > 2."""
    same = F.signum(train) == F.signum(test)
    return (
        F.when(~honest, "retrospective")
        .when(train.isNull() | test.isNull() | (n_days < min_days), "insufficient")
        .when(same & (F.abs(F.coalesce(t_nw, F.lit(0.0))) > 2), "robust").otherwise("failed"))


def honest_value(value: Column, provenance: Column) -> Column:
    return F.when(provenance == "point_in_time_safe", value)


def provenance_counts(df: DataFrame, factor: str, provenance: str, min_names: int) -> DataFrame:
    """Known values by provenance, and days with enough point-in-time-safe names."""
    known = df.where(F.col(factor).isNotNull())
    p = F.col(provenance)
    day = known.groupBy("data_date").agg(
        F.count(F.when(p == "point_in_time_safe", 1)).alias("_s"),
        F.count(F.when(p == "backfill_derived", 1)).alias("_b"), F.count(F.lit(1)).alias("_n"))
    return day.agg(
        F.sum("_s").alias("safe"), F.sum("_b").alias("backfill"),
        F.sum(F.col("_n") - F.col("_s") - F.col("_b")).alias("mixed_unknown"),
        F.count(F.when(F.col("_s") >= min_names, 1)).alias("honest_days"))


def coverage_by_factor(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per factor: share of missing values, and smallest and median number of names per day."""
    melted = df.select("data_date", F.explode(F.array(*[
        F.struct(F.lit(c).alias("factor"), F.col(c).isNotNull().cast("int").alias("known"))
        for c in columns])).alias("_e")).select("data_date", "_e.factor", "_e.known")
    day = melted.groupBy("factor", "data_date").agg(
        F.sum("known").alias("_k"), F.count(F.lit(1)).alias("_n"))
    mid = order_stats.quantiles(day, ["factor"], "_k", {"median_names": 0.5}).drop("_n")
    agg = day.groupBy("factor").agg(
        ratio(F.sum(F.col("_n") - F.col("_k")), F.sum("_n")).alias("missing_rate"),
        F.min("_k").alias("min_names"), F.count(F.lit(1)).alias("days"))
    return agg.join(mid, "factor")


def select_version(df: DataFrame, current: str, version: str = "config_version") -> DataFrame:
    """Rows of the current configuration if any exist, else of the version with most rows."""
    counts = df.groupBy(version).agg(F.count(F.lit(1)).alias("_c"))
    best = counts.agg(F.max_by(version, F.struct((F.col(version) == current), F.col("_c"))))
    return df.where(F.col(version) == best.scalar())


def score_table(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Mean and count of ``value`` for every row x column class."""
    return df.groupBy(row, column).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def weights_frame(ics: DataFrame, config: Mapping[str, float]) -> DataFrame:
    """(scheme, factor, weight): configured, sign of the train IC, train IC itself."""
    cfg = F.create_map(*[F.lit(x) for kv in config.items() for x in kv])
    ic = F.coalesce(F.col("ic"), F.lit(0.0))
    return ics.select("factor", F.explode(F.array(
        F.struct(F.lit("config").alias("scheme"), F.element_at(cfg, F.col("factor")).alias("weight")),
        F.struct(F.lit("sign").alias("scheme"), F.signum(ic).alias("weight")),
        F.struct(F.lit("train_ic").alias("scheme"), ic.alias("weight")))).alias("_w")
    ).select("_w.scheme", "factor", "_w.weight")
