"""Reports over scored tables: scanner, dashboard, heat tables, alerts, validation, coverage, panels."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numbers import LOT, ratio, rounded
from tapeworks.operators import adjust, backtest, flows, joins, order_stats, research, rolling
from tapeworks.plans.regime import regime_label
from tapeworks.session import discard, materialise

# Display order of divergence states.
STATUS_ORDER = ["bullish_div", "aligned_up", "neutral", "aligned_down", "bearish_div"]
ASCENDING_ACTIONS = ["AVOID", "EXIT", "REDUCE"]


def latest_date(df: DataFrame, date: str = "data_date") -> Column:
    """Newest date as a scalar subquery: no action, no join."""
    return df.agg(F.max(date)).scalar()


# --- scanner ---------------------------------------------------------------------------------

def scanner_filter(rows: DataFrame, *, keyword: str | None = None, min_score: float = 0,
                   max_score: float = 100, action: str | None = None, min_turnover: float = 0,
                   industry: str | None = None) -> DataFrame:
    """Optional filters; a zero or missing one is left out of the plan."""
    out = rows.where(F.col("chip_score").between(min_score, max_score))
    if min_turnover:
        out = out.where(F.col("turnover") >= min_turnover)
    if action:
        out = out.where(F.col("action") == action.upper())
    if industry:
        out = out.where(F.col("industry") == industry)
    if keyword and keyword.strip():
        k = keyword.strip().lower()
        out = out.where(F.lower(F.col("symbol").cast("string")).contains(k) | F.lower("name").contains(k))
    return out


def scanner_page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page by score; the total before paging comes from ``rows.count()`` at the caller."""
    return rows.orderBy(F.col("chip_score").desc(), "symbol").offset(offset).limit(limit)


def divergence_ranking(rows: DataFrame, status: str | None, min_turnover: float, limit: int) -> DataFrame:
    """Accumulation first; inside a state the stronger flow first."""
    out = rows.where(F.col("turnover") >= min_turnover)
    if status:
        out = out.where(F.col("status") == status)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status")), F.lit(3)) - 1
    flow = F.coalesce("flow_ratio", F.lit(0.0))
    return out.withColumn("status_rank", rank).orderBy(
        "status_rank", F.when(F.col("status_rank") <= 1, -flow).otherwise(flow), "symbol").limit(limit)


# --- dashboard and heat tables ----------------------------------------------------------------

def action_counts(rows: DataFrame, keys: Sequence[str] = ("action",)) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("chip_score"), 1).alias("avg_score"))


def dashboard(rows: DataFrame, market: DataFrame, futures: DataFrame | None = None, top: int = 10) -> DataFrame:
    """One row for the newest date: totals, action counts, top names, index change, front contract."""
    day = rows.where(F.col("data_date") == latest_date(rows))
    counts = day.groupBy("data_date").agg(
        F.count(F.lit(1)).alias("total"), rounded(F.avg("chip_score"), 1).alias("avg_score"),
        *[F.count(F.when(F.col("action") == a, 1)).alias(a.lower()) for a in ("BUY", "WATCH", "HOLD", "AVOID")])
    best = day.orderBy(F.col("chip_score").desc(), "symbol").limit(top).groupBy("data_date").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("chip_score")).alias("neg"), "symbol", "action"))).alias("_top"))
    w = Window.partitionBy(F.lit(1)).orderBy("data_date")
    prev = F.last("index_close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = market.withColumn("_prev", prev).withColumn("index_change", F.when(
        F.col("_prev") != 0, F.col("index_close") - F.col("_prev"))).select(
        "data_date", "index_close", rounded(F.col("index_change"), 2).alias("index_change"),
        rounded(ratio(F.col("index_change"), F.col("_prev")), 6).alias("index_change_pct"),
        "advancers", "decliners", "market_trend_score", regime_label(F.col("market_trend_score")).alias("regime"))
    out = counts.join(best, "data_date").join(m, "data_date", "left").withColumn(
        "top", F.transform("_top", lambda x: x["symbol"])).drop("_top")
    if futures is None:
        return out
    front = joins.best_per_key(futures, ["data_date"], "volume", "contract_month")
    return out.join(front.select("data_date", "contract_month", F.col("close").alias("futures_close")),
                    "data_date", "left")


def market_heat(rows: DataFrame, top: int, min_turnover: float = 0.0) -> DataFrame:
    """Largest names by turnover and the share of all turnover they cover."""
    total = rows.agg(F.sum("turnover")).scalar()
    picked = rows.where(F.col("turnover") >= min_turnover).orderBy(F.col("turnover").desc(), "symbol").limit(top)
    return picked.withColumn("covered", ratio(F.sum("turnover").over(Window.partitionBy(F.lit(1))), total))


def industry_matrix(features: DataFrame, stock: DataFrame, snapshots: DataFrame | None, days: int | None,
                    min_symbols: int, metrics: Mapping[str, str]) -> DataFrame:
    """Industry x date medians of each metric (output -> column), cells with enough members only."""
    f = features
    if days is not None:
        f = f.join(f.select("data_date").distinct().orderBy(F.col("data_date").desc()).limit(days),
                   "data_date", "left_semi")
    f = f.join(stock.where("industry IS NOT NULL").select("symbol", "industry"), "symbol")
    if snapshots is not None:
        f = f.join(snapshots, ["symbol", "data_date"], "left")
    cells = f.groupBy("industry", "data_date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_symbols)
    long = f.select("industry", "data_date", F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("v")) for name, c in metrics.items()
    ])).alias("_m")).select("industry", "data_date", "_m.metric", "_m.v")
    mid = order_stats.quantiles(long, ["industry", "data_date", "metric"], "v", {"m": 0.5})
    wide = mid.groupBy("industry", "data_date").agg(*[
        F.max(F.when(F.col("metric") == name, F.col("m"))).alias(name) for name in metrics])
    return cells.join(wide, ["industry", "data_date"], "left")


def industry_order(cells: DataFrame, by: str) -> DataFrame:
    """Per industry: largest membership and the newest day's value; unknown ones sink."""
    newest = latest_date(cells)
    agg = cells.groupBy("industry").agg(
        F.max("n").alias("n_max"), F.max(F.when(F.col("data_date") == newest, F.col(by))).alias("latest"))
    return agg.orderBy(F.col("latest").desc_nulls_last(), "industry")


def stock_heat(snapshots: DataFrame, days: int) -> DataFrame:
    """Newest ``days`` snapshots of every symbol; missing components stay NULL."""
    return joins.last_rows(snapshots, ["symbol"], days, "data_date")


# --- alerts -----------------------------------------------------------------------------------

def action_changes(snapshots: DataFrame, actions: Sequence[str], lookback_days: int, min_turnover: float = 0.0,
                   turnover: str = "turnover") -> DataFrame:
    """Rows whose action is wanted and differs from the latest earlier one within the look-back.

    Works for all dates; filter one date on the result. Unknown turnover is kept.
    """
    hist = joins.previous_event(snapshots, ["symbol"], "action", lookback_days)
    new = hist.where(F.col("action").isin(*actions) & ~F.col("prev_action").eqNullSafe(F.col("action")))
    if min_turnover > 0:
        new = new.where(F.col(turnover).isNull() | (F.col(turnover) >= min_turnover))
    order = F.array_position(F.array(*[F.lit(a) for a in actions]), F.col("action"))
    extreme = F.when(F.col("action").isin(*ASCENDING_ACTIONS), F.col("chip_score")).otherwise(-F.col("chip_score"))
    return new.withColumn("action_order", order).withColumn("score_order", extreme)


# --- coverage ---------------------------------------------------------------------------------

def coverage_span(tables: Mapping[str, DataFrame], date: str = "data_date") -> DataFrame:
    """Days, first, last and row count per table; dates are folded first, so no distinct expansion."""
    out = None
    for name, df in tables.items():
        per_day = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
        one = per_day.agg(F.lit(name).alias("source"), F.count(date).alias("days"), F.min(date).alias("first_date"),
                          F.max(date).alias("last_date"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def tick_daily(ticks: DataFrame, days: int | None = None) -> DataFrame:
    """Symbols and trades per day: fold to (day, symbol) first, so a hot symbol combines map-side."""
    if days is not None:
        newest = ticks.select("data_date").distinct().orderBy(F.col("data_date").desc()).limit(days)
        ticks = ticks.join(newest, "data_date", "left_semi")
    return ticks.groupBy("data_date", "symbol").agg(F.count(F.lit(1)).alias("_n")).groupBy("data_date").agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("_n").alias("ticks"))


# --- validation -------------------------------------------------------------------------------

def forward_report(signals: DataFrame, bars: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    """Per horizon and score bucket: count, win rate, mean net return, with the horizon's IC statistics.

    ``signals`` holds symbol, data_date, score; ``bars`` adjusted OHLC without NULLs.
    """
    bt = cfg["backtest"]
    rows = materialise(backtest.outcomes(signals, bars, bt))  # read by the buckets and by both ranks
    stats = materialise(backtest.by_bucket(rows, bt["buckets"]).groupBy("horizon", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"),
        F.avg("net").alias("avg_net")))
    ics = research.rank_ic(rows, ["horizon", "data_date"], "score", "net", cfg["validation"]["min_names"])
    discard(rows)
    nw = research.newey_west(ics, ["horizon"], "ic", F.col("horizon") - 1, max(bt["horizons"]) - 1)
    return stats.join(nw.select("horizon", F.col("mean").alias("ic"), "t_naive", "t_nw",
                                F.col("n_days").alias("ic_days")), "horizon", "left")


def pending(signals: DataFrame, bars: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    """Signals that still wait for an entry day, and entries that wait for the shortest exit."""
    shortest = min(cfg["backtest"]["horizons"])
    last = latest_date(bars)
    waiting = signals.agg(F.count(F.when(F.col("data_date") >= last, 1)).alias("pending_entry"),
                          F.count(F.lit(1)).alias("total_signals"))
    entered = backtest.entry_bars(bars, [shortest], cfg["backtest"]["entry"])
    from tapeworks.operators.calendar import civil_next_day, market_calendar
    placed = signals.join(civil_next_day(market_calendar(bars)), "data_date").join(
        entered, ["symbol", "entry_date"])
    open_ = placed.agg(F.count(F.when(F.col(f"exit_{shortest}").isNull(), 1)))
    return waiting.withColumn("pending_exit", open_.scalar())


def adjusted_bars(prices: DataFrame, actions: DataFrame | None) -> DataFrame:
    """OHLC on one scale per symbol; bars with any missing price are dropped."""
    ohlc = ["open", "high", "low", "close"]
    full = prices.select("symbol", "data_date", *[F.col(c).cast("double").alias(c) for c in ohlc]).na.drop(
        subset=ohlc)
    if actions is None:
        return full
    adj = adjust.back_adjust(full, actions, ohlc)
    return adj.select("symbol", "data_date", *[F.col(f"adj_{c}").alias(c) for c in ohlc])


# --- price against flow -----------------------------------------------------------------------

def flow_panel(prices: DataFrame, institutional: DataFrame, actions: DataFrame | None,
               margin: DataFrame | None = None) -> DataFrame:
    """Aligned series per (symbol, date) on one scale: close and average price, net flows and volume in lots."""
    nets = ["foreign_net", "trust_net", "dealer_self_net", "dealer_hedge_net"]
    p = prices.join(institutional.select("symbol", "data_date", *nets), ["symbol", "data_date"], "left")
    if margin is not None:
        p = p.join(margin.select("symbol", "data_date", "margin_balance", "short_balance"),
                   ["symbol", "data_date"], "left")
    known = F.lit(False)
    for c in nets:
        known = known | F.col(c).isNotNull()
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in nets[1:]),
                F.coalesce(F.col(nets[0]).cast("double"), F.lit(0.0)))
    dealer_known = F.col(nets[2]).isNotNull() | F.col(nets[3]).isNotNull()
    p = p.withColumns({
        "close": F.col("close").cast("double"),
        "avg_price": flows.vwap(F.col("turnover"), F.col("volume"), F.col("close").cast("double")),
        "volume_lots": F.when(F.col("volume") != 0, F.col("volume") / LOT),
        "net": F.when(known, total / LOT), "foreign": F.col("foreign_net") / LOT, "trust": F.col("trust_net") / LOT,
        "dealer": F.when(dealer_known, (F.coalesce(F.col(nets[2]), F.lit(0)) + F.coalesce(
            F.col(nets[3]), F.lit(0))) / LOT),
    })
    if actions is None:
        return p
    scaled = adjust.back_adjust(p, actions, ["close", "avg_price"],
                                ["volume_lots", "net", "foreign", "trust", "dealer"])
    out = scaled
    for c in ("close", "avg_price", "volume_lots", "net", "foreign", "trust", "dealer"):
        out = out.withColumn(c, F.col(f"adj_{c}")).drop(f"adj_{c}")
    return out


def panel_summary(panel: DataFrame) -> DataFrame:
    """Tail sums of foreign and total flow, signed foreign streak and balance change, at every row."""
    w = rolling.series()
    f, n = F.col("foreign"), F.col("net")
    p = panel.withColumn("_sign", F.signum(f).cast("int")).withColumn("_start", rolling.run_start("_sign", w))
    p = p.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cols: dict[str, Column] = {}
    for k in (5, 20, 60):
        cols[f"foreign_{k}d"] = rolling.tail_sum(f, k, w)
        cols[f"inst_{k}d"] = rolling.tail_sum(n, k, w)
    if "margin_balance" in panel.columns:
        cols["margin_chg_20d"] = rolling.first_last_change(F.col("margin_balance"), 20, w)
    cols["foreign_cum"] = rolling.running(f, w)
    p = p.withColumns(cols)
    return p.withColumn("foreign_streak", rolling.signed_run("_sign", "_run")).drop("_sign", "_start", "_run")


def divergence_scan(panel: DataFrame, stock: DataFrame, cfg: Mapping[str, Any], window: int) -> DataFrame:
    """Newest market day, every symbol that traded on it: state, change, cost state, momentum percentile."""
    w = rolling.series()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = flows.divergence(panel, window, cfg["divergence"], volume="volume_lots")
    d = flows.cost_basis(d, "avg_price", "net")
    d = d.withColumns({
        "price": F.last("close", ignorenulls=True).over(so_far),
        "_prev": F.last("close", ignorenulls=True).over(before),
        "_paid": F.last(F.when(F.col("avg_price") > 0, F.col("avg_price")), ignorenulls=True).over(so_far)})
    d = d.where(F.col("data_date") == latest_date(panel))
    premium, state = flows.cost_state(F.col("cost"), F.col("_paid"), cfg["cost_basis"]["state_eps"])
    d = d.withColumn("change_pct", F.when((F.col("price") != 0) & (F.col("_prev") != 0), F.try_divide(
        F.col("price"), F.col("_prev")) - 1)).withColumn("premium_pct", premium).withColumn("cost_state", state)
    d = order_stats.share_at_or_below(d, ["data_date"], "price_return", "_share")
    return d.join(stock.select("symbol", "name"), "symbol", "left").select(
        "symbol", F.coalesce("name", F.col("symbol").cast("string")).alias("name"), "data_date", "price",
        "change_pct", F.coalesce(F.col("turnover").cast("double"), F.lit(0.0)).alias("turnover"), "status",
        "price_return", "flow_ratio", "inst_net", "price_flow_corr", "cost", "cost_state", "premium_pct",
        rounded(F.col("_share") * 100, 1).alias("mom_pct"))


def liquid_symbols(prices: DataFrame, min_median: float) -> DataFrame:
    """Symbols whose median turnover reaches the floor."""
    return order_stats.quantiles(prices, ["symbol"], "turnover", {"median_turnover": 0.5}).where(
        F.col("median_turnover") >= min_median).select("symbol", "median_turnover")


def divergence_study(panel: DataFrame, bars: DataFrame, cfg: Mapping[str, Any], window: int, step: int,
                     liquid: DataFrame | None = None) -> DataFrame:
    """(status, horizon, net) samples every ``step`` rows of every symbol with a full window and horizon."""
    max_h = max(cfg["backtest"]["horizons"])
    d = flows.divergence(panel, window, cfg["divergence"], volume="volume_lots")
    w = rolling.series()
    d = d.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    pick = ((F.col("_i") >= window - 1) & (F.col("_i") < F.col("_n") - max_h - 1)
            & ((F.col("_i") - (window - 1)) % step == 0) & (F.col("_n") >= window + max_h + 1))
    d = d.where(pick)
    if liquid is not None:
        d = d.join(liquid.select("symbol"), "symbol", "left_semi")
    signals = d.select("symbol", "data_date", "status", "flow_ratio")
    return backtest.outcomes(signals, bars, cfg["backtest"])


def status_table(samples: DataFrame) -> DataFrame:
    """Count, win rate, mean and median return per state and horizon."""
    agg = samples.groupBy("status", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"),
        F.avg("net").alias("avg_net"))
    mid = order_stats.quantiles(samples, ["status", "horizon"], "net", {"median_net": 0.5}).drop("_n")
    return agg.join(mid, ["status", "horizon"])


def bull_bear_spread(table: DataFrame) -> DataFrame:
    """Mean return of accumulation minus distribution, per horizon."""
    def mean(s: str) -> Column:
        return F.max(F.when(F.col("status") == s, F.col("avg_net")))
    return table.groupBy("horizon").agg((mean("bullish_div") - mean("bearish_div")).alias("spread"))


def event_window(actions: DataFrame, at: DataFrame, days: int = 45) -> DataFrame:
    """Actions of a symbol in the ``days`` before each (symbol, as_of), that date included.

    Every action is laid out on the dates it can affect, so the join is an equality, not a range.
    """
    spread = actions.withColumn("as_of", F.explode(F.sequence(
        F.col("data_date"), F.date_add("data_date", days - 1))))
    return spread.join(at.select("symbol", "as_of").distinct(), ["symbol", "as_of"])


def component_comparison(features: DataFrame, drop_columns: Sequence[str], score, marker: str) -> DataFrame:
    """Scores with and without one component group, side by side.

    ``score`` maps a features frame to a scored one; rows are split by whether ``marker`` is known.
    """
    base = features.withColumn("has_marker", F.col(marker).isNotNull())
    both = base.withColumn("variant", F.explode(F.array(F.lit("full"), F.lit("without"))))
    both = both.withColumns({c: F.when(F.col("variant") == "full", F.col(c)) for c in drop_columns})
    s = score(both)
    return s.groupBy("variant", "has_marker").agg(
        F.count(F.lit(1)).alias("n"), F.avg("chip_score").alias("avg_score"),
        F.count(F.when(F.col("chip_score") >= 75, 1)).alias("ge75"), F.avg("composite_raw").alias("avg_raw"))
