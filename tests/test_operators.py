import random
import time
from datetime import date, datetime, timedelta
from pathlib import Path
from statistics import fmean

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.config import settings
from tapeworks.operators import (adjust, backtest, cross_section, filings, flows, joins, merge, order_stats, prefix,
                                 research, ticks)
from tapeworks.session import materialise

CFG = settings()
D0 = date(2026, 1, 5)


def days(n):
    return [D0 + timedelta(days=i) for i in range(n)]


def test_ranks_and_quantiles_match_numpy_under_heavy_ties(spark):
    rng = random.Random(1)
    # group "hot" holds most rows, a third of them one single value
    vals = [0.0] * 400 + [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 6) for _ in range(800)]
    rows = [("hot", v) for v in vals] + [("one", 3.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["v"]): r for r in order_stats.with_positions(df, ["k"], "v").collect()}
    arr = np.array(vals)
    for v in set(vals):
        r = got[("hot", v)]
        assert r["_below"] == (arr < v).sum() and r["_ties"] == (arr == v).sum() and r["_n"] == arr.size
    q = {r["k"]: r for r in order_stats.quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.99}).collect()}
    for name, p in (("a", 0.01), ("b", 0.5), ("c", 0.99)):
        assert q["hot"][name] == pytest.approx(np.quantile(arr, p), rel=1e-12)
    assert q["one"]["b"] == 3.5


def test_z_of_columns_equals_the_melted_z_and_shuffles_no_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), int(d), float(rng.normal()) if rng.random() > 0.1 else None, float(rng.choice([0.0, 1.0, 1e9, -3.0])),
             None if d else 7.0) for d in range(3) for s in range(700)] + [(None, 1, 5.0, 2.0, None), (9, None, 5.0, 2.0, 1.0)]
    columns = ["a", "b", "c"]
    wide = materialise(spark.createDataFrame(rows, "symbol int, day int, a double, b double, c double"))
    long = cross_section.melt(wide, ["symbol", "day"], columns)
    for q in (0.01, 0.0):
        want = {(r.symbol, r.day, r.factor): r.z for r in cross_section.winsor_z(long, ["day", "factor"], "value", "z", q).collect()}
        out = cross_section.winsor_z_columns(wide, "day", columns, q)
        got = {(r.symbol, r.day, c): r[c] for r in out.collect() for c in columns}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, rel=1e-9, abs=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # what is made per day goes to the rows, not the rows to it


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
    return {f for f in files if "/shuffle_" in f}


def test_a_written_step_gives_the_shuffle_files_before_it_back(spark):
    before = shuffle_files(spark)
    df = materialise(spark.range(1000).groupBy((F.col("id") % 50).alias("k")).count().join(spark.range(60).withColumnRenamed("id", "k").repartition(3), "k"))
    taken = shuffle_files(spark) - before
    assert materialise(df).count() == 50
    for _ in range(100):  # Spark deletes them in a thread of its own
        if not shuffle_files(spark) & taken:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) & taken


def test_rank_ic_leaves_its_result_only(spark):
    rng = np.random.default_rng(8)
    rows = [(d, float(rng.integers(9)), float(rng.normal())) for d in range(4) for _ in range(60)]
    df = materialise(spark.createDataFrame(rows, "data_date int, x double, y double"))
    folder = Path(df.inputFiles()[0].removeprefix("file:")).parents[1]
    before = {p.name for p in folder.iterdir()}
    out = research.rank_ic(df, ["data_date"], "x", "y", 20)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert len({p.name for p in folder.iterdir()} - before) == 1  # ranks, positions and values are deleted
    for r in out.collect():
        x, y = (np.array([row[k] for row in rows if row[0] == r.data_date]) for k in (1, 2))
        rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        assert r.ic == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_upsert_takes_a_row_from_one_aggregate(spark):
    old = spark.createDataFrame([(1, "a", 1.0, 5), (2, "b", None, 6)], "k int, x string, y double, z int")
    new = spark.createDataFrame([(2, None, 9.0, 7), (3, "c", 3.0, 8)], old.schema)
    out = merge.upsert(old, new, ["k"], update=["x", "y"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 1.0, 5), (2, None, 9.0, 6), (3, "c", 3.0, 8)]
    whole = merge.upsert(old, new, ["k"])
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("max_by") == 1  # one for each column before
    assert sorted(tuple(r) for r in whole.collect()) == [(1, "a", 1.0, 5), (2, None, 9.0, 7), (3, "c", 3.0, 8)]


def test_narrowed_quantiles_are_exact(spark):
    rng = np.random.default_rng(6)
    values = {0: rng.normal(size=4000), 1: rng.choice([-1.0, 0.0, 5.0], 500), 2: np.exp(rng.normal(size=300) * 9), 3: np.array([4.0])}
    df = materialise(spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [(0, None)], "k int, v double"))
    qs = {"a": 0.01, "b": 0.5, "c": 0.99}
    for r in order_stats.quantiles(df, ["k"], "v", qs, narrow=True).collect():
        assert r["_n"] == len(values[r["k"]])
        assert [r[n] for n in qs] == pytest.approx([float(np.quantile(values[r["k"]], q)) for q in qs.values()], rel=1e-12)
    r = order_stats.quantiles(df, [], "v", qs, narrow=True).first()
    assert [r[n] for n in qs] == pytest.approx([float(np.quantile(np.concatenate(list(values.values())), q)) for q in qs.values()], rel=1e-12)


def test_value_bucket_is_monotone(spark):
    vals = sorted({s * m * 2.0 ** e for s in (-1, 1) for e in (-3, 0, 1, 10) for m in (1.0, 1 - 2 ** -53, 1.5, 1.9999999)} | {0.0})
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    b = [r["b"] for r in df.select("v", order_stats.value_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert b == sorted(b)


def test_percentile_groups(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", 7.0)] * 4 + [("c", 1.0)], "g string, v double")
    out = order_stats.percentile_score(df, ["g"], "v", "p").collect()
    assert sorted(r["p"] for r in out if r["g"] == "a") == [10, 30, 50, 70, 90]
    assert {r["p"] for r in out if r["g"] in "bc"} == {50.0}


def test_winsor_z(spark):
    rng = random.Random(2)
    vals = [rng.gauss(0, 1) for _ in range(200)] + [1e6]
    df = spark.createDataFrame([("d", v) for v in vals] + [("e", 2.0)] * 3 + [("f", 1.0)], "k string, v double")
    out = cross_section.winsor_z(df, ["k"], "v", "z").collect()
    a = np.array(vals)
    lo, hi = np.quantile(a, [0.01, 0.99])
    w = np.clip(a, lo, hi)
    want = dict(zip(vals, np.clip((w - w.mean()) / w.std(), -5, 5)))
    for r in out:
        if r["k"] == "d":
            assert r["z"] == pytest.approx(want[r["v"]], abs=1e-9)
    assert {r["z"] for r in out if r["k"] == "e"} == {0.0}
    assert {r["z"] for r in out if r["k"] == "f"} == {None}


def test_chunked_sequences_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [("s", i // 7, i, rng.choice([None, rng.uniform(-1, 1)])) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, c int, i int, v double")
    run = {r["i"]: r["o"] for r in prefix.running_sum(df, ["k"], ["c"], ["i"], F.col("v"), "o").collect()}
    prev = {r["i"]: r["o"] for r in prefix.previous_value(df, ["k"], None, ["i"], "v", "o").collect()}
    last = {r["i"]: r["o"] for r in prefix.last_known(prefix.range_cut(df, ["k"], ["i"], 5), ["k"], ["_cut"], ["i"], "v", "o").collect()}
    total, known, peak, fall = 0.0, None, None, 0.0
    for _, _, i, v in rows:
        total += v or 0.0
        known = v if v is not None else known
        assert run[i] == pytest.approx(total)
        assert prev[i] == (rows[i - 1][3] if i else None)
        assert last[i] == known
        if v is not None:
            peak = total if peak is None else max(peak, total)
            fall = min(fall, total - peak)
    dd = prefix.max_drawdown(df, ["k"], ["c"], ["i"], "v").first()["max_drawdown"]
    assert dd == pytest.approx(fall)


def test_a_crowded_minute_is_spread(spark):
    """All trades of one symbol within one minute: many chunks, results as without any."""
    n = 40_000
    t = spark.range(0, n, 1, 7).select(
        F.lit("s").alias("symbol"), F.lit("2024-01-02").cast("date").alias("data_date"),
        F.timestamp_micros(F.lit(1_704_186_000_000_000) + F.col("id") % 1000).alias("ts"), F.col("id").alias("seq"),
        (100 + F.col("id") * 7919 % 13).cast("double").alias("price"), (1 + F.col("id") % 5).alias("volume"),
        (F.col("id") % 3 - 1).alias("side"), F.lit(None).cast("double").alias("bid_price"), F.lit(None).cast("double").alias("ask_price"))
    cut = prefix.range_cut(t, ["symbol", "data_date"], ["ts", "seq"], pieces=8)
    sizes = [r["count"] for r in cut.groupBy("_cut").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8
    order = sorted(range(n), key=lambda i: (i % 1000, i))
    price = [100.0 + i * 7919 % 13 for i in order]
    delta = np.cumsum([(i % 3 - 1) * (1 + i % 5) for i in order])
    run = {r["seq"]: r["cvd"] for r in prefix.running_sum(
        cut, ["symbol", "data_date"], ["_cut"], ["ts", "seq"], F.col("side") * F.col("volume"), "cvd").collect()}
    assert [run[i] for i in order] == delta.tolist()
    side = {r["seq"]: r["out"] for r in ticks.classify_side(t, "out").collect()}
    assert [side[i] for i in order] == [0, *np.sign(np.diff(price)).astype(int).tolist()]


def test_back_adjust_and_point_in_time_scale(spark):
    bars = spark.createDataFrame([("a", d, 100.0 if i < 2 else 90.0, 10.0) for i, d in enumerate(days(4))],
                                 "symbol string, data_date date, close double, volume double")
    acts = spark.createDataFrame([("a", days(4)[2], 0.9, 2.0), ("a", days(4)[3], None, None)],
                                 "symbol string, data_date date, adj_factor double, share_factor double")
    out = adjust.back_adjust(bars, acts, ["close"], ["volume"]).orderBy("data_date").collect()
    assert [r["adj_close"] for r in out] == pytest.approx([90, 90, 90, 90])
    assert [r["adj_volume"] for r in out] == pytest.approx([20, 20, 10, 10])
    c = [r["c"] for r in adjust.scale_to_date(bars, acts, {"c": "adj_factor"}).orderBy("data_date").collect()]
    assert c == pytest.approx([1, 1, 0.9, 0.9])


def _basis(spark, rows):
    df = spark.createDataFrame([("s", d, p, n) for d, (p, n) in zip(days(len(rows)), rows)],
                               "symbol string, data_date date, p double, n double")
    return [r["cost"] for r in flows.cost_basis(df, "p", "n").orderBy("data_date").collect()]


def test_cost_basis_hand_values(spark):
    assert _basis(spark, [(10.0, 100.0), (20.0, 100.0)]) == pytest.approx([10, 15])
    assert _basis(spark, [(10.0, 100.0), (12.0, -100.0)]) == [10.0, None]
    assert _basis(spark, [(10.0, 100.0), (12.0, -50.0)]) == pytest.approx([10, 10])
    assert _basis(spark, [(10.0, 100.0), (None, 50.0)]) == pytest.approx([10, 10])


def test_cost_basis_random_walk_equals_fold(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, round(rng.uniform(5, 20), 2)]), rng.choice([None, float(rng.randint(-60, 60))])) for _ in range(300)]
    pos, cost, want = 0.0, None, []
    for p, n in rows:
        if p is not None and n is not None:
            if n > 0:
                cost = p if pos <= 0 else (pos * cost + n * p) / (pos + n)
                pos += n
            elif n < 0:
                pos = max(0.0, pos + n)
                cost = cost if pos > 0 else None
        want.append(cost)
    for g, w in zip(_basis(spark, rows), want):
        assert (g is None) == (w is None) and (w is None or g == pytest.approx(w, rel=1e-9))


def test_divergence_with_missing_values(spark):
    closes = [100.0, None, 102.0, 97.0, None, 95.0, 94.0, 93.0, 92.0, 90.0, 89.0, 88.0]
    nets = [5.0, 1.0, None, 4.0, 3.0, 2.0, 6.0, 1.0, 2.0, 3.0, 4.0, 2.0]
    df = spark.createDataFrame([("s", d, c, n, 10.0) for d, c, n in zip(days(12), closes, nets)],
                               "symbol string, data_date date, close double, net double, volume double")
    r = flows.divergence(df, 11, CFG["divergence"]).orderBy("data_date").collect()[-1]
    cw, nw = closes[1:], nets[1:]
    xs, ys, prev = [], [], None
    for c, n in zip(cw, nw):
        if c is not None and prev is not None and n is not None:
            xs.append(c / prev - 1)
            ys.append(n)
        prev = c if c is not None else prev
    assert r["price_return"] == pytest.approx(88 / 102 - 1)
    assert r["flow_ratio"] == pytest.approx(sum(n for n in nw if n is not None) / 110)
    assert r["price_flow_corr"] == pytest.approx(np.corrcoef(xs, ys)[0, 1], abs=1e-9)
    assert r["status"] == "neutral"  # fewer than ten valid points
    r = flows.divergence(df, 12, {**CFG["divergence"], "min_points": 5}).orderBy("data_date").collect()[-1]
    assert r["status"] == "bullish_div"


def _ticks(spark, rows, day=D0):
    base = datetime(day.year, day.month, day.day, 9, 0)
    return spark.createDataFrame(
        [(s, day, base + timedelta(seconds=t), i, p, v, sd) for i, (s, t, p, v, sd) in enumerate(rows)],
        "symbol string, data_date date, ts timestamp, seq long, price double, volume long, side int")


def test_minute_bars_and_cvd(spark):
    t = _ticks(spark, [("a", 0, 10.0, 5, 1), ("a", 1, 10.0, 3, -1), ("a", 61, 10.5, 4, 1)])
    b = ticks.minute_bars(t).orderBy("minute").collect()
    assert [r["cvd"] for r in b] == [2, 6] and [r["trades"] for r in b] == [2, 1]
    assert ticks.order_flow(t, CFG).first()["cvd_final"] == 6


def test_equal_times_are_broken_by_arrival(spark):
    t = _ticks(spark, [("a", 0, 10.0, 1, 0), ("a", 0, 11.0, 1, 0), ("a", 0, 9.0, 1, 0)])
    assert ticks.minute_bars(t).first()["close"] == 9.0


def test_large_trades(spark):
    t = _ticks(spark, [("a", 0, 10.0, 1, -1)] * 1000 + [("a", 1, 10.0, 5000, 1)])
    r = ticks.large_trades(t).first()
    assert r["large_threshold"] == 1.0 and r["large_buy"] == 5000 and r["large_net"] > 0
    few = ticks.large_trades(_ticks(spark, [("a", 0, 10.0, 1, -1)] * 10)).first()
    assert few["large_threshold"] is None and few["large_net"] == 0


def test_price_efficiency_and_side(spark):
    up = _ticks(spark, [("a", 60 * i, 10.0 + i, 1, 1) for i in range(5)] + [("b", 60 * i, 10.0 + i % 2, 1, 1) for i in range(5)])
    r = {x["symbol"]: x for x in ticks.bar_signals(ticks.minute_bars(up)).collect()}
    assert r["a"]["price_efficiency"] == 1.0 and r["b"]["price_efficiency"] == 0.0
    q = spark.createDataFrame([(10.0, 9.0, 10.0, None), (9.0, 9.0, 10.0, None), (9.5, None, None, 9.4), (9.5, None, None, 9.6),
                               (9.5, None, None, None)], "p double, b double, a double, prev double")
    got = [x["s"] for x in q.select(ticks.quote_side(F.col("p"), F.col("b"), F.col("a"), F.col("prev")).alias("s")).collect()]
    assert got == [1, -1, 1, -1, 0]


def test_batch_repair(spark):
    rows = [("a", 0, 10.0, 1, 1), ("a", 1, 11.0, 2, 1)] * 2 + [("b", 0, 10.0, 1, 1)] * 2 + [("b", 1, 10.0, 1, 1)]
    out = ticks.repair_batches(_ticks(spark, rows))
    assert {r["symbol"]: r["count"] for r in out.groupBy("symbol").count().collect()} == {"a": 2, "b": 3}


def test_newey_west(spark):
    rng = np.random.default_rng(5)
    iid = rng.normal(0.02, 0.1, 400)
    smooth = np.convolve(iid, np.ones(20) / 20, "valid")
    rows = [("iid", d, float(v)) for d, v in zip(days(400), iid)] + [("ma", d, float(v)) for d, v in zip(days(400), smooth)] + [("x", D0, 0.1)]
    df = spark.createDataFrame(rows, "k string, data_date date, v double")
    r = {x["k"]: x for x in research.newey_west(df, ["k"], "v", 19, 19).collect()}
    for k, a in (("iid", iid), ("ma", smooth)):
        d, n = a - a.mean(), a.size
        var = d @ d / n + sum(2 * (1 - i / 20) * (d[i:] @ d[:-i]) / n for i in range(1, 20))
        assert r[k]["t_nw"] == pytest.approx(a.mean() / np.sqrt(var / n), rel=1e-9)
    assert r["ma"]["t_nw"] < 0.6 * r["ma"]["t_naive"]
    assert r["x"]["t_nw"] is None


def test_rank_ic_with_ties(spark):
    df = spark.createDataFrame([(D0, float(i // 2), float(-i)) for i in range(10)] + [(days(2)[1], 1.0, float(i)) for i in range(10)],
                               "data_date date, x double, y double")
    out = research.rank_ic(df, ["data_date"], "x", "y", 5).collect()
    assert len(out) == 1  # the constant day has no IC
    rx, ry = np.repeat([1.5, 3.5, 5.5, 7.5, 9.5], 2), np.arange(10, 0, -1)
    assert out[0]["ic"] == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def _bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, data_date date, open double, high double, low double, close double")


def test_entry_is_next_market_day_or_nothing(spark):
    d = days(4)
    rows = [("a", x, 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i) for i, x in enumerate(d)]
    rows += [("halted", d[0], 5.0, 5.0, 5.0, 5.0), ("halted", d[3], 6.0, 6.0, 6.0, 6.0)]
    sig = spark.createDataFrame([("a", d[0], 70.0), ("halted", d[0], 70.0), ("a", d[3], 70.0)], "symbol string, data_date date, score double")
    cfg = {**CFG["backtest"], "horizons": [1, 3, 5]}
    out = backtest.outcomes(sig, _bars(spark, rows), cfg).orderBy("horizon").collect()
    assert [(r["symbol"], r["entry_date"], r["horizon"]) for r in out] == [("a", d[1], 1), ("a", d[1], 3)]
    assert out[0]["entry_price"] == 11.0 and out[0]["gross"] == pytest.approx(1 / 11)
    assert out[1]["mfe"] == pytest.approx(15 / 11 - 1) and out[1]["mae"] == pytest.approx(10 / 11 - 1)


def test_return_stats(spark):
    nets = [0.1, -0.05, 0.02, -0.08, 0.03]
    df = spark.createDataFrame([("k", f"s{i}", x, n, 0.1, -0.1) for i, (x, n) in enumerate(zip(days(5), nets))],
                               "g string, symbol string, data_date date, net double, mfe double, mae double")
    r = backtest.return_stats(df, ["g"]).first()
    a = np.array(nets)
    eq = np.cumsum(a)
    assert r["win_rate"] == 0.6 and r["median_return"] == 0.02
    assert r["profit_factor"] == pytest.approx(0.15 / 0.13)
    assert r["max_drawdown"] == pytest.approx((eq - np.maximum.accumulate(eq)).min())
    assert r["sharpe"] == pytest.approx(a.mean() / a.std(ddof=1))
    assert r["sortino"] == pytest.approx(fmean(nets) / np.std([-0.05, -0.08], ddof=1))


def test_upsert_semantics(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, "z", None), (3, "c", 3.0)], "k int, s string, v double")
    got = {r["k"]: (r["s"], r["v"]) for r in merge.upsert(old, new, ["k"], update=["v"]).collect()}
    assert got == {1: ("a", 1.0), 2: ("b", None), 3: ("c", 3.0)}
    twice = merge.upsert(merge.upsert(old, new, ["k"], update=["v"]), new, ["k"], update=["v"])
    assert {r["k"]: (r["s"], r["v"]) for r in twice.collect()} == got


def test_asof_and_previous(spark):
    left = spark.createDataFrame([("a", days(5)[i]) for i in (0, 2, 4)], "symbol string, data_date date")
    right = spark.createDataFrame([("a", days(5)[1], 1.0), ("a", days(5)[4], 2.0)], "symbol string, data_date date, v double")
    out = joins.asof_join(left, right, ["symbol"], ["v"]).orderBy("data_date").collect()
    assert [r["v"] for r in out] == [None, 1.0, 2.0]


AS_OF = "2026-03-31 15:00:00"


def _decl(spark, rows):
    cols = ("symbol string, data_date date, row_hash string, available_at timestamp, reporter_role string, reporter_name string, "
            "method_category string, planned_own_shares long, planned_trust_shares long, transfer_shares long, "
            "amends_report_date date, superseded_on date, ingestion_mode string")
    return spark.createDataFrame(rows, cols)


def _d(sym, day, h, own, amends=None, method="market", at=None, official=None, superseded=None):
    return (sym, day, h, at or datetime(day.year, day.month, day.day, 8) + timedelta(days=1), "董事", "甲", method, own, 0, official,
            amends, superseded, "forward")


def test_amendments(spark):
    a, b = date(2026, 3, 2), date(2026, 3, 10)
    rows = [
        _d("uniq", a, "1", 100), _d("uniq", b, "2", 150, amends=a),
        _d("ambig", a, "3", 100), _d("ambig", a, "4", 70), _d("ambig", b, "5", 150, amends=a),
        _d("orphan", b, "6", 10, amends=a),
        _d("gift", a, "7", 100), _d("gift", b, "8", 100, amends=a, method="gift"),
        _d("late", a, "9", 100), _d("late", b, "A", 1, amends=a, at=datetime(2026, 4, 2)),
        _d("bad", a, "B", 100, official=90), _d("sup", a, "C", 100, superseded=b),
        _d("unknown", a, "D", None), _d("unknown", b, "E", 5),
    ]
    out = {r["symbol"]: r for r in filings.resolve_transfers(_decl(spark, rows), F.lit(AS_OF).cast("timestamp")).collect()}
    assert out["uniq"]["shares"] == 150
    assert out["ambig"]["shares"] is None and out["ambig"]["ambiguous"]
    assert out["orphan"]["shares"] is None and out["orphan"]["listed"]
    assert not out["gift"]["listed"]
    assert out["late"]["shares"] == 100  # the amendment is not visible yet
    assert out["bad"]["shares"] is None and out["bad"]["inconsistent"]
    assert not out["sup"]["listed"]
    assert out["unknown"]["shares"] is None


def test_holding_features(spark):
    cols = ("symbol string, data_date date, source string, report_date date, available_at timestamp, title string, holder_name string, "
            "current_shares long, pledged_shares long, ingestion_mode string")
    jan, feb = date(2026, 1, 31), date(2026, 2, 28)
    t1, t2 = datetime(2026, 2, 21, 8), datetime(2026, 3, 21, 8)

    def row(m, at, name, cur, pl=0, title="董事", rep=None, mode="forward"):
        return ("s", m, "openapi", rep or date(2026, 2, 20), at, title, name, cur, pl, mode)

    rows = [row(jan, t1, "x", 100, 10), row(jan, t1, "x", 100, 10, title="大股東"), row(jan, t1, "y", 50),
            row(feb, t2, "x", 120, 30, title="大股東"), row(feb, t2, "z", 80),
            row(feb, datetime(2026, 4, 10), "x", 1, 1, rep=date(2026, 4, 9))]
    df = spark.createDataFrame(rows, cols)
    target, as_of = F.lit("2026-03-31").cast("date"), F.lit(AS_OF).cast("timestamp")
    r = filings.holding_features(df, target, as_of).first()
    assert (r["holding_month"], r["total"], r["holding_provenance"]) == (feb, 200, "point_in_time_safe")
    assert r["change_pct"] == pytest.approx(0.2) and r["major_change_pct"] == pytest.approx(0.2)
    assert r["pledge_ratio"] == pytest.approx(0.15) and r["pledge_ratio_change"] == pytest.approx(0.15 - 10 / 150)
    stale = filings.holding_features(df, F.lit("2026-06-30").cast("date"), F.lit("2026-03-31 15:00:00").cast("timestamp"))
    assert stale.count() == 0


def test_cost_basis_survives_many_full_turnovers(spark):
    rows, position, cost, want = [], 0.0, None, []
    for k in range(400):
        net, price = (1, 10.0) if k == 0 else (999 if k % 2 else -999, 10.0 + k % 7 * 0.3)
        rows.append((k % 3, date(2023, 1, 1) + timedelta(days=k), price, net))
        if net > 0:
            cost = price if position <= 0 else (position * cost + net * price) / (position + net)
        position = max(0.0, position + net)
        cost = cost if position > 0 else None
        want.append(cost)
    df = spark.createDataFrame([("A", d, p, n) for _, d, p, n in rows], "symbol string, data_date date, p double, n long")
    got = [r["cost"] for r in flows.cost_basis(df, "p", "n").orderBy("data_date").collect()]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want))


def test_cost_basis_long_walk_equals_fold(spark):
    import random
    rng, position, cost, rows, want = random.Random(3), 0.0, None, [], []
    for k in range(5000):
        net, price = rng.randint(-900, 1000), rng.uniform(5, 500)
        rows.append(("A", date(2001, 1, 1) + timedelta(days=k), price, net))
        if net > 0:
            cost = price if position <= 0 else (position * cost + net * price) / (position + net)
        position = max(0.0, position + net)
        cost = cost if position > 0 else None
        want.append(cost)
    df = spark.createDataFrame(rows, "symbol string, data_date date, p double, n long")
    got = [r["cost"] for r in flows.cost_basis(df, "p", "n").orderBy("data_date").collect()]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9 * max(1, b)) for a, b in zip(got, want))


def test_ranks_with_infinity_nan_and_nulls(spark):
    values = [float("-inf"), -3.0, 0.0, 2.5, 2.5, 1e300, float("inf"), float("nan"), None, None]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    got = {r["id"]: r["r"] for r in order_stats.average_ranks(df, [], {"v": "r"}).collect()}
    assert [got[k] for k in range(10)] == [1, 2, 3, 4.5, 4.5, 6, 7, 8, None, None]
