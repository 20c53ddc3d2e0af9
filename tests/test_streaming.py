"""State that ends, late rows, exactly-once commits, versioned days."""
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.sources.commits import CommitLog
from tapeworks.sources.versions import VersionConflict, VersionedDays
from tapeworks.streaming import bars as st
from tapeworks.streaming import ordered, replay
from tapeworks.streaming.ledger import AGAIN, BEHIND, NO_TIME, TickLedger

T0 = dt.datetime(2024, 3, 4, 9, 0)
TICK = "symbol string, data_date date, ts timestamp, seq long, price double, volume long, side int"


def tick(symbol, seq, minutes, price=10.0, volume=5, side=1):
    ts = None if minutes is None else T0 + dt.timedelta(minutes=minutes)
    return symbol, None if ts is None else ts.date(), ts, seq, price, volume, side


def cost_loop(rows, position=0.0, cost=math.nan):
    out = []
    for delta, price in rows:
        if delta > 0:
            cost = price if position <= 0 else (position * cost + delta * price) / (position + delta)
            position += delta
        elif delta < 0:
            position += delta
            if position <= 0:
                position, cost = 0.0, math.nan
        out.append((position, cost))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_position_and_cost_equal_a_loop(seed):
    rng = random.Random(seed)
    rows = [(rng.choice([-9, -3, 0, 2, 7]), rng.uniform(5, 20)) for _ in range(rng.randint(1, 200))]
    cut = rng.randint(0, len(rows))
    want = cost_loop(rows)
    delta, price = np.array([float(r[0]) for r in rows]), np.array([r[1] for r in rows])
    position, cost, got = 0.0, 0.0, []
    for part in (slice(0, cut), slice(cut, None)):  # carried from one part to the next
        if len(delta[part]):
            held, average = ordered.position_cost(delta[part], price[part], position, cost)
            position, cost = held[-1], 0.0 if np.isnan(average[-1]) else average[-1]
            got += list(zip(held, average))
    assert np.allclose(np.array(got), np.array(want), equal_nan=True)


def run(spark, folder, rows, start):
    df = spark.createDataFrame(rows, TICK + ", k int")
    replay.stage_slices(df, f"{folder}/in", F.col("k"))
    stream = replay.stream_slices(spark, f"{folder}/in", df.schema).drop("k")
    with ordered.state_store(spark):
        q = st.write_append(start(stream), f"{folder}/out", f"{folder}/ckpt").start()
        q.awaitTermination()
    return spark.read.parquet(f"{folder}/out"), q


def test_batches_out_of_order_give_the_day_in_order_and_state_ends(spark, tmp_path):
    rng = random.Random(1)
    rows, want = [], {}
    for symbol in "ab":
        for day in range(3):
            seen = []
            for k in range(12):
                side, price = rng.choice([-1, 0, 1]), float(rng.randint(8, 12))
                minute = day * 1440 + k * 7
                rows.append((*tick(symbol, len(rows), minute, price, 3, side), day + rng.randint(0, 1)))
                seen.append((3 * side, price))
            run_sum = np.cumsum([d for d, _ in seen])
            for k, ((held, cost), c) in enumerate(zip(cost_loop(seen), run_sum)):
                want[symbol, T0 + dt.timedelta(minutes=day * 1440 + k * 7)] = (c, held, cost)
    rows.append((*tick("end", 9999, 9 * 1440), 9))
    out, q = run(spark, str(tmp_path), rows, lambda s: ordered.running_state(st.bars(s, delay="2 days")))
    got = {(r.symbol, r.start): (r.cvd, r.position, math.nan if r.cost is None else r.cost) for r in out.collect()}
    assert got.keys() == want.keys()
    assert np.allclose(np.array([got[k] for k in want], float), np.array([want[k] for k in want], float), equal_nan=True)
    last = {o["operatorName"]: o["numRowsTotal"] for o in q.lastProgress["stateOperators"]}
    assert last["transformWithStateInPandasExec"] == 0  # every day has ended, nothing waits
    assert last["stateStoreSave"] == 1  # the open bar of the closing row


def test_action_changes_across_batches(spark, tmp_path):
    days = {"a": [(0, "BUY"), (3, "BUY"), (5, "HOLD"), (40, "HOLD")], "b": [(1, "AVOID"), (2, "BUY")]}
    rows = [(s, T0.date() + dt.timedelta(days=d), act, 1.0, T0 + dt.timedelta(days=d), (d + (s == "a")) % 3)
            for s, x in days.items() for d, act in x] + [("end", T0.date(), "HOLD", 0.0, T0 + dt.timedelta(days=400), 9)]
    df = spark.createDataFrame(rows, "symbol string, data_date date, action string, chip_score double, at timestamp, k int")
    replay.stage_slices(df, f"{tmp_path}/in", F.col("k"))
    s = replay.stream_slices(spark, f"{tmp_path}/in", df.schema).withWatermark("at", "60 days")
    with ordered.state_store(spark):
        q = st.write_append(ordered.action_changes(s, 10, ["BUY", "HOLD", "AVOID"], "at"), f"{tmp_path}/out", f"{tmp_path}/c").start()
        q.awaitTermination()
    got = {(r.symbol, (r.data_date - T0.date()).days, r.action, r.prev_action) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 0, "BUY", None), ("a", 5, "HOLD", "BUY"), ("a", 40, "HOLD", None), ("b", 1, "AVOID", None), ("b", 2, "BUY", "AVOID")}
    # only the closing row waits
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_state_calls_follow_parts_and_not_symbols(spark, tmp_path):
    rng = random.Random(4)
    rows, want = [], set()
    for symbol in [None, *(f"s{k}" for k in range(300))]:
        last = None
        for d in sorted(rng.sample(range(60), 3)):
            action = rng.choice(["BUY", "HOLD"])
            if last is None or d - last[0] > 10 or last[1] != action:
                want.add((symbol, d, action, last[1] if last and d - last[0] <= 10 else None))
            rows.append((symbol, T0.date() + dt.timedelta(days=d), action, 1.0, T0 + dt.timedelta(days=d), rng.randint(0, 2)))
            last = d, action
    rows.append(("end", T0.date(), "HOLD", 0.0, T0 + dt.timedelta(days=400), 9))
    df = spark.createDataFrame(rows, "symbol string, data_date date, action string, chip_score double, at timestamp, k int")
    replay.stage_slices(df, f"{tmp_path}/in", F.col("k"))
    s = replay.stream_slices(spark, f"{tmp_path}/in", df.schema).withWatermark("at", "90 days")
    with ordered.state_store(spark, 2):
        q = st.write_append(ordered.action_changes(s, 10, ["BUY", "HOLD"], "at"), f"{tmp_path}/out", f"{tmp_path}/c").start()
        q.awaitTermination()
    got = {(r.symbol, (r.data_date - T0.date()).days, r.action, r.prev_action) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) <= 4 * 16  # sixteen parts, a frame of each for each batch; 903 rows waited one by one before
    assert held[-1] == 1


def test_large_trade_limit_is_within_its_error(spark):
    rng = np.random.default_rng(3)
    sizes = np.maximum(1, rng.lognormal(4, 1.5, 3000).astype(int))
    for error in (0.01, 0.05):
        df = spark.createDataFrame([(int(v),) for v in sizes], "v long").select("v", ordered.size_step(F.col("v"), error).alias("s"))
        rows = df.select("v", "s", ordered.step_value(F.col("s"), error).alias("m")).collect()
        assert all(abs(r.m - r.v) <= error * r.v * (1 + 1e-9) for r in rows)
        steps = sorted(r.s for r in rows)
        for q in (0.5, 0.95):
            rank = max(1, math.ceil(q * len(steps)))
            g = (1 + error) / (1 - error)
            assert abs(2 * g ** steps[rank - 1] / (g + 1) - np.sort(sizes)[rank - 1]) <= error * np.sort(sizes)[rank - 1] * (1 + 1e-9)


def batch(spark, rows):
    return spark.createDataFrame(rows, TICK)


def test_outcomes_of_delivered_rows(spark, tmp_path):
    led = TickLedger(spark, str(tmp_path / "led"), delay=600)
    assert led.settle(batch(spark, [tick("a", 1, 0), tick("a", 2, 30), tick("a", 2, 30), tick("b", 3, None), tick("b", 4, 25)]), 0)
    # watermark: minute 20
    assert led.settle(batch(spark, [tick("a", 5, 19), tick("a", 6, 20), tick("b", 4, 25), tick("a", 1, 0), tick("b", 7, 90)]), 1)
    assert led.settle(batch(spark, [tick("b", 8, 79), tick("b", 9, 81), tick("b", 7, 90)]), 2)
    assert sorted(r.seq for r in led.read("ticks").collect()) == [1, 2, 4, 6, 7, 9]
    refused = sorted((r.seq, r.reason, r.copies, r.batch) for r in led.read("refused").collect())
    assert refused == [(1, BEHIND, 1, 1), (2, AGAIN, 1, 0), (3, NO_TIME, 1, 0), (4, AGAIN, 1, 1), (5, BEHIND, 1, 1), (7, AGAIN, 1, 2), (8, BEHIND, 1, 2)]
    assert [(r.symbols, r.ticks) for r in led.daily(5).collect()] == [(2, 6)]
    s = led.span("ticks").first()
    assert (s.days, s.first_date, s.last_date, s["rows"]) == (1, T0.date(), T0.date(), 6)


def test_batches_delivered_again_or_half_written_change_nothing(spark, tmp_path, monkeypatch):
    led = TickLedger(spark, str(tmp_path / "led"))
    rows = [tick("a", 1, 0), tick("b", 2, 1)]
    assert led.settle(batch(spark, rows), 0) and not led.settle(batch(spark, rows), 0)
    with monkeypatch.context() as m:  # dies between staging and commit
        m.setattr(CommitLog, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            led.settle(batch(spark, [tick("a", 3, 2)]), 1)
    again = TickLedger(spark, str(tmp_path / "led"))  # a new driver
    assert sorted(r.seq for r in again.read("ticks").collect()) == [1, 2]
    assert again.sweep() == 3  # what was staged: trades, refused rows, statistics
    assert again.settle(batch(spark, [tick("a", 3, 2)]), 1)
    assert sorted(r.seq for r in again.read("ticks").collect()) == [1, 2, 3]
    assert again.span("t").first()["rows"] == 3 and again.sweep() == 0


def test_a_stream_that_dies_in_the_sink_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    rows = [(*tick("a", k, k), k // 2) for k in range(6)]
    df = spark.createDataFrame(rows, TICK + ", k int")
    replay.stage_slices(df, f"{tmp_path}/in", F.col("k"))
    stream = replay.stream_slices(spark, f"{tmp_path}/in", df.schema).drop("k")
    led = TickLedger(spark, f"{tmp_path}/led")
    publish, calls = CommitLog.publish, []

    def once_lost(self, number, body):
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return publish(self, number, body)

    monkeypatch.setattr(CommitLog, "publish", once_lost)
    start = lambda: led.writer(stream, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="lost"):
        start()
    start()
    assert calls == [0, 1, 1, 2]
    assert sorted(r.seq for r in led.read("ticks").collect()) == list(range(6))


def test_a_number_is_given_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.numbers() == [] and log.publish(0, {"by": "first"}) and not log.publish(0, {"by": "second"})
    assert log.read(0) == {"by": "first"} and log.numbers() == [0]
    assert not [p for p in (tmp_path / "log" / "_commits").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


SNAP = "symbol long, data_date date, score double, reasons array<string>"
D = [dt.date(2024, 1, k) for k in (1, 2, 3)]


def test_versions_delete_then_upsert_and_readers_keep_theirs(spark, tmp_path):
    t = VersionedDays(spark, str(tmp_path / "v"), ["symbol", "data_date"])
    rows = lambda *r: spark.createDataFrame(list(r), SNAP)
    content = lambda v=None, **k: sorted((r.symbol, r.data_date.day, r.score, tuple(r.reasons)) for r in t.read(v, **k).collect())
    assert t.version() is None
    assert t.rewrite(rows((1, D[0], 1.0, ["x"]), (2, D[0], 2.0, []), (1, D[1], 3.0, ["y", "z"]), (3, D[2], 4.0, []))) == 0
    pinned = t.read(0)
    assert t.rewrite(rows((2, D[0], 9.0, ["n"]), (4, D[0], 5.0, [])), rows((1, D[0], 0.0, []), (2, D[0], 0.0, []), (8, D[1], 0.0, []))) == 1
    assert content() == [(1, 2, 3.0, ("y", "z")), (2, 1, 9.0, ("n",)), (3, 3, 4.0, ()), (4, 1, 5.0, ())]
    assert t.rewrite(rows().limit(0), rows((3, D[2], 0.0, []))) == 2  # a date can become empty
    assert content() == [(1, 2, 3.0, ("y", "z")), (2, 1, 9.0, ("n",)), (4, 1, 5.0, ())]
    assert content(0) == sorted((r.symbol, r.data_date.day, r.score, tuple(r.reasons)) for r in pinned.collect()) and len(content(0)) == 4
    assert [(r.symbol, r.data_date, r.version) for r in t.tombstones().orderBy("version").collect()] == [(1, D[0], 1), (3, D[2], 2)]
    files = lambda v: set(t.read(v, ["2024-01-03"]).inputFiles())
    assert files(0) == files(1)  # versions share the dates they did not touch


def test_a_rewrite_copies_only_the_new_rows(spark, tmp_path, monkeypatch):
    from tapeworks.sources import versions

    copies, write = [], versions.materialise
    monkeypatch.setattr(versions, "materialise", lambda df: copies.append(df.columns) or write(df))
    t = VersionedDays(spark, str(tmp_path / "v"), ["symbol", "data_date"])
    t.rewrite(spark.createDataFrame([(1, D[0], 1.0, []), (2, D[1], 2.0, []), (7, None, 7.0, [])], SNAP))
    t.rewrite(spark.createDataFrame([(1, D[0], 5.0, []), (8, None, 8.0, [])], SNAP))
    assert len(copies) == 4  # new rows and removed keys, of each; stored and merged rows were copied too before
    assert sorted((r.symbol, r.score) for r in t.read().collect()) == [(1, 5.0), (2, 2.0), (7, 7.0), (8, 8.0)]


def test_two_writers_of_a_version(spark, tmp_path, monkeypatch):
    t = VersionedDays(spark, str(tmp_path / "v"), ["symbol", "data_date"])
    first = spark.createDataFrame([(1, D[0], 1.0, [])], SNAP)
    t.rewrite(first)
    other = VersionedDays(spark, str(tmp_path / "v"), ["symbol", "data_date"])
    monkeypatch.setattr(other, "version", lambda: None)  # it read before the first version was there
    with pytest.raises(VersionConflict):
        other.rewrite(spark.createDataFrame([(5, D[0], 5.0, [])], SNAP))
    assert [r.symbol for r in t.read().collect()] == [1]
