"""Running state over event time: rows of a key wait until the watermark has passed them and are then taken in order.

Batches may bring rows in any order within the watermark's delay; what leaves equals the batch result. A key's state
ends by an event-time timer, so state holds open days only. These operators keep timers and lists, which the RocksDB
state store offers (:func:`state_store`).
"""
from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

DAY_MS = 86_400_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries started inside use the state store that knows timers and lists, in ``partitions`` parts (the session's
    shuffle partitions if not given). A query keeps its number for life, so choose it by the keys it will hold."""
    wanted = {_PROVIDER: _ROCKSDB} | ({_PARTITIONS: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _schema(*specs: str) -> pa.Schema:
    fields = [c.strip().split(" ") for spec in specs for c in spec.split(",")]
    return pa.schema([(name, _ARROW[kind]) for name, kind in fields])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(packed))).read_all()


def in_parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` grouped by ``part``, a hash of ``keys``: eight parts for each of the state store's."""
    parts = 8 * int(rows.sparkSession.conf.get(_PARTITIONS))
    return rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).groupBy("part")


class InOrder(StatefulProcessor):
    """``fold`` sees the rows of a key in the order of ``ms``, each once, when the watermark has reached them.

    ``row`` and ``kept`` are the schemas of waiting rows (``ms`` first: when the row is complete) and of the carried
    values, ``keys`` that of the key. What waits per key is bounded by the clock: the rows within the watermark's delay.

    Spark's groups are parts of many keys (:func:`in_parts`). A part has one frame of waiting rows per batch, one of
    carried values and one timer for all its keys, so calls to the state store follow parts and batches, not keys.
    """
    keys: str
    row: str
    kept: str

    @abstractmethod
    def fold(self, rows: dict[str, np.ndarray], carry: tuple | None) -> tuple[dict[str, np.ndarray], tuple]:
        """Output columns of the rows of one key, and the values to carry on."""

    @abstractmethod
    def ends(self, last_ms: int) -> int:
        """When the carried values of a key are of no more use."""

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.rows_schema, self.kept_schema = _schema(self.row, self.keys), _schema(self.keys, "until long", self.kept)
        self.key_names = _schema(self.keys).names
        self.waiting = handle.getListState("waiting", "frame binary")
        self.carried = handle.getValueState("carried", "frame binary")
        self.done: dict[tuple, int] = {}  # a part's timers that are due in one batch are served by the first

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame.loc[frame["ms"].notna(), self.rows_schema.names]
            if len(frame):
                self.waiting.appendValue((_packed(pa.Table.from_pandas(frame, self.rows_schema, preserve_index=False)),))
                self.handle.registerTimer(int(frame["ms"].min()))
        return iter([])

    def _carried(self) -> dict[tuple, tuple]:
        if not self.carried.exists():
            return {}
        columns = [c.to_pylist() for c in _unpacked(self.carried.get()[0]).columns]
        n = len(self.key_names)
        return dict(zip(zip(*columns[:n]), zip(*columns[n:])))

    def _carry(self, held: dict[tuple, tuple]) -> None:
        if held:
            columns = zip(*((*k, *v) for k, v in held.items()))
            arrays = [pa.array(c, f.type) for c, f in zip(columns, self.kept_schema)]
            self.carried.update((_packed(pa.Table.from_arrays(arrays, schema=self.kept_schema)),))
        elif self.carried.exists():
            self.carried.clear()

    def _taken(self, now: int) -> tuple[pa.Table | None, pa.Table | None]:
        """(rows that are due, rows that go on waiting)."""
        if not self.waiting.exists():
            return None, None
        rows = pa.concat_tables([_unpacked(x[0]) for x in self.waiting.get()])
        due = pc.less_equal(rows["ms"], now)
        ready, later = rows.filter(due), rows.filter(pc.invert(due))
        if not len(later):
            self.waiting.clear()
        elif len(ready):
            self.waiting.put([(_packed(later),)])
        return ready, later

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.done.get(key) == now:
            return
        self.done[key] = now
        ready, later = self._taken(now)
        held = self._carried()
        out = None
        if ready is not None and len(ready):
            out = self._folded(ready.to_pandas(), held)
        waits = set() if later is None else set(zip(*(later[c].to_pylist() for c in self.key_names)))
        held = {k: v for k, v in held.items() if v[0] > now or k in waits}
        self._carry(held)
        times = [v[0] for v in held.values() if v[0] > now] + ([pc.min(later["ms"]).as_py()] if waits else [])
        if times:
            self.handle.registerTimer(min(times))
        if out is not None:
            yield out

    def _folded(self, rows: pd.DataFrame, held: dict[tuple, tuple]) -> pd.DataFrame:
        """Output of all keys of the rows; ``held`` gets what they carry on."""
        code = rows.groupby(self.key_names, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((rows["ms"].to_numpy(), code))  # rows of one time stay as they came
        columns = {c: rows[c].to_numpy()[order] for c in self.rows_schema.names}
        starts = np.concatenate(([0], np.flatnonzero(np.diff(code[order])) + 1, [len(rows)]))
        names = [[None if pd.isna(v) else v for v in columns[c][starts[:-1]]] for c in self.key_names]
        parts: list[dict[str, np.ndarray]] = []
        sizes = []
        for k, a, b in zip(zip(*names), starts, starts[1:]):
            before = held.get(k)
            part, carry = self.fold({c: v[a:b] for c, v in columns.items()}, None if before is None else before[1:])
            held[k] = (self.ends(int(columns["ms"][b - 1])), *carry)
            parts.append(part)
            sizes.append(len(next(iter(part.values()))))
        out = {c: np.repeat(np.array(v, object), sizes) for c, v in zip(self.key_names, names)}
        return pd.DataFrame(out | {c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    def close(self) -> None:
        pass


# --- running delta, position and cost -------------------------------------------------------------

def affine(a: np.ndarray, b: np.ndarray, start: float) -> np.ndarray:
    """x[i] = a[i] * x[i - 1] + b[i] with x[-1] = start, by doubling steps."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:], a[step:] = a[step:] * b[:-step] + b[step:], a[step:] * a[:-step]
        step *= 2
    return a * start + b


def position_cost(delta: np.ndarray, price: np.ndarray, position: float, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Position and average cost after each bar: buys re-average, sells keep the cost, nothing held has none (NaN)."""
    total = position + np.cumsum(delta)
    held = total - np.minimum.accumulate(np.minimum(total, 0.0))
    before = np.concatenate(([position], held[:-1]))
    buy = delta > 0
    keep = np.where(buy, np.divide(before, held, out=np.zeros_like(held), where=held > 0), 1.0)
    paid = np.where(buy, (1.0 - keep) * np.where(buy, price, 0.0), 0.0)
    average = affine(keep, paid, 0.0 if position <= 0 else cost)
    return held, np.where(held > 0, average, np.nan)


class _Running(InOrder):
    keys = "symbol string, data_date string"
    row = "ms long, start long, close double, delta long, vwap double"
    kept = "cvd long, position double, cost double"

    def fold(self, rows: dict[str, np.ndarray], carry: tuple | None) -> tuple[dict[str, np.ndarray], tuple]:
        cvd, position, cost = carry or (0, 0.0, 0.0)
        delta = rows["delta"]
        run = cvd + np.cumsum(delta)
        held, average = position_cost(delta.astype(float), rows["vwap"].astype(float), position, cost)
        out = {"start_ms": rows["start"], "close": rows["close"], "delta": delta, "cvd": run, "position": held, "cost": average}
        return out, (int(run[-1]), float(held[-1]), 0.0 if np.isnan(average[-1]) else float(average[-1]))

    def ends(self, last_ms: int) -> int:
        return (last_ms // DAY_MS + 1) * DAY_MS


def running_state(bars: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Running delta, position and average cost per symbol-day over closed bars of a stream.

    ``bars`` carries a watermark on some column. A bar leaves when the watermark reaches its end; the state of a
    symbol-day goes when the watermark reaches the end of the day (in UTC).
    """
    keyed = bars.select("*", F.unix_millis(end).alias("ms"), F.unix_millis(start).alias("__start")).withColumn(
        "data_date", F.to_date(F.col(start)).cast("string")).withColumn("symbol", F.col("symbol").cast("string"))
    timed = [c for c in bars.columns if c not in ("symbol", "close", "delta", "vwap", "data_date")]
    rows = keyed.select("symbol", "data_date", "ms", F.col("__start").alias("start_of"), "close", "delta", "vwap", *timed)
    rows = rows.withColumnRenamed(start, "__s").withColumnRenamed("start_of", "start")
    out = in_parts(rows, ["symbol", "data_date"]).transformWithStateInPandas(
        _Running(), "symbol string, data_date string, start_ms long, close double, delta long, cvd long, position double, cost double",
        "append", "EventTime")
    return out.select("symbol", F.col("data_date").cast("date").alias("data_date"), F.timestamp_millis("start_ms").alias("start"),
                      "close", "delta", "cvd", "position", F.when(~F.isnan("cost"), F.col("cost")).alias("cost"))


# --- changes of action ----------------------------------------------------------------------------

class _Changes(InOrder):
    keys = "symbol string"
    row = "ms long, day long, action string, chip_score double"
    kept = "day long, action string"

    def __init__(self, lookback: int) -> None:
        self.lookback = lookback

    def fold(self, rows: dict[str, np.ndarray], carry: tuple | None) -> tuple[dict[str, np.ndarray], tuple]:
        days, action = rows["day"], rows["action"]
        day, last = carry or (days[0], None)
        near = days - np.concatenate(([day], days[:-1])) <= self.lookback
        prev = np.concatenate((np.array([last], object), action[:-1]))
        prev[~near] = None
        changed = prev != action
        changed |= prev == None  # noqa: E711
        out = {"day": days, "action": action, "prev_action": prev, "chip_score": rows["chip_score"]}
        return {c: v[changed] for c, v in out.items()}, (int(days[-1]), action[-1])

    def ends(self, last_ms: int) -> int:
        return last_ms + (self.lookback + 1) * DAY_MS


def action_changes(snapshots: DataFrame, lookback_days: int, wanted: list[str], time: str) -> DataFrame:
    """Snapshot stream to alerts: a symbol's action differs from its previous one in the look-back.

    ``time`` is the watermarked time column of the snapshots. One row per symbol and day; the previous action is
    forgotten when the look-back has passed it.
    """
    rows = snapshots.select(F.col("symbol").cast("string").alias("symbol"), F.unix_millis(time).alias("ms"),
                            F.unix_date("data_date").cast("long").alias("day"), "action", "chip_score", time)
    out = in_parts(rows, ["symbol"]).transformWithStateInPandas(
        _Changes(lookback_days), "symbol string, day long, action string, prev_action string, chip_score double", "append", "EventTime")
    return out.select("symbol", F.date_from_unix_date(F.col("day").cast("int")).alias("data_date"), "action", "prev_action",
                      "chip_score").where(F.col("action").isin(wanted))


# --- feature bars ---------------------------------------------------------------------------------

class _Features(InOrder):
    """Bars with their size histograms, and depth; carries the day's histogram and the sums behind its z-scores."""
    keys = "symbol string, data_date string"
    row = ("ms long, start long, open double, high double, low double, close double, volume long, trades long, buy_volume long, "
           "sell_volume long, turnover double, sizes array<long>, counts array<long>, bought array<long>, sold array<long>, "
           "obi double")
    kept = ("cvd long, close double, bars long, volume_sum double, volume_squares double, return_sum double, "
            "return_squares double, sizes array<long>, counts array<long>")

    def __init__(self, seconds: int, q: float, min_samples: int, eps: float) -> None:
        self.seconds, self.q, self.min_samples, self.eps = seconds, q, min_samples, eps

    def fold(self, rows: dict[str, np.ndarray], carry: tuple | None) -> tuple[dict[str, np.ndarray], tuple]:
        cvd, last, bars, vs, vq, rs, rq, old_sizes, old_counts = carry or (0, None, 0, 0.0, 0.0, 0.0, 0.0, [], [])
        delta = rows["buy_volume"] - rows["sell_volume"]
        run = cvd + np.cumsum(delta)
        volume, close, m = rows["volume"].astype(float), rows["close"].astype(float), len(rows["ms"])
        prev = np.concatenate(([close[0] if last is None else last], close[:-1]))
        ret = np.divide(close - prev, prev, out=np.zeros_like(close), where=prev != 0)
        n = bars + np.arange(1, m + 1)
        sums = [s + np.cumsum(x) for s, x in ((vs, volume), (vq, volume ** 2), (rs, ret), (rq, ret ** 2))]
        z = lambda x, s, sq: (x - s / n) / (np.sqrt(np.maximum(sq / n - (s / n) ** 2, 0.0)) + 1e-9)
        vz, rz = z(volume, sums[0], sums[1]), z(ret, sums[2], sums[3])
        score = np.where(vz > 0, vz / (np.abs(rz) + self.eps), 0.0)
        # the day's size histogram after each bar, over the sizes seen so far
        bar = np.repeat(np.arange(m), [len(x) for x in rows["sizes"]])
        flat = {c: np.concatenate([np.asarray(x, np.int64) for x in rows[c]]) for c in ("sizes", "counts", "bought", "sold")}
        sizes, place = np.unique(np.concatenate((np.asarray(old_sizes, np.int64), flat["sizes"])), return_inverse=True)
        table = np.zeros((m + 1, len(sizes)), np.int64)
        table[0, place[:len(old_sizes)]] = old_counts
        table[bar + 1, place[len(old_sizes):]] = flat["counts"]
        so_far = table.cumsum(0)[1:]
        total = so_far.sum(1)
        rank = np.maximum(1, np.ceil(self.q * total)).astype(np.int64)
        at = (so_far.cumsum(1) >= rank[:, None]).argmax(1)
        threshold = np.where(total >= self.min_samples, sizes[at], np.iinfo(np.int64).max)
        big = flat["sizes"] >= threshold[bar]
        large = {c: np.bincount(bar, np.where(big, flat[c], 0), m).astype(np.int64) for c in ("bought", "sold")}
        known = total >= self.min_samples
        out = {
            "start_ms": rows["start"], "open": rows["open"], "high": rows["high"],
            "low": rows["low"], "close": close, "volume": rows["volume"], "buy_volume": rows["buy_volume"],
            "sell_volume": rows["sell_volume"], "delta": delta, "cvd": run, "trade_count": rows["trades"],
            "avg_trade_size": volume / rows["trades"], "large_step": np.where(known, sizes[at], -1),
            "large_buy_volume": large["bought"], "large_sell_volume": large["sold"],
            "large_trade_delta": large["bought"] - large["sold"], "obi": rows["obi"],
            "sell_absorption_score": np.where((delta < 0) & (rz >= 0), score, 0.0),
            "buy_absorption_score": np.where((delta > 0) & (rz <= 0), score, 0.0),
            "trade_speed": rows["trades"] / self.seconds, "vwap": rows["turnover"] / volume}
        kept = (int(run[-1]), float(close[-1]), int(n[-1]), *(float(s[-1]) for s in sums), sizes.tolist(), so_far[-1].tolist())
        return out, kept

    def ends(self, last_ms: int) -> int:
        return (last_ms // DAY_MS + 1) * DAY_MS


_FEATURES = ("symbol string, data_date string, start_ms long, open double, high double, low double, close double, volume long, "
             "buy_volume long, sell_volume long, delta long, cvd long, trade_count long, avg_trade_size double, large_step long, "
             "large_buy_volume long, large_sell_volume long, large_trade_delta long, obi double, sell_absorption_score double, "
             "buy_absorption_score double, trade_speed double, vwap double")


def size_step(size: Column, error: float) -> Column:
    """Step of a size on a geometric scale: values of a step differ from its middle by a share of ``error`` at most."""
    return F.ceil(F.log(size.cast("double")) / F.log(F.lit((1 + error) / (1 - error)))).cast("long")


def step_value(step: Column, error: float) -> Column:
    """The middle of a step."""
    g = (1 + error) / (1 - error)
    return 2 * F.pow(F.lit(g), step) / (g + 1)


def feature_bars(trades: DataFrame, depth: DataFrame, imbalance: Column, seconds: int = 60, q: float = 0.95, min_samples: int = 500,
                 error: float = 0.01, eps: float = 0.5) -> DataFrame:
    """Bars of a trade stream with flow, order-book, absorption and large-trade columns, one row per bar with a trade.

    ``trades`` (symbol, ts, seq, price, volume, side) and ``depth`` (symbol, ts, and what ``imbalance`` reads) carry
    watermarks on ``ts``. Both are folded to bars before they are joined on (symbol, bar), so neither a busy symbol
    nor a busy book makes pairs. Running values (delta, z-scores, the large-trade limit) use the day's bars up to and
    including the bar. The limit is the ``q`` quantile of the day's sizes so far, from counts on a geometric scale:
    its value is within a share of ``error`` of the exact quantile, and trades of the limit's step count as large.
    It is unknown, and nothing large, before ``min_samples`` trades. ``obi`` is NULL without depth in the bar.
    """
    at, side, volume = F.struct("ts", "seq"), F.col("side"), F.col("volume")
    window = F.window("ts", f"{seconds} seconds")
    fine = trades.groupBy("symbol", window.alias("w"), size_step(volume, error).alias("step")).agg(
        F.min(F.struct(at, "price")).alias("first"), F.max(F.struct(at, "price")).alias("last"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("trades"),
        F.sum(F.when(side > 0, volume).otherwise(0)).alias("bought"), F.sum(F.when(side < 0, volume).otherwise(0)).alias("sold"),
        F.sum(F.col("price") * volume).alias("turnover"))
    bars = fine.groupBy("symbol", "w").agg(
        F.min("first")["price"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max("last")["price"].alias("close"), F.sum("volume").alias("volume"), F.sum("trades").alias("trades"),
        F.sum("bought").alias("buy_volume"), F.sum("sold").alias("sell_volume"), F.sum("turnover").alias("turnover"),
        F.collect_list(F.struct("step", "trades", "bought", "sold")).alias("hist"))
    book = depth.groupBy("symbol", window.alias("w")).agg(F.avg(imbalance).alias("obi"))
    joined = bars.join(book, ["symbol", "w"], "left")
    rows = joined.select(
        F.col("symbol").cast("string").alias("symbol"), F.to_date("w.start").cast("string").alias("data_date"),
        F.unix_millis("w.end").alias("ms"), F.unix_millis("w.start").alias("start"), "open", "high", "low", "close", "volume", "trades",
        "buy_volume", "sell_volume", "turnover", F.col("hist.step").alias("sizes"), F.col("hist.trades").alias("counts"),
        F.col("hist.bought").alias("bought"), F.col("hist.sold").alias("sold"), "obi", F.window_time("w").alias("at"))
    out = in_parts(rows, ["symbol", "data_date"]).transformWithStateInPandas(
        _Features(seconds, q, min_samples, eps), _FEATURES, "append", "EventTime")
    limit = F.when(F.col("large_step") >= 0, step_value(F.col("large_step"), error))
    return out.select("symbol", F.col("data_date").cast("date").alias("data_date"), F.timestamp_millis("start_ms").alias("bucket"),
                      *[c.split(" ")[0] for c in _FEATURES.split(", ")[3:14]], limit.alias("large_limit"),
                      *[c.split(" ")[0] for c in _FEATURES.split(", ")[15:18]], F.when(~F.isnan("obi"), F.col("obi")).alias("obi"),
                      *[c.split(" ")[0] for c in _FEATURES.split(", ")[19:]])
