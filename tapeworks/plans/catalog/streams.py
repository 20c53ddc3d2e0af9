"""Streaming jobs run to the end of their input, next to their batch twins."""
import uuid

from pyspark.sql import functions as F

from tapeworks.functions.numbers import rounded
from tapeworks.operators import ticks as tk
from tapeworks.plans import views as V
from tapeworks.plans.catalog.registry import R, query
from tapeworks.session import shared_folder
from tapeworks.sources import landing
from tapeworks.streaming import bars as st
from tapeworks.streaming import ordered, replay
from tapeworks.streaming.ledger import TickLedger

WV = V.with_views


def _source(spark, sf):
    schema = V.table(spark, sf, "events").schema
    symbols = F.lit(V.n_tick_symbols(spark, sf).first()["n"])
    return V.tick_columns(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet"), symbols)


def _drain(spark, df):
    """Run until the input is used up and read the sink back."""
    base = f"{shared_folder(spark)}/tapeworks-stream-{uuid.uuid4().hex}"
    q = st.write_append(df, f"{base}/out", f"{base}/ckpt").start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


# closed bars only: the watermark trails the newest trade by two minutes
_CLOSED = "(SELECT max(ts) FROM ticks) - INTERVAL 2 MINUTE"
_BARS = """sb AS (SELECT symbol, date_trunc('minute', ts) AS start, arg_min(price, (ts, seq)) AS open, arg_max(price, (ts, seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume,
 count(*) AS trades, CAST(sum(side * volume) AS BIGINT) AS delta FROM ticks GROUP BY 1, 2)"""


@query("stream_minute_bars", WV("ticks") + f""", {_BARS}
SELECT symbol, start, {R("open", 2)} AS open, {R("close", 2)} AS close, volume, trades, delta FROM sb WHERE start + INTERVAL 1 MINUTE <= {_CLOSED}""")
def stream_minute_bars(spark, sf):
    b = _drain(spark, st.bars(_source(spark, sf)))
    return b.select("symbol", "start", rounded(F.col("open"), 2).alias("open"), rounded(F.col("close"), 2).alias("close"), "volume", "trades", "delta")


@query("stream_sliding_bars", WV("ticks") + f"""
, o AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE * k AS start, volume FROM ticks, (VALUES (0), (-1)) v(k))
SELECT symbol, start, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS trades FROM o WHERE start + INTERVAL 10 MINUTE <= {_CLOSED} GROUP BY 1, 2""")
def stream_sliding_bars(spark, sf):
    b = _drain(spark, st.bars(_source(spark, sf), "10 minutes", "5 minutes"))
    return b.select("symbol", "start", "volume", "trades")


@query("stream_dedupe", WV("ticks") + "SELECT symbol, seq, volume FROM ticks")
def stream_dedupe(spark, sf):
    """Every trade delivered twice arrives once."""
    s = _source(spark, sf)
    twice = s.withColumn("_c", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_c")
    return _drain(spark, st.once(twice).select("symbol", "seq", "volume"))


@query("stream_sessions_gaps", WV("ticks") + """
, l AS (SELECT symbol, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM ticks),
g AS (SELECT symbol, ts, sum(n) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM l), w AS (SELECT symbol, s, min(ts) AS a, max(ts) AS b FROM g GROUP BY 1, 2),
c AS (SELECT * FROM w WHERE b + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM ticks) - INTERVAL 2 MINUTE), n AS (SELECT symbol, b AS gap_start, lead(a) OVER (PARTITION BY symbol ORDER BY a) AS gap_end FROM c)
SELECT symbol, gap_start, gap_end FROM n WHERE gap_end IS NOT NULL""")
def stream_sessions_gaps(spark, sf):
    closed = _drain(spark, st.sessions(_source(spark, sf)))
    return st.gap_ledger(closed).select("symbol", "gap_start", "gap_end")


# --- several batches: rows delivered late, twice or out of order -----------------------------------

def _folder(spark):
    return f"{shared_folder(spark)}/tapeworks-stream-{uuid.uuid4().hex}"


def _closed(df, time, days):
    """``df`` and one row far behind its end, which lets the watermark pass everything else."""
    far = df.agg((F.max(time) + F.make_dt_interval(F.lit(days))).alias(time))
    return df.unionByName(far, allowMissingColumns=True)


def _replayed(spark, df, slice_of):
    """``df`` as a stream of one file per slice, one batch each."""
    root = _folder(spark)
    replay.stage_slices(df, root, F.coalesce(slice_of, F.lit(99)))
    return replay.stream_slices(spark, root, df.schema)


def _state_store(spark, rows):
    """State in as many parts as the rows call for, about a million each."""
    return ordered.state_store(spark, 8 + rows.count() // 1_000_000)


def _period(ticks, days):
    """Number of the period of some days that a trade falls into."""
    return F.floor(F.datediff("data_date", ticks.agg(F.min("data_date")).scalar()) / days)


_RUN = """, sb AS (SELECT symbol, CAST(ts AS DATE) AS d, date_trunc('minute', ts) AS start, CAST(sum(side * volume) AS BIGINT) AS delta,
 sum(price * volume) / sum(volume) AS vwap FROM ticks GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY start) AS n, CAST(sum(delta) OVER (PARTITION BY symbol, d ORDER BY start) AS BIGINT) AS cvd FROM sb),
r AS (SELECT symbol, d, n, greatest(delta, 0)::DOUBLE AS pos, CASE WHEN delta > 0 THEN vwap END AS cost FROM k WHERE n = 1 UNION ALL
 SELECT k.symbol, k.d, k.n, greatest(pos + delta, 0), CASE WHEN delta <= 0 THEN CASE WHEN pos + delta > 0 THEN cost END WHEN pos <= 0 THEN vwap
  ELSE (pos * cost + delta * vwap) / (pos + delta) END FROM r JOIN k ON k.symbol = r.symbol AND k.d = r.d AND k.n = r.n + 1)"""


@query("stream_running_cvd", WV("ticks").replace("WITH", "WITH RECURSIVE", 1) + _RUN + f"""
SELECT CAST(k.symbol AS VARCHAR) AS symbol, start, delta, cvd, pos AS position, {R("cost", 4)} AS cost FROM k JOIN r USING (symbol, d, n)""")
def stream_running_cvd(spark, sf):
    """A tenth of the trades come a batch late, within the watermark."""
    t = _closed(V.ticks(spark, sf), "ts", 10)
    s = _replayed(spark, t, _period(t, 5) + (F.col("seq") % 10 == 3).cast("int"))
    with _state_store(spark, t):
        out = _drain(spark, ordered.running_state(st.bars(s, delay="6 days")))
    return out.select("symbol", "start", "delta", "cvd", "position", rounded(F.col("cost"), 4).alias("cost"))


@query("stream_action_changes", """WITH s AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS data_date, arg_max(o_orderstatus, o_orderkey) AS action FROM orders GROUP BY 1, 2),
p AS (SELECT *, lag(action) OVER w AS pa, lag(data_date) OVER w AS pd FROM s WINDOW w AS (PARTITION BY symbol ORDER BY data_date)),
q AS (SELECT *, CASE WHEN data_date - pd <= 120 THEN pa END AS prev_action FROM p)
SELECT CAST(symbol AS VARCHAR) AS symbol, data_date, action, prev_action FROM q WHERE action IN ('F', 'P') AND action IS DISTINCT FROM prev_action""")
def stream_action_changes(spark, sf):
    """Every fifth symbol's snapshots come a batch late."""
    s = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("data_date")).agg(
        F.max_by("o_orderstatus", "o_orderkey").alias("action")).withColumn("chip_score", F.lit(0.0))
    s = _closed(s.withColumn("at", F.col("data_date").cast("timestamp")), "at", 2000)
    stream = _replayed(spark, s, F.year("data_date") - 1990 + (F.col("symbol") % 5 == 0).cast("int"))
    with _state_store(spark, s):
        out = _drain(spark, ordered.action_changes(stream.withWatermark("at", "800 days"), 120, ["F", "P"], "at"))
    return out.select("symbol", "data_date", "action", "prev_action")


_FEATURES = """, sz AS (SELECT *, date_trunc('minute', ts) AS start, CAST(ceil(ln(volume::DOUBLE) / ln(1.01::DOUBLE / 0.99::DOUBLE)) AS BIGINT) AS step FROM ticks),
h AS (SELECT symbol, data_date, start, step, count(*) AS c, sum(CASE WHEN side > 0 THEN volume ELSE 0 END) AS bought, sum(CASE WHEN side < 0 THEN volume ELSE 0 END) AS sold FROM sz GROUP BY ALL),
b0 AS (SELECT symbol, data_date, start, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume)::BIGINT AS volume,
 count(*) AS trades, sum(CASE WHEN side > 0 THEN volume ELSE 0 END)::BIGINT AS bv, sum(CASE WHEN side < 0 THEN volume ELSE 0 END)::BIGINT AS sv, sum(price * volume) AS turnover FROM sz GROUP BY ALL),
b1 AS (SELECT *, bv - sv AS delta, coalesce(close / lag(close) OVER w - 1, 0) AS ret, count(*) OVER w AS n FROM b0 WINDOW w AS (PARTITION BY symbol, data_date ORDER BY start)),
b2 AS (SELECT *, sum(delta) OVER w AS cvd, sum(volume::DOUBLE) OVER w / n AS vm, sum(volume::DOUBLE * volume) OVER w / n AS vq, sum(ret) OVER w / n AS rm, sum(ret * ret) OVER w / n AS rq
 FROM b1 WINDOW w AS (PARTITION BY symbol, data_date ORDER BY start)),
b3 AS (SELECT *, (volume - vm) / (sqrt(greatest(vq - vm * vm, 0)) + 1e-9) AS vz, (ret - rm) / (sqrt(greatest(rq - rm * rm, 0)) + 1e-9) AS rz FROM b2),
b4 AS (SELECT *, CASE WHEN vz > 0 THEN vz / (abs(rz) + 0.5::DOUBLE) ELSE 0 END AS score FROM b3),
c AS (SELECT x.symbol, x.start, step, sum(c) AS c FROM b0 x JOIN h ON h.symbol = x.symbol AND h.data_date = x.data_date AND h.start <= x.start GROUP BY ALL),
c2 AS (SELECT *, sum(c) OVER (PARTITION BY symbol, start ORDER BY step) AS upto, sum(c) OVER (PARTITION BY symbol, start) AS total FROM c),
l AS (SELECT symbol, start, CASE WHEN max(total) >= 20 THEN min(step) FILTER (upto >= greatest(1, ceil(0.95::DOUBLE * total))) END AS step FROM c2 GROUP BY ALL),
g AS (SELECT h.symbol, h.start, sum(bought) FILTER (h.step >= l.step) AS lb, sum(sold) FILTER (h.step >= l.step) AS ls FROM h JOIN l ON l.symbol = h.symbol AND l.start = h.start GROUP BY ALL),
dp AS (SELECT symbol, date_trunc('minute', ts) AS start, avg(CASE WHEN bs + ks = 0 THEN 0 ELSE (bs - ks)::DOUBLE / (bs + ks) END) AS obi
 FROM (SELECT *, seq % 7 + seq % 11 AS bs, seq % 5 + seq % 13 AS ks FROM ticks WHERE seq % 4 <> 0) GROUP BY ALL)"""


@query("stream_feature_bars", WV("ticks") + _FEATURES + f"""
SELECT CAST(symbol AS VARCHAR) AS symbol, start AS bucket, open, high, low, close, volume, bv AS buy_volume, sv AS sell_volume, delta, cvd::BIGINT AS cvd, trades AS trade_count,
 {R("volume::DOUBLE / trades", 4)} AS avg_trade_size, {R("2 * pow(1.01::DOUBLE / 0.99::DOUBLE, l.step) / (1.01::DOUBLE / 0.99::DOUBLE + 1)", 4)} AS large_limit, coalesce(lb, 0)::BIGINT AS large_buy_volume,
 coalesce(ls, 0)::BIGINT AS large_sell_volume, (coalesce(lb, 0) - coalesce(ls, 0))::BIGINT AS large_trade_delta, {R("obi", 5)} AS obi,
 {R("CASE WHEN delta < 0 AND rz >= 0 THEN score ELSE 0 END", 4)} AS sell_absorption_score, {R("CASE WHEN delta > 0 AND rz <= 0 THEN score ELSE 0 END", 4)} AS buy_absorption_score,
 {R("trades / 60.0::DOUBLE", 6)} AS trade_speed, {R("turnover / volume", 4)} AS vwap FROM b4 JOIN l USING (symbol, start) JOIN g USING (symbol, start) LEFT JOIN dp USING (symbol, start)""")
def stream_feature_bars(spark, sf):
    """Trades and depth as two streams; a tenth of the rows come a batch late, within the watermark."""
    t = _closed(V.ticks(spark, sf), "ts", 20)
    s = _replayed(spark, t, _period(t, 10) + (F.col("seq") % 10 == 3).cast("int")).withWatermark("ts", "11 days")
    n = F.col("seq")
    depth = s.where(n % 4 != 0).select("symbol", "ts", F.array(n % 7, n % 11).alias("bids"), F.array(n % 5, n % 13).alias("asks"))
    closing = s.where(n.isNull()).select("symbol", "ts", F.array(n).alias("bids"), F.array(n).alias("asks"))
    with _state_store(spark, t):
        b = _drain(spark, ordered.feature_bars(s, depth.union(closing), tk.book_imbalance(F.col("bids"), F.col("asks")), min_samples=20))
    digits = {"avg_trade_size": 4, "large_limit": 4, "obi": 5, "sell_absorption_score": 4, "buy_absorption_score": 4, "trade_speed": 6, "vwap": 4}
    return b.select(*[rounded(F.col(c), digits[c]).alias(c) if c in digits else c for c in b.columns if c != "data_date"])


# deliveries: a fiftieth one slice late, a fiftieth twice at once, a fiftieth again one slice later
_DELIVERED = """, p AS (SELECT *, (data_date - (SELECT min(data_date) FROM ticks)) // 5 AS slice FROM ticks),
v AS (SELECT seq, symbol, ts, volume, slice + CASE WHEN seq % 50 = 1 THEN 1 ELSE 0 END AS slice FROM p UNION ALL SELECT seq, symbol, ts, volume, slice FROM p WHERE seq % 50 = 2
 UNION ALL SELECT seq, symbol, ts, volume, slice + 1 FROM p WHERE seq % 50 = 3),
wm AS (SELECT s.slice, (SELECT max(ts) FROM v WHERE v.slice < s.slice) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT slice FROM v) s),
o AS (SELECT v.*, mark, coalesce(ts < mark, false) AS late FROM v JOIN wm USING (slice)),
q AS (SELECT *, CASE WHEN late THEN 'behind watermark' WHEN row_number() OVER (PARTITION BY seq, late ORDER BY slice) > 1 THEN 'delivered before' ELSE 'accepted' END AS outcome FROM o)"""


def _settled(spark, sf):
    t = V.ticks(spark, sf)
    n, period = F.col("seq"), _period(t, 5)
    extra = F.when(n % 50 == 1, F.array(period + 1)).when(n % 50 == 2, F.array(period, period)).when(
        n % 50 == 3, F.array(period, period + 1)).otherwise(F.array(period))
    delivered = t.withColumn("_slice", F.explode(extra))
    root = _folder(spark)
    replay.stage_slices(delivered, root, F.col("_slice"))
    stream = replay.stream_slices(spark, root, delivered.schema).drop("_slice")
    ledger = TickLedger(spark, f"{_folder(spark)}/ledger", delay=86_400)
    ledger.writer(stream, _folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return ledger


@query("stream_commit_ledger", WV("ticks") + _DELIVERED + """
SELECT symbol, outcome, count(*) AS n, CASE WHEN outcome = 'accepted' THEN sum(volume)::BIGINT END AS volume FROM q GROUP BY 1, 2""")
def stream_commit_ledger(spark, sf):
    """Every delivered row has one outcome: accepted once, or refused with a reason."""
    ledger = _settled(spark, sf)
    got = ledger.read("ticks").groupBy("symbol", F.lit("accepted").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
    refused = ledger.read("refused").groupBy("symbol", F.col("reason").alias("outcome")).agg(F.sum("copies").alias("n"))
    return got.unionByName(refused.withColumn("volume", F.lit(None).cast("bigint")))


@query("stream_late_rows", WV("ticks") + _DELIVERED + "SELECT symbol, seq, ts, mark AS watermark, slice AS batch FROM q WHERE outcome = 'behind watermark'")
def stream_late_rows(spark, sf):
    late = _settled(spark, sf).read("refused").where("reason = 'behind watermark'")
    return late.select("symbol", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("watermark").cast("timestamp_ntz").alias("watermark"), "batch")


@query("coverage_maintained", WV("ticks") + _DELIVERED + """
, a AS (SELECT symbol, CAST(ts AS DATE) AS data_date FROM q WHERE outcome = 'accepted'),
n AS (SELECT DISTINCT data_date FROM a ORDER BY 1 DESC LIMIT 20)
SELECT data_date, count(DISTINCT symbol) AS symbols, count(*) AS ticks, (SELECT count(DISTINCT data_date) FROM a) AS days, (SELECT min(data_date) FROM a) AS first_date,
 (SELECT count(*) FROM a) AS rows FROM a WHERE data_date IN (SELECT data_date FROM n) GROUP BY 1""")
def coverage_maintained(spark, sf):
    """Coverage and newest days from the statistics that the sink commits with its trades; no trade is read."""
    ledger = _settled(spark, sf)
    span = ledger.span("ticks")
    return ledger.daily(20).select("*", *(span.select(c).scalar().alias(c) for c in ("days", "first_date", "rows")))


@query("ticks_replaced", WV("ticks") + f"""SELECT symbol, seq, data_date, {R("price + CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END", 2)} AS price, volume FROM ticks""")
def ticks_replaced(spark, sf):
    """Trades by date, merged batch by batch; a tenth of them is corrected by a later delivery."""
    t = V.ticks(spark, sf)
    delivered = t.withColumn("correction", F.explode(F.when(F.col("seq") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    delivered = delivered.withColumn("price", F.col("price") + F.col("correction"))
    stream, path = _replayed(spark, delivered, _period(t, 10) + F.col("correction")), f"{_folder(spark)}/ticks"
    landing.replace_day_stream(stream, path, _folder(spark), ["symbol", "seq"], seq="correction").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(delivered.schema).parquet(path)
    return out.select("symbol", "seq", "data_date", rounded(F.col("price"), 2).alias("price"), "volume")


@query("stream_latency", WV("ticks") + "SELECT symbol, seq, true AS arrived FROM ticks")
def stream_latency(spark, sf):
    """Arrival delays of the shadow table (depends on the wall clock)."""
    rows = st.with_latency(st.tick_rows(_source(spark, sf))).select("symbol", "seq", (F.col("latency_ms") >= 0).alias("arrived"))
    return _drain(spark, rows)
