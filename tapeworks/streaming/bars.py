"""Structured Streaming twins of the batch tick operators: bars, de-duplication, sessions, sinks (state: ordered.py)."""
from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tapeworks.sources.landing import merge_days


def tick_rows(events: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Raw tick events to trade rows with arrival time; an optional static symbol list restricts them."""
    rows = events.withColumn("data_date", F.to_date("ts"))
    if "received_at" not in rows.columns:
        rows = rows.withColumn("received_at", F.current_timestamp())
    return rows if symbols is None else rows.join(symbols.select("symbol"), "symbol", "left_semi")


def once(ticks: DataFrame, delay: str = "2 minutes", keys: tuple[str, ...] = ("symbol", "seq")) -> DataFrame:
    """Drop re-delivered trades; state is kept only as long as the watermark."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def bars(ticks: DataFrame, size: str = "1 minute", slide: str | None = None, delay: str = "2 minutes",
         watermarked: bool = False) -> DataFrame:
    """Tumbling or sliding bars per symbol with volume split, delta, VWAP and large-trade volume inputs.

    All aggregates combine before the shuffle, so a busy symbol costs one row per bar and task.
    """
    t = ticks if watermarked else ticks.withWatermark("ts", delay)
    at = F.struct("ts", "seq")
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    side, vol = F.col("side"), F.col("volume")
    agg = t.groupBy("symbol", win.alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("trades"), F.sum(F.when(side > 0, vol).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(side < 0, vol).otherwise(0)).alias("sell_volume"), F.sum(side * vol).alias("delta"),
        F.sum(F.col("price") * vol).alias("turnover"))
    return agg.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low",
                      "close", "volume", "trades", "buy_volume", "sell_volume", "delta",
                      F.try_divide("turnover", "volume").alias("vwap"))


def sessions(ticks: DataFrame, gap: str = "30 minutes", delay: str = "2 minutes") -> DataFrame:
    """Uninterrupted stretches of trading per symbol."""
    agg = ticks.withWatermark("ts", delay).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("trades"))
    return agg.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "trades")


def gap_ledger(closed: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Gaps between the sessions of a symbol: from the last trade of one to the first of the next."""
    w = Window.partitionBy("symbol").orderBy("start")
    last_trade = F.col("end") - F.expr(f"INTERVAL {gap}")
    return closed.withColumn("gap_end", F.lead("start").over(w)).where("gap_end IS NOT NULL").select(
        "symbol", last_trade.alias("gap_start"), "gap_end", F.lit("no trades").alias("reason"))


def with_latency(rows: DataFrame) -> DataFrame:
    """Arrival delay in milliseconds, for the table kept apart from the official one."""
    return rows.withColumn("latency_ms", F.unix_millis("received_at") - F.unix_millis("ts"))


def write_append(df: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> DataStreamWriter:
    """Append sink in micro-batches, by time (``processingTime``) or until the input is used up."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))


def write_upsert(df: DataFrame, path: str, checkpoint: str, keys: list[str], partition: str = "data_date",
                 trigger: dict[str, Any] | None = None, seq: str | None = None) -> DataStreamWriter:
    """Idempotent sink: each micro-batch is merged into the partitions it touches, which are then replaced. Of rows
    of a batch with one key the one with the largest ``seq`` counts."""
    return df.writeStream.foreachBatch(lambda batch, _id: merge_days(batch, path, keys, partition, seq)).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))


def book_bars(quotes: DataFrame, imbalance: Column, size: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    """Mean order-book imbalance per bar from a depth stream."""
    return quotes.withWatermark("ts", delay).groupBy("symbol", F.window("ts", size).alias("w")).agg(
        F.avg(imbalance).alias("imbalance"), F.count(F.lit(1)).alias("updates")).select(
        "symbol", F.col("w.start").alias("start"), "imbalance", "updates")
