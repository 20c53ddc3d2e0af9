"""Exactly-once ingest of trades: every delivered row has one outcome, and a micro-batch counts once."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tapeworks.session import discard, materialise
from tapeworks.sources.commits import CommitLog

NO_TIME, BEHIND, AGAIN = "no event time", "behind watermark", "delivered before"


class TickLedger:
    """Trades, refused rows and coverage under one log of micro-batches.

    The watermark is the newest event time of all committed batches less ``delay`` seconds; the log carries it, so it
    survives a lost checkpoint. Rows behind it, rows without a time and repeats of a key go to ``refused`` with their
    reason, all others to ``ticks``. Statistics per (date, symbol) are part of the same commit, so coverage is read
    without touching a trade. A batch that is delivered again, or that died between staging and commit, changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ("symbol", "seq"), time: str = "ts",
                 day: str = "data_date", delay: int = 120) -> None:
        self.spark, self.keys, self.time, self.day, self.delay = spark, list(keys), time, day, delay
        self.log = CommitLog(spark, root)

    # --- writing ---------------------------------------------------------------------------------

    def settle(self, batch: DataFrame, number: int) -> bool:
        """Commit micro-batch ``number``; False if it is committed already."""
        if self.log.has(number):
            return False
        numbers = self.log.numbers()
        last = self.log.read(numbers[-1]) if numbers else {"high": None, "near": []}
        high, mark = last["high"], None if last["high"] is None else last["high"] - self.delay * 1_000_000
        at = F.unix_micros(self.time)
        reason = F.when(F.col(self.time).isNull(), NO_TIME)
        if mark is not None:
            reason = reason.when(at < mark, BEHIND)
        rows = materialise(batch.withColumn("_reason", reason).withColumn("_at", at))
        on_time = rows.where("_reason IS NULL").drop("_reason")
        # copies of a key combine before the shuffle; the earliest row stands for them
        rest = [c for c in batch.columns if c not in self.keys]
        one = on_time.groupBy(*self.keys).agg(F.min(F.struct("_at", *rest)).alias("_r"), F.count(F.lit(1)).alias("_copies"))
        one = one.select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in rest], "_copies")
        known = F.lit(False)
        near = [n for n in last["near"] if n["high"] >= (mark or 0)]  # commits that hold rows beyond the watermark
        if mark is not None:
            # a repeat that is not behind the watermark repeats a row that is not either
            before = self.log.load("ticks", batch.schema, [n["folder"] for n in near]).where(
                (at >= mark) & (F.col(self.day) >= F.to_date(F.timestamp_micros(F.lit(mark)))))
            one = one.join(before.select(*self.keys).withColumn("_known", F.lit(True)), self.keys, "left")
            known = F.coalesce("_known", F.lit(False))
        one = materialise(one.withColumn("_known", known))
        fresh = one.where("NOT _known").select(*batch.columns)
        again = F.col("_copies") - F.when(F.col("_known"), 0).otherwise(1)
        repeats = one.select(*self.keys, self.time, F.lit(AGAIN).alias("reason"), again.alias("copies")).where("copies > 0")
        refused = rows.where("_reason IS NOT NULL").select(*self.keys, self.time, F.col("_reason").alias("reason"),
                                                          F.lit(1).cast("long").alias("copies")).unionByName(repeats)
        refused = refused.withColumn("watermark", F.timestamp_micros(F.lit(mark).cast("long"))).withColumn("batch", F.lit(number).cast("long"))
        stats = fresh.groupBy(self.day, self.keys[0]).agg(
            F.count(F.lit(1)).alias("rows"), F.min(self.time).alias("first_time"), F.max(self.time).alias("last_time"))
        own = rows.where("_reason IS NULL").agg(F.max("_at")).first()[0]
        body = {"high": own if high is None else max(high, own or high), "near": near, "tables": {}, "schemas": {}}
        for table, df, by in (("ticks", fresh, self.day), ("refused", refused, None), ("stats", stats, None)):
            body["tables"][table] = self.log.stage(df, table, by)
            body["schemas"][table] = df.schema.jsonValue()
        if own is not None:
            body["near"] = [*near, {"folder": body["tables"]["ticks"], "high": own}]
        done = self.log.publish(number, body)
        for table in (rows, one):
            discard(table)
        return done

    def writer(self, ticks: DataFrame, checkpoint: str) -> DataStreamWriter:
        return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
            lambda batch, number: self.settle(batch, number))

    # --- reading ---------------------------------------------------------------------------------

    def _load(self, table: str, manifests: list[dict]) -> DataFrame:
        if not manifests:
            raise ValueError("nothing is committed yet")
        schema = StructType.fromJson(manifests[-1]["schemas"][table])
        return self.log.load(table, schema, [m["tables"][table] for m in manifests])

    def read(self, table: str) -> DataFrame:
        """``ticks``, ``refused`` or ``stats`` of all committed batches."""
        return self._load(table, [self.log.read(n) for n in self.log.numbers()])

    def span(self, source: str) -> DataFrame:
        """Days, first, last and row count, from the statistics alone."""
        per_day = self.read("stats").groupBy(self.day).agg(F.sum("rows").alias("_n"))
        return per_day.agg(F.lit(source).alias("source"), F.count(self.day).alias("days"), F.min(self.day).alias("first_date"),
                           F.max(self.day).alias("last_date"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))

    def daily(self, days: int) -> DataFrame:
        """Symbols and trades of the newest days, from the statistics alone; exact, since they are kept per symbol."""
        s = self.read("stats").groupBy(self.day, self.keys[0]).agg(F.sum("rows").alias("_n"))
        newest = s.select(self.day).distinct().orderBy(F.col(self.day).desc()).limit(days)
        return s.join(newest, self.day, "left_semi").groupBy(self.day).agg(
            F.count(F.lit(1)).alias("symbols"), F.sum("_n").alias("ticks"))

    def sweep(self) -> int:
        """Delete what died between staging and commit."""
        named = [self.log.read(n)["tables"] for n in self.log.numbers()]
        return sum(self.log.sweep(t, {m[t] for m in named}) for t in ("ticks", "refused", "stats"))
