"""A table by date with numbered versions: dates are deleted from, upserted and swapped in one commit."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeworks.operators.merge import upsert
from tapeworks.session import discard, materialise
from tapeworks.sources.commits import CommitLog


NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # folder of rows without a date


class VersionConflict(RuntimeError):
    """Another writer made the version first; read again and repeat."""


class VersionedDays:
    """Versions share the folders of dates they did not touch; a reader keeps the version it opened.

    A manifest holds one folder name per date, so it grows with the calendar and not with the rows.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], date: str = "data_date") -> None:
        self.spark, self.keys, self.date = spark, list(keys), date
        self.log = CommitLog(spark, root)

    def version(self) -> int | None:
        numbers = self.log.numbers()
        return numbers[-1] if numbers else None

    def _manifest(self, version: int | None) -> dict:
        return {"days": {}, "tombstones": []} if version is None else self.log.read(version)

    def read(self, version: int | None = None, days: Sequence[str] | None = None) -> DataFrame:
        """Rows of a version (the newest by default), or only of some dates: other dates' folders are not listed."""
        version = self.version() if version is None else version
        if version is None:
            raise ValueError("the table has no version yet")
        m = self._manifest(version)
        picked = m["days"] if days is None else {d: m["days"][d] for d in days if d in m["days"]}
        return self.log.load("rows", StructType.fromJson(m["schema"]), [f"{f}/{self.date}={d}" for d, f in picked.items()])

    def tombstones(self, version: int | None = None) -> DataFrame:
        """(keys, version): what each version deleted and did not write again."""
        version = self.version() if version is None else version
        m = self._manifest(version)
        kind = StructType([f for f in StructType.fromJson(m["schema"]) if f.name in self.keys]).add("version", "long")
        return self.log.load("tombstones", kind, m["tombstones"])

    def rewrite(self, rows: DataFrame, removed: DataFrame | None = None) -> int:
        """New version: stored rows with a key in ``removed`` go, then ``rows`` are upserted; returns its number.

        Only dates that occur in ``rows`` or ``removed`` are read and written again. A key in both is upserted. Nothing
        becomes visible before the manifest is in place; if another writer was faster, nothing does (VersionConflict).
        """
        base = self.version()
        old = self._manifest(base)
        new = materialise(rows)
        gone = materialise((rows.limit(0) if removed is None else removed).select(*self.keys).distinct())
        days = {NO_DAY if r[0] is None else str(r[0]) for r in new.select(self.date).distinct().union(gone.select(self.date).distinct()).collect()}  # calendar days
        stored = self.read(base, sorted(days)) if base is not None else new.limit(0)
        stored = stored.select(*new.columns)
        left = stored.join(gone, self.keys, "left_anti")
        merged = upsert(left, new, self.keys).select(*new.columns)
        dead = stored.select(*self.keys).join(gone, self.keys, "left_semi").join(new.select(*self.keys), self.keys, "left_anti")
        number = 0 if base is None else base + 1
        folder = self.log.stage(merged.repartition(self.date), "rows", self.date)
        grave = self.log.stage(dead.withColumn("version", F.lit(number).cast("long")), "tombstones")
        filled = self.log.parts("rows", folder, self.date)
        body = {"schema": new.schema.jsonValue(), "tombstones": [*old["tombstones"], grave],
                "days": {d: f for d, f in old["days"].items() if d not in days} | {d: folder for d in sorted(filled)}}
        done = self.log.publish(number, body)
        for table in (new, gone):
            discard(table)
        if not done:
            raise VersionConflict(f"version {number} is taken")
        return number
