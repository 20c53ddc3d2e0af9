"""Numbered commits of a folder: data is staged first and counts once its manifest has been renamed into place."""
from __future__ import annotations

import json
import uuid
from typing import Any
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tapeworks.session import release

COMMIT = "commit"  # partition folder of one staged write


class CommitLog:
    """Manifests ``<root>/_commits/<number>.json``. One appears whole or not at all, and a number is given once.

    The rename refuses to replace a file, so of two writers of a number one loses; what a writer staged without a
    manifest is never read.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _at(self, *parts: str):
        return self._fs.makeQualified(self._path("/".join((self.root, *parts))))

    def _names(self, *parts: str) -> list[str]:
        folder = self._at(*parts)
        return [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_commits") if n.endswith(".json") and not n.startswith("."))

    def has(self, number: int) -> bool:
        return self._fs.exists(self._at("_commits", f"{number}.json"))

    def read(self, number: int) -> dict[str, Any]:
        stream = self._fs.open(self._at("_commits", f"{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, body: dict[str, Any]) -> bool:
        """Whether this writer's manifest became commit ``number``."""
        draft, final = self._at("_commits", f".{uuid.uuid4().hex}"), self._at("_commits", f"{number}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        jvm = self.spark._jvm
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf).rename(draft, final, never)
            return True
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception.toString()):
                return False
            raise

    def stage(self, df: DataFrame, table: str, by: str | None = None) -> str:
        """Write ``df`` under a name of its own; returns that name, for the manifest."""
        name = uuid.uuid4().hex
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.root}/{table}/{COMMIT}={name}")
        release(self.spark)
        return name

    def parts(self, table: str, name: str, by: str) -> set[str]:
        """Values of ``by`` that a staged write has rows of."""
        return {unquote(n.split("=", 1)[1]) for n in self._names(table, f"{COMMIT}={name}") if n.startswith(f"{by}=")}

    def load(self, table: str, schema: StructType, paths: list[str]) -> DataFrame:
        """Rows of staged folders (or folders inside them), without the commit column."""
        if not paths:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}"
        return (self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{COMMIT}={p}" for p in paths])
                .select(*schema.names))

    def sweep(self, table: str, named: set[str]) -> int:
        """Delete the staged folders of ``table`` that no manifest names; only while nobody writes."""
        lost = [n for n in self._names(table) if n.startswith(f"{COMMIT}=") and n.split("=", 1)[1] not in named]
        for n in lost:
            self._fs.delete(self._at(table, n), True)
        return len(lost)
