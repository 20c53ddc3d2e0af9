"""Session defaults and the lineage cut used by multi-pass jobs."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 1 << 16  # rows of some hundred bytes that may be sent to every executor


def local_session(cpus: int | str = "*", app: str = "tapeworks", shuffle: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster pass the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary one: on a cluster every executor would write to its
    own disk, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tapeworks-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and go on from there.

    For results that several branches of a plan read: they are computed once, survive lost executors,
    and every reader takes only the columns it needs. Shuffle files of ended plans are given back.
    """
    path = f"{shared_folder(df.sparkSession)}/tapeworks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of ended plans deleted now.

    Spark deletes them when the driver's garbage collector finds the plan unused, which a large heap puts off for
    longer than a job lasts; until then every step's files stay beside the next one's.
    """
    spark._jvm.System.gc()


def sent_whole(df: DataFrame) -> DataFrame:
    """``df`` written; a table of few rows then goes to every executor, a longer one is left to the planner.

    A planner that cannot know how small a computed side is shuffles the large side to meet it.
    """
    out = materialise(df)
    return F.broadcast(out) if out.count() <= FEW else out


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system it belongs to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("tapeworks-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
