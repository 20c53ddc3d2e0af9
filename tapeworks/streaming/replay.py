"""A stored table delivered again as a stream: one file per slice, taken one per trigger in the order of the slices."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_slices(df: DataFrame, root: str, slice_of: Column) -> None:
    """Write each slice (a small integer) as one file under ``root``; the files' times follow the slices."""
    spark = df.sparkSession
    df.withColumn("slice", slice_of.cast("int")).repartition("slice").write.partitionBy("slice").parquet(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("slice=")]
    for folder in folders:
        k = int(folder.getName().split("=")[1])
        for file in fs.listStatus(folder):
            fs.setTimes(file.getPath(), 1_000_000_000_000 + 60_000 * k, -1)


def stream_slices(spark: SparkSession, root: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{root}/slice=*")
