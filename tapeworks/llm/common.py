"""Small helpers shared by the corpus operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeworks.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the short way, where both functions agree."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; a null identifier has bucket -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def row_key(text: str | Column = "text") -> Column:
    """Stands for a row's text beside its identifier."""
    return F.xxhash64(whole_text(text))


def keep_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``marks`` (doc_id, raw, kept; one per row) keeps, with the columns of ``docs``.

    Only the dropped keys meet the texts (an anti join), so nothing is shuffled while they are few. Where a row
    occurs several times and fewer of its copies are kept, one copy goes on.
    """
    per_key = marks.groupBy("doc_id", "raw").agg(F.sum(F.col("kept").cast("int")).alias("k"), F.count("*").alias("n"))
    odd = materialise(per_key.where("k < n").select(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw"), "k"))
    here = lambda d, k: (d["doc_id"].eqNullSafe(k["__id"])) & (row_key(d["text"]) == k["__raw"])
    gone, thinned = odd.where("k = 0").drop("k"), odd.where("k > 0").drop("k")
    left = docs.join(gone, here(docs, gone), "left_anti")
    if thinned.isEmpty():
        return left
    single = left.join(thinned, here(left, thinned), "left_anti")
    many = left.join(thinned, here(left, thinned), "left_semi")
    again = many.withColumn("__raw", row_key(many["text"])).dropDuplicates(["doc_id", "__raw"]).drop("__raw")
    return single.unionByName(again)
