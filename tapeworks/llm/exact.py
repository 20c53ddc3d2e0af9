"""Exact duplicates: a tree of merges over sorted digest runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeworks.llm.common import keep_rows, lower_ascii, row_key, whole_text
from tapeworks.session import materialise

KEY = ["digest", "bytes", "second"]


def digest_runs(docs: DataFrame, normalise=lower_ascii) -> DataFrame:
    """One row per document: its digest and the run (input partition) it starts in; written once."""
    text = normalise(whole_text())
    rows = docs.select(
        "doc_id", row_key().alias("raw"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("second"),
        F.spark_partition_id().alias("node"), F.monotonically_increasing_id().alias("row"))
    return materialise(rows)


def merge_tree(leaves: DataFrame, best: Column, fan_in_bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """(first level, root) of the merge tree over ``leaves`` (node, digest, bytes, second, ...).

    Every round gives 2^fan_in_bits neighbouring nodes to one parent, whose run keeps the best member and the count
    of each digest. The aggregate over a struct is a sort aggregate: a run is sorted by digest, and a round merges
    sorted runs. A digest sends one row per node and round, however many documents share it. Equality is verified
    at every level: digests merge only with the same length and the same second, unrelated hash.
    """
    first = leaves.groupBy("node", *KEY).agg(F.max(best).alias("best"), F.count("*").alias("n"))
    first = materialise(first)
    nodes = (leaves.agg(F.max("node")).first()[0] or 0) + 1
    level = first
    while nodes > 1:
        level = (level.groupBy(F.shiftright("node", fan_in_bits).alias("node"), *KEY)
                 .agg(F.max("best").alias("best"), F.sum("n").alias("n")))
        nodes = -(-nodes >> fan_in_bits) if nodes > 1 << fan_in_bits else 1
    return first, level


def exact_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, raw), one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. ``keep`` names the
    identifier that stays, ``largest`` or ``smallest``; a null identifier loses against any other. Rows that repeat
    an identifier and a text are copies like any others, and one of them stays. An empty table gives no rows; other
    columns play no part.

    The way back goes down the tree as well: the root's choice is joined to the first level (one row per node and
    digest), and that to the documents by node and digest, so a text shared by a third of all rows is spread over
    all nodes.
    """
    leaves = digest_runs(docs)
    rank = F.col("doc_id") if keep == "largest" else -F.col("doc_id")
    best = F.struct(rank.alias("rank"), "row", "doc_id")
    first, root = merge_tree(leaves, best)
    chosen = root.select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"),
                         F.col("n").alias("group_size"))
    per_node = first.select("node", *KEY).join(chosen, KEY)
    return (leaves.join(per_node, ["node", *KEY])
            .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "raw"))


def drop_exact(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    return keep_rows(docs, materialise(exact_duplicates(docs, keep).select("doc_id", "raw", "kept")))
