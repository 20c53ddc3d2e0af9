"""Mixing sources to target weights by weighted fair queueing."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeworks.llm.common import whole_text
from tapeworks.session import materialise

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2
BLANK = r"[\x09-\x0D\x20]"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text: pieces between blanks, less an empty first and last one."""
    edges = text.rlike(f"^{BLANK}").cast("long") + text.rlike(BLANK + r"\z").cast("long")
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.size(F.split(text, BLANK + "+")).cast("long") - edges)


def source_key(source: str = "source") -> Column:
    """A key that is never null: a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def shuffle_key(doc_id: str = "doc_id") -> Column:
    """60 bits of a digest of the identifier: the same shuffle in every run."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def rotating_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Weight and place of each source: by code point, null last, ``weights`` in turn. One row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1)
    return sources.withColumn("place", place).withColumn("weight", pick.cast("double"))


def water_fill(sources: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``target`` of each source (key, source_size, place, weight): ``share`` of all sizes, split by weight, none above
    ``cap`` times its own size.

    With caps in order of cap / weight, the first k sources are full and the rest get level * weight; the level is the
    largest that the next source can take. One row per source, so the windows are as long as the list of sources.
    """
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    d = (sources.withColumn("most", cap * F.col("source_size").cast("double"))
         .withColumn("total", share * F.sum("source_size").over(every).cast("double"))
         .withColumn("level", level))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    d = d.withColumn("level", F.coalesce(F.max(fits).over(every), F.max("level").over(every)))
    return (d.withColumn("target", F.least(F.col("most"), F.col("level") * F.col("weight")))
            .drop("most", "level"))


def fair_queue(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS
               ) -> tuple[DataFrame, DataFrame]:
    """(sizes, limits): the sized documents, and per source the last unit taken in each round.

    Every source queues its shuffled documents, ``cap`` rounds one after another. A unit finishes at virtual time
    (words of its source up to and with it) / target. Units of all sources are put in order of (finish time, place
    of the source) and taken until the total budget is spent. A source's taken units are a prefix of its queue, so
    one row per source says all, and applying it moves no text.

    Running sums are cut into chunks of the shuffle key, so no task holds a source. The budget's cut is found by
    narrowing an interval of finish times through sums per sub-interval; units are ordered only inside the last.
    """
    sizes = materialise(docs.select("doc_id", "source", source_key().alias("key"), shuffle_key().alias("h"),
                                    word_count(whole_text()).alias("size"))
                        .withColumn("id", F.coalesce("doc_id", F.lit(-2**63).cast("long"))))
    totals = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = materialise(water_fill(rotating_weights(totals, weights), share, cap))
    n, budget = sizes.count(), targets.agg(F.max("total")).first()[0] or 0.0
    bits = max(0, math.ceil(math.log2(max(n, 1) / 4096)))
    unit = ["h", "id", "size"]
    units = (sizes.where("size > 0").groupBy("key", *unit).agg(F.sum("size").alias("words"))
             .withColumn("chunk", F.shiftright("h", 60 - bits)))
    sums = units.groupBy("key", "chunk").agg(F.sum("words").alias("w"))
    ahead = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "chunk", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("key", "chunk").orderBy(*unit).rowsBetween(Window.unboundedPreceding, 0)
    queue = (units.withColumn("upto", F.sum("words").over(inside)).join(sums, ["key", "chunk"])
             .select("key", *unit, "words", (F.col("upto") + F.col("ahead")).alias("upto")))
    queue = materialise(queue.join(targets.select("key", "place", "source_size", "target"), "key"))
    rounds = queue.withColumn("round", F.explode(F.array(*map(F.lit, range(cap)))))
    finish = (F.col("upto") + F.col("round") * F.col("source_size")).cast("double") / F.col("target")
    items = rounds.withColumn("finish", finish)
    taken = items.where(_within_budget(items, budget))
    last = (taken.groupBy("key").agg(*(F.max(F.when(F.col("round") == r, F.struct(*unit))).alias(f"last{r}")
                                       for r in range(cap))))
    return sizes, targets.select("key", "source_size", "target").join(materialise(last), "key", "left")


def _within_budget(items: DataFrame, budget: float) -> Column:
    """The condition under which an item comes before the point where the budget is spent.

    Finish times are read as 60-bit integers; each step sums one interval in 4096 parts and goes on in the part
    where the budget ends, until few items are left to be put in order one by one.
    """
    tick = F.floor(F.least("finish", F.lit(2.0**20 - 1)) * F.lit(2.0**40)).cast("long")
    spent, here = 0, F.lit(True)
    for shift in (48, 36, 24, 12, 0):
        part = F.shiftright(tick, shift)
        sums = items.where(here).groupBy(part.alias("part")).agg(F.sum("words").alias("w"), F.count("*").alias("n"))
        upto = F.sum("w").over(Window.orderBy("part")) + spent
        cut = sums.withColumn("upto", upto).where(F.col("upto") > budget).orderBy("part").first()
        if cut is None:
            return F.lit(True)
        spent, here = cut["upto"] - cut["w"], part == cut["part"]
        if cut["n"] <= 100_000:
            break
    order = ["finish", "place"]
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = items.where(here).withColumn("upto", F.sum("words").over(w) + spent).where(F.col("upto") > budget)
    stop = over.orderBy(*order).first()
    return (F.col("finish") < stop["finish"]) | ((F.col("finish") == stop["finish"]) & (F.col("place") < stop["place"]))


def _copies(cap: int) -> Column:
    unit = F.struct("h", "id", "size")
    one = lambda r: F.when((F.col("size") > 0) & (unit <= F.col(f"last{r}")), 1).otherwise(0)
    return sum((one(r) for r in range(1, cap)), one(0))


def mix(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row per row of ``docs``.

    ``taken`` counts the words the mix takes from the document, repeats counted. A null source is a source of its
    own; a document without words is never taken; sources without words have target 0. Rows that repeat identifier,
    source and size form one unit and are taken together. An empty table gives no rows.
    """
    sizes, limits = fair_queue(docs, share, cap, weights)
    copies = _copies(cap).cast("long")
    return (sizes.join(limits, "key").withColumn("copies", copies)
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"))


def mixed(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a document taken twice is there twice."""
    _, limits = fair_queue(docs, share, cap, weights)
    own = docs.columns
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), source_key().alias("key"),
                    shuffle_key().alias("h"), F.coalesce("doc_id", F.lit(-2**63).cast("long")).alias("id"),
                    word_count(whole_text()).alias("size"))
    d = d.join(limits, "key").withColumn("copies", _copies(cap)).where("copies > 0")
    return d.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
