"""Document fingerprints after I-Match: terms of an idf band, hashed over randomised lexicons."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeworks.llm.common import lower_ascii, whole_text
from tapeworks.session import materialise

LEAST_SHARE, MOST_SHARE = 0.002, 0.2  # the idf band, as shares of documents that hold a term
LEXICONS = ((1, 1), (16, 4), (64, 8), (256, 12), (1024, 16))  # (one term in so many, number of lexicons)
NEIGHBOURS = 512  # documents per stretch of identifiers
BROADCAST_TERMS = 1 << 20  # a lexicon of up to so many terms is sent to every executor
WIDTH = sum(n for _, n in LEXICONS)


def terms(text: Column) -> Column:
    """Distinct words of a text (it may hold an empty one)."""
    return F.array_distinct(F.split(lower_ascii(text), r"[\x09-\x0D\x20]+"))


def _mask(term: Column) -> Column:
    """Bit k tells whether the term belongs to lexicon k; each lexicon is a random subset of the band."""
    bits, k = F.lit(0).cast("long"), 0
    for one_in, many in LEXICONS:
        for _ in range(many):
            inside = F.pmod(F.xxhash64(term, F.lit(k)), F.lit(one_in)) == 0
            bits, k = bits.bitwiseOR(F.when(inside, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))), k + 1
    return bits


def band_lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term: 64-bit hash, mask): terms that ``least`` to ``most`` of all documents hold, two documents at least.

    The table cannot outgrow (mean number of distinct terms per document) / ``least``, whatever the corpus.
    """
    n = docs.count()
    df = (docs.select(F.explode(terms(whole_text())).alias("t")).where("t <> ''")
          .groupBy(F.xxhash64("t").alias("term")).agg(F.count("*").alias("df")))
    band = df.where((F.col("df") >= max(2.0, least * n)) & (F.col("df") <= max(2.0, most * n)))
    return materialise(band.select("term", _mask(F.col("term")).alias("mask")))


def _inside(bits: int):
    return lambda x: x["mask"].bitwiseAND(F.lit(bits)) != 0


def _by_rate(found: Column) -> list[Column]:
    """The terms that belong to any lexicon of each rate; the sparse ones are then quick to go through."""
    out, k = [], 0
    for g, (_, many) in enumerate(LEXICONS):
        bits = ((1 << many) - 1) << k
        out.append(F.filter(found, _inside(bits)).alias(f"g{g}"))
        k += many
    return out


def _hashes(fallback: Column) -> Column:
    """WIDTH 32-bit hashes of sorted distinct terms; 0 where a lexicon has none of them. The first lexicon is the
    whole band; a text without any term of the band has the hash of its words there."""
    parts, k = [], 0
    for g, (_, many) in enumerate(LEXICONS):
        for _ in range(many):
            own = F.transform(F.filter(f"g{g}", _inside(1 << k)), lambda x: x["term"])
            h = F.hash(F.lit(k), own)
            h = F.when(h == 0, F.lit(1)).otherwise(h)
            parts.append(F.when(F.size(own) > 0, h).otherwise(fallback if k == 0 else F.lit(0)))
            k += 1
    return F.array(*parts)


def likeness(a: Column, b: Column) -> Column:
    """Share of lexicons on which two fingerprints agree, among those that hold a term of either (0 to 1).

    A sparse lexicon with a term of either text agrees about as often as the two sets of terms overlap.
    """
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), -1).otherwise((x == y).cast("int")))
    used = F.filter(pairs, lambda v: v >= 0)
    return F.size(F.filter(used, lambda v: v == 1)) / F.size(used)


def fingerprints(texts: DataFrame, lexicon: DataFrame, keys: list[str], sides: dict[str, str]) -> DataFrame:
    """``keys`` and one array of hashes for each entry of ``sides`` (name: text column).

    When ``texts`` is partitioned by the first key, nothing of it is shuffled: terms are exploded, matched with the
    lexicon and gathered again under the same key.
    """
    names = list(sides)
    both = F.array(*(F.struct(F.lit(i).alias("side"), F.array_append(terms(F.col(c)), F.lit("")).alias("t"),
                              F.hash(lower_ascii(F.col(c))).alias("plain")) for i, c in enumerate(sides.values())))
    d = texts.select(*keys, F.explode(both).alias("s")).select(*keys, "s.side", "s.plain", F.explode("s.t").alias("t"))
    d = d.select(*keys, "side", "plain", F.when(F.col("t") == "", F.lit(0)).otherwise(F.xxhash64("t")).alias("term"))
    small = lexicon.count() <= BROADCAST_TERMS
    d = d.join(F.broadcast(lexicon) if small else lexicon, "term", "left").where("mask IS NOT NULL OR term = 0")
    d = (d.groupBy(*keys, "side", "plain")
         .agg(F.sort_array(F.collect_list(F.when(F.col("mask").isNotNull(), F.struct("term", "mask")))).alias("found")))
    d = d.select(*keys, "side", "plain", *_by_rate(F.col("found")))
    plain = F.when(F.col("plain") == 0, F.lit(1)).otherwise(F.col("plain"))
    d = d.select(*keys, "side", _hashes(plain).alias("hashes"))
    return d.groupBy(*keys).agg(*(F.first(F.when(F.col("side") == i, F.col("hashes")), ignorenulls=True).alias(n)
                                  for i, n in enumerate(names)))


def with_next(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` (stretch, doc_id, key, ...) with ``next``: ``value`` of the row with the next smaller identifier,
    and of the largest one after the smallest.

    Rows are ordered inside stretches of identifiers; the first row of a stretch takes its value from the last row
    of the stretch below, so only one row per stretch travels.
    """
    order = ["doc_id", "key"]
    ends = materialise(rows.groupBy("stretch").agg(F.max(F.struct(*order)).alias("end")))
    top = ends.orderBy(F.desc("stretch")).limit(1).collect()
    if not top:
        return rows.withColumn("next", F.col(value))
    below = F.lag("end").over(Window.orderBy("stretch"))
    last = F.struct(F.lit(top[0]["end"]["doc_id"]).cast("long").alias("doc_id"), F.lit(top[0]["end"]["key"]).alias("key"))
    ends = ends.select(F.col("stretch").alias("__s"), F.coalesce(below, last).alias("e"))
    at = rows.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), F.col(value).alias("edge"))
    edges = (ends.join(at, F.col("e.doc_id").eqNullSafe(F.col("__d")) & (F.col("e.key") == F.col("__k")))
             .groupBy("__s").agg(F.first("edge").alias("edge")))
    edges = materialise(edges.withColumnRenamed("__s", "stretch"))
    before = F.lag(value).over(Window.partitionBy("stretch").orderBy(*order))
    return rows.withColumn("next", before).join(edges, "stretch").withColumn("next", F.coalesce("next", "edge")).drop("edge")


def stretches(docs: DataFrame) -> Column:
    """Stretch of identifiers a document belongs to: equal ranges with NEIGHBOURS documents on average; nulls first.

    Differences are taken as decimals, so any 64-bit identifiers will do.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * NEIGHBOURS // max(n, 1))
    wide = lambda v: F.lit(str(v)).cast("decimal(20,0)")
    offset = F.col("doc_id").cast("decimal(20,0)") - wide(low or 0)
    # ranges beyond the whole span (few documents) are one stretch
    return F.coalesce(F.floor(offset / wide(min(width, 10**20 - 1))).cast("long"), F.lit(-1))


def text_fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(doc_id, hashes): the fingerprint of each whole text."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text().alias("text"))
    return fingerprints(d, band_lexicon(docs, least, most), ["row", "doc_id"], {"hashes": "text"}).drop("row")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row.

    Null texts are empty; an edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document in descending order of doc_id. Rows that repeat an identifier are ordered by a
    hash of their text, null identifiers come last. Equal texts have equal fingerprints; a text without any term of
    the band is known by all its words. An empty table gives no rows; other columns play no part.
    """
    lexicon = band_lexicon(docs)
    d = docs.select(stretches(docs).alias("stretch"), "doc_id", whole_text().alias("text"))
    keys = ["stretch", "doc_id", "key", "row"]
    d = d.withColumn("key", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    d = with_next(d, "text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    d = d.select(*keys, n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    d = d.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    d = materialise(fingerprints(d, lexicon, [*keys, "n_chars", "edited_sha256"], {"own": "text", "other": "edited"}))
    d = with_next(d, "own")
    text = lambda c: F.concat_ws("", F.transform(c, lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    return d.select("doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"),
                    text("other").alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
                    likeness(F.col("own"), F.col("next")).alias("near_next"))
