"""Importance resampling towards a target corpus: array-scored weights, exact draw by weighted median of medians."""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from tapeworks.llm.words import text_chunks
from tapeworks.session import discard, materialise

BUCKETS = 10_000
LONG = 64  # bytes; the checksums of longer words are taken one by one
KEY = ["down", "void", "id", "row"]  # ascending: high scores first, then small identifiers, null ones last, then rows
Key = tuple[int, int, int, int]

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_DARK = np.zeros(256, bool)
_DARK[48:58] = _DARK[97:123] = _DARK[128:] = True
_DARK = _DARK[_FOLD]


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)  # the CRC-32 polynomial
    return c


_CRC = _crc_table()


def _step(c: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(c ^ np.uint32(byte) if isinstance(byte, int) else c ^ byte) & 255] ^ (c >> 8)


def _apply(tables: np.ndarray, c: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Checksums shifted by table number ``n``: tables[n, k, v] is the shift of the value v in byte k."""
    flat, base = tables.reshape(-1), np.asarray(n) * 1024
    return (flat[base + (c & 255)] ^ flat[base + 256 + (c >> 8 & 255)]
            ^ flat[base + 512 + (c >> 16 & 255)] ^ flat[base + 768 + (c >> 24)])


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Shifts by 0 to LONG zero bytes, and by 1, 2, 4, ... of them."""
    same = np.arange(256, dtype=np.uint32)[None] << np.uint32([[0], [8], [16], [24]])
    short = [same]
    for _ in range(LONG):
        short.append(_step(short[-1], 0))
    powers = [short[1]]
    for _ in range(30):
        powers.append(_apply(powers[-1][None], powers[-1], 0))
    return np.stack(short), np.stack(powers)


_SHORT, _POWERS = _shift_tables()


def _joined(head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksum of a text with ``head`` followed by ``length`` bytes with ``tail``."""
    out = _apply(_SHORT, head, np.minimum(length, LONG))
    for i in np.flatnonzero(length > LONG):
        c, n = head[i:i + 1], int(length[i])
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                c = _apply(_POWERS, c, bit)
        out[i] = c[0]
    return out ^ tail


def word_checksums(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of each word, its bytes, number of words of each text); A-Z count as a-z."""
    dark = _DARK[raw]
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1]
    last[:-1] &= ~dark[1:]
    full = off[:-1] < off[1:]
    edge = off[:-1][full]
    first[edge], last[off[1:][full] - 1] = dark[edge], dark[off[1:][full] - 1]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    low = _FOLD[raw]
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(length <= LONG)
    k = 0
    while len(live):
        crc[live] = _step(crc[live], low[start[live] + k])
        k += 1
        live = live[length[live] > k]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > LONG):
        crc[i] = zlib.crc32(low[start[i]:start[i] + length[i]])
    return crc, length, np.diff(np.searchsorted(start, off))


def buckets(raw: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For runs of 1, 2 and 3 words: the bucket of each run, the text it is in; and the number of words of each text."""
    crc, length, counts = word_checksums(raw, off)
    text = np.repeat(np.arange(len(counts)), counts)
    place, owner, runs = [], [], crc
    for more in range(3):
        if more:
            spaced = _step(runs[:-1] ^ np.uint32(0xFFFFFFFF), 32) ^ np.uint32(0xFFFFFFFF)
            runs = _joined(spaced, crc[more:], length[more:]) if len(spaced) else spaced
        whole = text[more:] == text[:len(text) - more] if more else np.ones(len(text), bool)
        place.append((runs[whole] % np.uint32(BUCKETS)).astype(np.int64)), owner.append(text[:len(runs)][whole])
    return place, owner, counts


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all ``text`` values fall into each bucket. A task adds up its own; the driver gets one row per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, raw, off in text_chunks(batch.column(0)):
                for place in buckets(raw, off)[0]:
                    total += np.bincount(place, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = (texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
            .toArrow())  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket, in doubles."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t)))
                     for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row per row of ``docs``."""
    @arrow_udf("struct<n_words:long,weight:long>")
    def weigh(texts: pa.Array) -> pa.Array:
        words, weights = [], []
        for _, raw, off in text_chunks(texts):
            place, owner, counts = buckets(raw, off)
            weight = np.zeros(len(counts), np.int64)
            for b, d in zip(place, owner):
                upto = np.concatenate(([0], np.cumsum(gain[b])))
                weight += np.diff(upto[np.searchsorted(d, np.arange(len(counts) + 1))])
            words.append(counts), weights.append(weight)
        cat = lambda xs: pa.array(np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64))
        return pa.StructArray.from_arrays([cat(words), cat(weights)], ["n_words", "weight"])

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    n = F.col("w.n_words")
    runs = n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))
    return docs.select("doc_id", weigh("text").alias("w")).select(
        "doc_id", n.alias("n_words"), runs.alias("n_features"), F.col("w.weight").alias("weight"),
        (F.col("w.weight") + luck).alias("score"))


def _after(keys: list[np.ndarray], than: Key) -> np.ndarray:
    """Which keys come after ``than``."""
    out = keys[-1] > than[-1]
    for k, v in zip(keys[-2::-1], than[-2::-1]):
        out = (k > v) | ((k == v) & out)
    return out


def after(than: Key) -> Column:
    out = F.col(KEY[-1]) > than[-1]
    for c, v in zip(KEY[-2::-1], than[-2::-1]):
        out = (F.col(c) > v) | ((F.col(c) == v) & out)
    return out


def _medians(rows: DataFrame, low: Key | None, high: Key | None, pivot: Key | None) -> list[tuple[bool, int, Key]]:
    """Per partition and side of the pivot: (whether after it, number of keys within (low, high], their lower median)."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            keys = [c.to_numpy() for c in batch.columns]
            inside = np.ones(len(keys[0]), bool)
            if low is not None:
                inside &= _after(keys, low)
            if high is not None:
                inside &= ~_after(keys, high)
            kept.append([k[inside] for k in keys])
        keys = [np.concatenate(c) for c in zip(*kept)] if kept else [np.zeros(0, np.int64)] * len(KEY)
        late = np.zeros(len(keys[0]), bool) if pivot is None else _after(keys, pivot)
        found = []
        for side in (False, True):
            own = [k[late == side] for k in keys]
            if n := len(own[0]):
                middle = np.lexsort(own[::-1])[(n - 1) // 2]
                found.append({"late": side, "n": n} | {c: int(k[middle]) for c, k in zip(KEY, own)})
        yield pa.RecordBatch.from_pylist(found, pa.schema([("late", pa.bool_()), ("n", pa.int64()), *((c, pa.int64()) for c in KEY)]))

    kind = "late boolean, n long, " + ", ".join(f"{c} long" for c in KEY)
    return [(r["late"], r["n"], tuple(r[c] for c in KEY)) for r in rows.select(*KEY).mapInArrow(look, kind).collect()]


def weighted_median(medians: list[tuple[int, Key]]) -> Key:
    """The first of the sorted keys with which half of all weight is reached."""
    half, upto = sum(n for n, _ in medians) / 2, 0
    for n, key in sorted(medians, key=lambda m: m[1]):
        upto += n
        if upto >= half:
            return key
    raise ValueError("no keys")


def cutoff(rows: DataFrame, wanted: int) -> Key | None:
    """The key (columns KEY, longs without nulls, all different) that ``wanted`` of the written ``rows`` do not exceed.

    The pivot of a round is the median of the partitions' medians, each weighted by the keys its partition has left, so
    every round discards at least a quarter of what is left. A round is one job: it counts both sides of the pivot and
    takes the medians of both, so the next pivot is known whichever side holds the cutoff. The driver sees two rows per
    partition. What is left is written anew each time it has shrunk to a quarter, so all rounds together read little
    more than the first.
    """
    low = high = pivot = None
    sides = _medians(rows, low, high, pivot)
    left = here = sum(n for _, n, _ in sides)
    if wanted < 1 or not left:
        return None
    if wanted >= left:
        return tuple(rows.orderBy(*[F.col(c).desc() for c in KEY]).select(*KEY).first())
    own = None
    pivot = weighted_median([(n, k) for _, n, k in sides])
    while True:
        sides = _medians(rows, low, high, pivot)
        early = sum(n for late, n, _ in sides if not late)
        if wanted == early:
            break
        late = wanted > early
        if late:
            low, wanted, left = pivot, wanted - early, left - early
        else:
            high, left = pivot, early
        pivot = weighted_median([(n, k) for side, n, k in sides if side == late])
        if 4 * left <= here:
            inside = F.lit(True) if low is None else after(low)
            less = materialise(rows.select(*KEY).where(inside if high is None else inside & ~after(high)))
            if own is not None:
                discard(own)
            rows = own = less
            here = left
    if own is not None:
        discard(own)
    return pivot


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3, ... in the order of KEY: sorted by ranges, one offset per range."""
    own = rows.columns
    dealt = materialise(rows.repartitionByRange(*KEY).withColumn("__range", F.spark_partition_id()))
    sizes = {r["__range"]: r["n"] for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()}  # one row per range
    upto, before = 0, []
    for k in range(max(sizes, default=-1) + 1):
        before.append(upto)
        upto += sizes.get(k, 0)
    offset = F.element_at(F.lit(np.array(before or [0], np.int64)), F.col("__range") + 1)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*KEY))
    return dealt.select(*own, (offset + place).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of ``docs``; ``rank`` numbers the drawn ones.

    Features are the runs of 1 to 3 consecutive words of the whole text, hashed into BUCKETS. A text's weight adds up
    its features' log ratios of the target's frequency to the source's, and the score adds noise that depends on the
    identifier. Of the documents with at least ``least_words`` words the best ``percent`` are drawn. Null and empty
    texts have no features and weight 0. A null identifier has the noise of an empty one and loses ties; repeated rows
    are documents of their own, in an order fixed within a run, with ranks of their own. Without a target text all
    buckets count as unseen there. An empty table gives no rows; other columns play no part.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    keys = {"down": -F.col("score"), "void": F.col("doc_id").isNull().cast("long"),
            "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "row": F.monotonically_increasing_id()}
    scored = materialise(weighed(docs, gain, seed).select("*", *(c.alias(n) for n, c in keys.items())))
    able = F.col("n_words") >= least_words
    last = cutoff(scored.where(able), percent * scored.where(able).count() // 100)
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = able & ~after(last)
    rest = scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(ranked(scored.where(drawn)).select(*out, "rank"))
