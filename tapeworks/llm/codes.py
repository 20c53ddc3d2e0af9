"""Codes of vectors: a codebook per part position, fitted by Lloyd rounds that walk a tree of parts and a tree of entries."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tapeworks.session import materialise

LEAF = 32  # parts in a leaf of the tree over parts
PAIRS = 1 << 14  # pairs of a leaf and an entry that are measured at once


@dataclass(frozen=True)
class Codebooks:
    """Entries as integers: (part position, entry, place within the part). ``scale`` is what a unit counts."""
    entries: np.ndarray
    scale: int = 256

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Tree:
    """Balanced boxes over points, one tree per part position; level k has 2**k nodes of equally many slots.

    Points are held by place, (place, position, slot), and boxes and sums alike. Slots beyond the points repeat the last
    one with weight 0, so they widen no box and count in no sum.
    """

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        parts, n, dim = points.shape
        self.depth = max(0, math.ceil(math.log2(n / leaf)))
        slots = -(-n // (1 << self.depth)) << self.depth
        order = np.broadcast_to(np.arange(slots), (parts, slots)).copy()
        flat = np.ascontiguousarray(points.transpose(2, 0, 1)).reshape(dim, -1)
        base = np.arange(parts)[:, None] * n
        for level in range(self.depth):
            length = slots >> level
            x = flat[:, base + np.minimum(order, n - 1)].reshape(dim, -1, length)
            widest = (x.max(2) - x.min(2)).argmax(0)
            half = np.argpartition(x[widest, np.arange(len(widest))], length // 2, axis=1)
            order = np.take_along_axis(order.reshape(-1, length), half, 1).reshape(parts, slots)
        self.order, self.real = order, order < n
        self.points = flat[:, base + np.minimum(order, n - 1)]
        shape = (parts, 1 << self.depth, -1)
        boxes, weight = self.points.reshape(dim, *shape), self.real.reshape(shape)
        self.low, self.high = [boxes.min(3)], [boxes.max(3)]
        self.sums, self.counts = [(boxes * weight).sum(3)], [weight.sum(2)]
        for _ in range(self.depth):
            for held, join in ((self.low, np.minimum), (self.high, np.maximum), (self.sums, np.add), (self.counts, np.add)):
                held.insert(0, join(held[0][..., 0::2], held[0][..., 1::2]))

    def slots_of(self, pos: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
        """Point numbers of the slots of nodes, one row per node."""
        length = self.order.shape[1] >> level
        return self.order[pos[:, None], node[:, None] * length + np.arange(length)]


def _groups(pos: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each run of one node, number of the run of each pair)."""
    new = np.ones(len(pos), bool)
    new[1:] = (np.diff(pos) != 0) | (np.diff(node) != 0)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _bounds(p: Tree, up: int, e: Tree, down: int, pos: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of each pair of boxes."""
    at, to = pos * (1 << up) + a, pos * (1 << down) + b
    least = most = np.zeros(len(pos), np.int64)
    for low, high, elow, ehigh in zip(p.low[up], p.high[up], e.low[down], e.high[down]):
        x, y = elow.ravel()[to] - high.ravel()[at], low.ravel()[at] - ehigh.ravel()[to]
        least = least + np.maximum(np.maximum(x, y), 0) ** 2
        most = most + np.maximum(ehigh.ravel()[to] - low.ravel()[at], high.ravel()[at] - elow.ravel()[to]) ** 2
    return least, most


def dual_tree(points: np.ndarray, entries: np.ndarray, leaf: int = LEAF, codes: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """(nearest entry of each part, totals per entry) for integer ``points`` (position, row, place).

    Pairs of a node of parts and a node of entries go down both trees. A pair goes when its least distance exceeds the
    smallest largest distance that any pair promises the same parts. Parts left with one entry are settled as a whole
    node, by its cached sum and count; leaves that keep several entries are measured. All distances are integers, and
    only strictly farther entries go, so ties reach the measuring and fall to the lower index. Totals hold, per
    position and entry, the sums of the parts by place and last their number.
    """
    parts, n, dim = points.shape
    k = entries.shape[1]
    p, e = Tree(points, leaf), Tree(entries, 1)
    out = np.zeros((parts, p.order.shape[1]), np.int64) if codes else None
    totals = np.zeros((parts, k, dim + 1), np.int64)
    pos, a, b = np.arange(parts), np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    up = down = 0  # levels of the two trees
    while True:
        least, most = _bounds(p, up, e, down, pos, a, b)
        start, group = _groups(pos, a)
        keep = least <= np.minimum.reduceat(most, start)[group]
        if down == e.depth:
            keep &= e.real[pos, b]
        pos, a, b = pos[keep], a[keep], b[keep]
        if down == e.depth:
            start, group = _groups(pos, a)
            alone = np.bincount(group)[group] == 1
            sp, sa, entry = pos[alone], a[alone], e.order[pos[alone], b[alone]]
            _add(totals, sp, entry, [*p.sums[up][:, sp, sa], p.counts[up][sp, sa]])
            if codes:
                out[sp[:, None], p.slots_of(sp, sa, up)] = entry[:, None]
            pos, a, b = pos[~alone], a[~alone], b[~alone]
        if not len(pos) or (up == p.depth and down == e.depth):
            break
        if down < e.depth:
            pos, a, b, down = np.repeat(pos, 2), np.repeat(a, 2), np.repeat(2 * b, 2) + np.tile([0, 1], len(b)), down + 1
        if up < p.depth:
            pos, b, a, up = np.tile(pos, 2), np.tile(b, 2), np.concatenate((2 * a, 2 * a + 1)), up + 1
            order = np.argsort((pos << up) + a, kind="stable")
            pos, a, b = pos[order], a[order], b[order]
    if len(pos):
        _measure(p, entries, pos, a, e.order[pos, b], totals, out)
    return (out[:, :n] if codes else None), totals


def _add(totals: np.ndarray, pos: np.ndarray, entry: np.ndarray, values: list[np.ndarray]) -> None:
    """Add values (by place, and counts last) to the totals of (position, entry); integers all the way."""
    at = pos * totals.shape[1] + entry
    order = np.argsort(at, kind="stable")
    at = at[order]
    start = np.flatnonzero(np.diff(at, prepend=-1))
    if len(start):
        flat = totals.reshape(-1, totals.shape[2])
        for j, v in enumerate(values):
            flat[at[start], j] += np.add.reduceat(v[order], start)


def _measure(p: Tree, entries: np.ndarray, pos: np.ndarray, a: np.ndarray, entry: np.ndarray, totals: np.ndarray,
             out: np.ndarray | None) -> None:
    """Settle the parts of uncertain leaves by integer distances to the entries they kept."""
    parts, k, dim = entries.shape
    order = np.argsort(((pos << p.depth) + a) * k + entry)
    pos, a, entry = pos[order], a[order], entry[order]
    start, _ = _groups(pos, a)
    leaves = p.points.reshape(dim, parts << p.depth, -1)
    real = p.real.reshape(parts << p.depth, -1)
    books = entries.reshape(-1, dim).T
    at, to = (pos << p.depth) + a, pos * k + entry
    ends = np.append(start[1:], len(pos))
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(ends, start[first] + PAIRS, "right")))
        rows = slice(start[first], ends[last - 1])
        far = 0
        for x, y in zip(leaves, books):
            far = far + (x[at[rows]] - y[to[rows]][:, None]) ** 2
        heads = start[first:last] - start[first]
        group = np.repeat(np.arange(last - first), ends[first:last] - start[first:last])
        nearest = np.minimum.reduceat(np.where(far == np.minimum.reduceat(far, heads)[group], entry[rows][:, None], k), heads)
        here, gp = at[start[first:last]], pos[start[first:last]]
        w = real[here]
        _add(totals, np.broadcast_to(gp[:, None], w.shape)[w], nearest[w], [*leaves[:, here][:, w], w[w].astype(np.int64)])
        if out is not None:
            out[gp[:, None], p.slots_of(gp, a[start[first:last]], p.depth)] = nearest
        first = last


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor NaN nor infinite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def whole_parts(vectors: pa.Array, parts: int, width: int, scale: int) -> np.ndarray:
    """Integer parts (position, row, place): floor(scale * x), missing components 0."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = float(2 ** ((61 - math.ceil(math.log2(max(2, width)))) // 2))  # so that no sum of squares overflows
    value = np.clip(np.floor(scale * flat), -most, most).astype(np.int64)
    x = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = value
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks of the usable ``vectors`` (vec_id, embedding).

    They start as the parts of the vectors with the smallest identifiers (equal identifiers by vector, null ones last;
    with fewer vectors there are fewer entries). A round assigns every part of every vector and replaces each entry by
    floor(sum / count) of its parts; unused entries stay. Each task adds up its own totals, so the driver gets
    parts x entries x (places + 1) numbers a round, however many vectors there are. Shorter vectors count as filled up
    with zeros to the longest one and to a multiple of ``parts``; values too large for 64-bit sums of squares (beyond
    2**27 of ``scale`` units at 64 components) count as that limit. No vectors give empty codebooks.
    """
    kept = vectors.where(usable(F.col("embedding"))).select("vec_id", "embedding")
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    width = max(1, -(-longest // parts)) * parts
    head = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    books = whole_parts(head["embedding"], parts, width, scale)
    for _ in range(rounds):
        books = _moved(kept, books, width, scale)
    return Codebooks(books, scale)


def _moved(kept: DataFrame, books: np.ndarray, width: int, scale: int) -> np.ndarray:
    parts, k, dim = books.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, dim + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += dual_tree(whole_parts(batch.column(0), parts, width, scale), books, codes=False)[1]
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(total[at])], ["part", "entry", "place", "total"])

    sums = (kept.select("embedding").mapInArrow(totals, "part long, entry long, place long, total long")
            .groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).toArrow())  # at most parts * k * (dim + 1) rows
    total = np.zeros((parts, k, dim + 1), np.int64)
    total[tuple(sums[c].to_numpy() for c in ("part", "entry", "place"))] = sums["total"].to_numpy()
    count = total[..., dim:]
    return np.where(count > 0, total[..., :dim] // np.maximum(count, 1), books)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The usable rows of ``vectors`` with ``code`` (two hex digits per part) and ``error`` (squared distance) added."""
    parts, k, dim = books.entries.shape
    book, scale = books.entries, books.scale
    digits = np.array([f"{i:02x}" for i in range(max(k, 1))], "S2")

    @arrow_udf("struct<code:string,error:long>")
    def nearest(embedding: pa.Array) -> pa.Array:
        if not len(embedding) or not k:
            return pa.StructArray.from_arrays([pa.nulls(len(embedding), pa.string()), pa.nulls(len(embedding), pa.int64())],
                                              ["code", "error"])
        x = whole_parts(embedding, parts, parts * dim, scale)
        entry, _ = dual_tree(x, book)
        far = ((x - np.take_along_axis(book, entry[..., None], 1)) ** 2).sum((0, 2))
        code = np.ascontiguousarray(digits[entry.T]).view(f"S{2 * parts}").ravel().astype(str)
        return pa.StructArray.from_arrays([pa.array(code, pa.string()), pa.array(far)], ["code", "error"])

    kept = vectors.where(usable(F.col("embedding")))
    own = [c for c in kept.columns if c not in ("code", "error")]
    return kept.select(*own, nearest("embedding").alias("__c")).select(*own, "__c.code", "__c.error")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``approximation``: the vector that a code stands for."""
    book, scale = books.entries, books.scale

    @arrow_udf("array<double>")
    def vector(code: pa.Array) -> pa.Array:
        out = [None if c is None else
               np.concatenate([book[p, int(c[2 * p:2 * p + 2], 16)] for p in range(len(book))]) / scale for c in code.to_pylist()]
        return pa.array(out, pa.list_(pa.float64()))

    return codes.withColumn("approximation", vector("code"))


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, label), one row per usable row of ``vectors``.

    Rows whose vector is null or holds null, NaN or infinite components are dropped; a null identifier or label is a
    value like others, and repeated rows are vectors of their own. label_error adds up the errors of equal labels.
    An empty table gives no rows; other columns play no part. Two hex digits hold an index, so at most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits per part")
    d = vectors.select("vec_id", "label", "embedding")
    books = fit(d, parts, entries, rounds)
    coded = materialise(encode(d, books).drop("embedding"))
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"), "label")
