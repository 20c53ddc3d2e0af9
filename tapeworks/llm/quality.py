"""Quality classifier: a generalised additive model with pairwise interactions, read from lookup tables."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tapeworks.llm.common import bucket_of
from tapeworks.llm.features import NAMES, text_features

MAX_TRAIN = 20_000  # labelled rows the model is fitted on; the bound of the sample
BINS, PAIR_BINS, PAIRS = 48, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST_LEAF = 120, 40, 0.15, 3, 8


@dataclass
class Gam:
    """score = sigmoid(intercept + sum of one table entry per feature + one per pair of features)."""
    intercept: float
    cuts: list[np.ndarray]
    tables: np.ndarray  # feature x bin
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # pair x bin x bin

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, cut in enumerate(self.cuts):
            out += self.tables[j, np.searchsorted(cut, x[:, j], "right")]
        used = {j for pair in self.pairs for j in pair}
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], "right") for j in used}
        for (a, b), t in zip(self.pairs, self.pair_tables):
            out += t[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="midpoint"))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """Newton step of each bin from a tree with a few leaves over ordered bins: the best cuts are taken in turn."""
    spans, step = [(0, len(g))], np.zeros(len(g))
    cg, ch, cn = (np.concatenate(([0.0], np.cumsum(v))) for v in (g, h, n))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for a, b in spans:
            c = np.arange(a + 1, b)
            if len(c):
                won = np.where((cn[c] - cn[a] >= LEAST_LEAF) & (cn[b] - cn[c] >= LEAST_LEAF), gain(a, c) + gain(c, b) - gain(a, b), 0)
                k = int(np.argmax(won))
                best = max(best, (float(won[k]), (a, b), int(c[k])), key=lambda v: v[0])
        if best[1] is None:
            break
        (a, b), c = best[1:]
        spans.remove((a, b))
        spans += [(a, c), (c, b)]
    for a, b in spans:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return step


def _grid_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same on a grid: the best first cut along either axis, then the best cut of each half along the other."""
    best, out = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        G, H, N = (np.moveaxis(v, axis, 0) for v in (g, h, n))
        for c in range(1, len(G)):
            step = np.zeros_like(G)
            won = 0.0
            for half in (slice(0, c), slice(c, None)):
                s = _tree(G[half].sum(0), H[half].sum(0), N[half].sum(0), 2)
                won += float((s * G[half].sum(0)).sum())
                step[half] = s
            if won > best:
                best, out = won, np.moveaxis(step, 0, axis)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting: each round visits every feature with one small tree; afterwards the pairs whose grid explains
    most of what is left are boosted in the same way. Without both labels the score is the (smoothed) share."""
    rows, width = x.shape
    rate = (y.sum() + 0.5) / (rows + 1)
    cuts = [_edges(x[:, j], BINS) if rows else np.zeros(0) for j in range(width)]
    bins = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], 1) if rows else np.zeros((0, width), int)
    tables = np.zeros((width, BINS + 1))
    f = np.full(rows, np.log(rate / (1 - rate)))
    model = Gam(float(np.log(rate / (1 - rate))), cuts, tables, [], [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    model.pair_cuts = [_edges(x[:, j], PAIR_BINS)[:PAIR_BINS - 1] if rows else np.zeros(0) for j in range(width)]
    if len(np.unique(y)) < 2:
        return model
    count = [np.bincount(bins[:, j], minlength=BINS + 1) for j in range(width)]
    for _ in range(ROUNDS):
        for j in range(width):
            p = 1 / (1 + np.exp(-f))
            g = np.bincount(bins[:, j], y - p, minlength=BINS + 1)
            h = np.bincount(bins[:, j], p * (1 - p), minlength=BINS + 1)
            step = RATE * _tree(g, h, count[j], LEAVES)
            tables[j] += step
            f += step[bins[:, j]]
    coarse = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)], 1)
    cell = lambda a, b: coarse[:, a] * PAIR_BINS + coarse[:, b]
    shape = (PAIR_BINS, PAIR_BINS)

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        k = cell(a, b)
        return tuple(np.bincount(k, w, minlength=PAIR_BINS**2).reshape(shape) for w in (y - p, p * (1 - p), np.ones(rows)))

    strength = {}
    for a in range(width):
        for b in range(a + 1, width):
            g, h, _ = sums(a, b)
            strength[a, b] = float((g**2 / (h + 1)).sum())
    model.pairs = sorted(strength, key=strength.get, reverse=True)[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), *shape))
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            step = RATE * _grid_tree(*sums(a, b))
            model.pair_tables[k] += step
            f += step.ravel()[cell(a, b)]
    return model


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_train`` labelled documents whose crc32 bucket of 4 is not 2.

    Several label rows of a document count by their maximum; rows without a label or an identifier teach nothing.
    When there are more, those with the smallest digests of the identifier are taken.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 4) != 2))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))

    @arrow_udf("array<float>")
    def numbers(texts: pa.Array) -> pa.Array:
        f = text_features(texts).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * len(NAMES)), pa.array(f.ravel()))

    rows = docs.select("doc_id", "text").join(known, "doc_id").select("y", numbers("text").alias("x")).toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    y = rows["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order of arrival
    return x[order].astype(np.float64), y[order]


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Gam:
    return fit(*labelled_features(docs, labels, "quality", max_train))


def quality_score(model: Gam, text: Column | str = "text") -> Column:
    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(text_features(texts).astype(np.float32).astype(np.float64)))
    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; null texts count as empty and get a score.

    ``held_out`` marks crc32 bucket 2 of 4, from which no label is learned; a null identifier is not held out.
    Only the text enters the score. An empty table gives no rows; without usable labels the score is 0.5.
    """
    model = train(docs, labels, max_train)
    return (docs.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), quality_score(model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``."""
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    return packed.where(quality_score(train(docs, labels, max_train), F.col("d.text")) >= threshold).select(*own)
