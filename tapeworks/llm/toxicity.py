"""Toxicity: a small convolutional network over hashed word embeddings, trained in numpy."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tapeworks.llm.common import bucket_of
from tapeworks.llm.words import mixed, text_chunks, word_bounds, word_hashes

MAX_TRAIN = 8_000  # labelled rows the network is fitted on; the bound of the sample
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
EPOCHS, BATCH, STEP = 8, 128, 0.08
CUT = 0.3
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)


def word_buckets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of its first four bytes, number of words of each text)."""
    h, counts = word_hashes(raw, off)
    starts, _ = word_bounds(raw, off)
    padded = np.concatenate((raw, np.full(4, 32, np.uint8)))
    head = np.zeros(len(starts), np.uint64)
    for k in range(4):
        head = head * np.uint64(256) + _FOLD[padded[starts + k]]
    half = np.uint64(BUCKETS // 2)
    return (h % half).astype(np.int32), (mixed(head) % half + half).astype(np.int32), counts


@dataclass
class Network:
    """Embeddings of word and word-start buckets, filters of several widths, max pooling, one output."""
    emb: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIM)))
    filters: list[np.ndarray] = field(default_factory=list)  # per width: width x DIM x FILTERS
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS))
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)  # calibration of the logit
    cuts: dict[str, float] = field(default_factory=dict)  # threshold by language

    def tables(self) -> list[list[np.ndarray]]:
        """Response of every bucket at every place of every filter: convolving is looking up and adding."""
        return [[(self.emb @ f[k]).astype(np.float32) for k in range(len(f))] for f in self.filters]

    def pooled(self, tables, words: np.ndarray, heads: np.ndarray, counts: np.ndarray, places: bool = False):
        """Strongest response of each filter in each text (0 without words), and its place if asked for."""
        n, docs = len(words), len(counts)
        best = np.zeros((docs, len(self.bias)), np.float32)
        where = np.zeros((docs, len(self.bias)), np.int64)
        full = np.flatnonzero(counts)
        if not n:
            return best, where
        at = np.concatenate(([0], np.cumsum(counts[full])[:-1])).astype(np.int64)
        last = np.repeat(np.cumsum(counts), counts)
        for w, (width, table) in enumerate(zip(WIDTHS, tables)):
            r = table[0][words] + table[0][heads]
            for k in range(1, width):
                inside = np.arange(n - k) + k < last[:n - k]
                r[:n - k] += (table[k][words[k:]] + table[k][heads[k:]]) * inside[:, None]
            cols = slice(w * FILTERS, (w + 1) * FILTERS)
            top = np.maximum.reduceat(r, at, axis=0)
            best[full, cols] = top + self.bias[cols].astype(np.float32)
            if places:
                for j, (a, c) in enumerate(zip(at, counts[full])):
                    where[full[j], cols] = a + r[a:a + c].argmax(0)
        return np.maximum(best, 0), where

    def logit(self, texts: pa.Array) -> np.ndarray:
        tables, parts = self.tables(), []
        for _, raw, off in text_chunks(texts):
            parts.append(self.pooled(tables, *word_buckets(raw, off))[0] @ self.out + self.base)
        return np.concatenate(parts) if parts else np.zeros(0)

    def score(self, texts: pa.Array) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logit(texts) + b, -30, 30)))


def _log_odds(words, heads, counts, y: np.ndarray) -> np.ndarray:
    """How much more often each bucket occurs in label 1 than in label 0, by documents; the first embedding column."""
    doc = np.repeat(np.arange(len(counts)), counts)
    seen = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for ids in (words, heads):
        pair = np.unique(doc.astype(np.int64) * BUCKETS + ids)
        for k in (0, 1):
            seen[k] += np.bincount((pair % BUCKETS)[y[pair // BUCKETS] == k], minlength=BUCKETS)
    p = [(s + 0.5) / (max(1, (y == k).sum()) + 1) for k, s in enumerate(seen)]
    return np.clip(np.log(p[1] / p[0]), -2, 4)


def fit(texts: pa.Array, y: np.ndarray, langs: list[str | None], seed: int = 7) -> Network:
    """Adagrad on the logistic loss; gradients flow through the places that won the pooling.

    Every fifth row is kept from training; it sets the scale of the logit and the threshold of each language (the
    one with the best F1 among its rows). Without both labels the score is the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    net = Network(filters=[rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS])
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(np.unique(y)) < 2:
        net.base = float(np.log(share / (1 - share)))
        return net
    held = np.arange(len(y)) % 5 == 4
    ids = [word_buckets(raw, off) for _, raw, off in text_chunks(texts)]
    words, heads, counts = (np.concatenate(v) for v in zip(*ids))
    ends = np.cumsum(counts)
    span = lambda d: slice(ends[d] - counts[d], ends[d])
    take = lambda v, docs: np.concatenate([v[span(d)] for d in docs]) if len(docs) else v[:0]
    train = np.flatnonzero(~held)
    net.emb = rng.normal(0, 0.02, (BUCKETS, DIM))
    net.emb[:, 0] = _log_odds(take(words, train), take(heads, train), counts[train], y[train]) / 4
    for f in net.filters:
        f[:, 0, :] = rng.uniform(0.2, 0.6, f[:, 0, :].shape) * (np.arange(len(f)) == 0)[:, None]
        f[:, 0, :] += 0.05
    net.out[:] = 0.3
    net.base = float(np.log(share / (1 - share)))
    sums = {k: 1e-6 for k in ("emb", "bias", "out", "base", 0, 1, 2)}
    sums["emb"] = np.full((BUCKETS, DIM), 1e-4)

    def move(key, grad, rate=STEP):
        sums[key] = sums[key] + grad**2
        return rate * grad / np.sqrt(sums[key])

    for _ in range(EPOCHS):
        for chosen in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            w, h, c = take(words, chosen), take(heads, chosen), counts[chosen]
            best, where = net.pooled(net.tables(), w, h, c, places=True)
            error = 1 / (1 + np.exp(-np.clip(best @ net.out + net.base, -30, 30))) - y[chosen]
            back = error[:, None] * net.out * (best > 0) / len(chosen)
            last = np.cumsum(c)
            emb_grad = np.zeros((BUCKETS, DIM))
            steps = []
            for k, width in enumerate(WIDTHS):
                g = back[:, k * FILTERS:(k + 1) * FILTERS]
                grad = np.zeros_like(net.filters[k])
                for place in range(width):
                    at = where[:, k * FILTERS:(k + 1) * FILTERS] + place
                    ok = (at < last[:, None]) & (g != 0)
                    d, j = np.nonzero(ok)
                    if not len(d):
                        continue
                    pos = at[d, j]
                    np.add.at(grad[place].T, j, g[d, j][:, None] * (net.emb[w[pos]] + net.emb[h[pos]]))
                    flow = g[d, j][:, None] * net.filters[k][place].T[j]
                    np.add.at(emb_grad, w[pos], flow)
                    np.add.at(emb_grad, h[pos], flow)
                steps.append(grad)
            net.out -= move("out", best.T @ error / len(chosen) + 1e-4 * net.out)
            net.base -= float(move("base", float(error.mean())))
            net.bias -= move("bias", back.sum(0))
            net.emb -= move("emb", emb_grad)
            for k, grad in enumerate(steps):
                net.filters[k] -= move(k, grad)
    rest = np.flatnonzero(held)
    z = net.pooled(net.tables(), take(words, rest), take(heads, rest), counts[rest])[0] @ net.out + net.base
    net.scale = _platt(z, y[rest])
    p = 1 / (1 + np.exp(-np.clip(net.scale[0] * z + net.scale[1], -30, 30)))
    lang = np.array([v or "" for v in langs], object)[rest]
    for name in sorted(set(lang)):
        net.cuts[name] = _best_cut(p[lang == name], y[rest][lang == name])
    return net


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate the logit, by Newton steps with smoothed targets."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    x = np.stack([z, np.ones(len(z))], 1)
    v = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        v = v - np.clip(np.linalg.solve(hess, x.T @ (p - t)), -1, 1)
    return (float(v[0]), float(v[1])) if v[0] > 0 else (1.0, 0.0)


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of the gap it lies in; CUT where a language has no examples."""
    if not y.sum():
        return CUT
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + low) / 2)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Network:
    """Fit on at most ``max_train`` whole labelled texts whose crc32 bucket of 4 is not 2, by digest of the identifier.

    Several label rows of a document count by their maximum. The language of a training row is used for the
    thresholds alone.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 4) != 2))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    rows = docs.select("doc_id", "text", "lang").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    texts = pa.chunked_array([c.cast(pa.large_string()) for c in rows["text"].chunks], pa.large_string())
    return fit(texts, rows["y"].to_numpy().astype(int), rows["lang"].to_pylist())


def toxicity_score(net: Network, text: Column | str = "text") -> Column:
    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(net.score(texts))
    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged), one row per row of ``docs``.

    ``score`` depends on the text alone (null counts as empty); ``predicted`` is 1 from a score of 0.3. ``flagged``
    compares the score with the threshold calibrated for the document's language (0.3 for languages without any).
    ``held_out`` marks crc32 bucket 2 of 4, from which no label is learned; a null identifier is not held out. An
    empty table gives no rows; without usable labels the score is 0.5.
    """
    net = train(docs, labels, max_train)
    cut = F.lit(CUT)
    for name, value in net.cuts.items():
        cut = F.when(F.coalesce("lang", F.lit("")) == name, F.lit(value)).otherwise(cut)
    d = docs.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), toxicity_score(net).alias("score"),
                    cut.alias("threshold"))
    return d.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold",
                    (F.col("score") >= F.col("threshold")).alias("flagged"))
