"""Numeric features of whole texts for the quality model; bytes and words only, one pass over Arrow buffers."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from tapeworks.llm.words import text_chunks, word_bounds, word_hashes

NAMES = ["log_words", "mean_word", "longest_word", "upper", "digit", "symbol", "stop_mark", "comma", "blank", "high_byte",
         "cyrillic", "other_high", "byte_entropy", "distinct_words", "top_word", "adjacent_repeat", "longest_run",
         "log_lines", "words_per_line", "same_line", "symbol_word", "upper_word", "digit_word", "pair_repeat"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = True
_UPPER, _DIGIT, _LOW = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _DIGIT[48:58] = _LOW[97:123] = True


def _by_doc(values: np.ndarray, at: np.ndarray, full: np.ndarray, rows: int, how) -> np.ndarray:
    out = np.zeros(rows)
    if len(full):
        out[full] = how.reduceat(values, at)
    return out


def text_features(texts: pa.Array) -> np.ndarray:
    """One row per text, columns NAMES; null and empty texts give zeros."""
    parts = [_chunk_features(raw, off) for _, raw, off in text_chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def _chunk_features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows, size = len(off) - 1, np.diff(off)
    f = np.zeros((rows, len(NAMES)))
    if not len(raw):
        return f
    doc = np.repeat(np.arange(rows, dtype=np.int64) * 256, size)
    hist = np.bincount(doc + raw, minlength=rows * 256).reshape(rows, 256).astype(np.float64)
    share = hist / np.maximum(size, 1)[:, None]
    part = lambda keys: share[:, keys].sum(1)
    high = part(slice(128, 256))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    starts, counts = word_bounds(raw, off)
    h, _ = word_hashes(raw, off)
    n = len(h)
    full = np.flatnonzero(counts)
    at = np.concatenate(([0], np.cumsum(counts[full])[:-1])).astype(np.int64)
    words = np.maximum(counts, 1)
    f[:, 0] = np.log1p(counts)
    if n:
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        letters = np.add.reduceat((~blank).astype(np.int32), starts)
        owner = np.repeat(np.arange(rows), counts)
        f[:, 1] = _by_doc(letters, at, full, rows, np.add) / words
        f[:, 2] = np.log1p(_by_doc(letters, at, full, rows, np.maximum))
        for col, table in ((20, _SYMBOL), (21, _UPPER), (22, _DIGIT)):
            f[:, col] = _by_doc((np.add.reduceat(table[raw].astype(np.int32), starts) * 2 > letters).astype(float),
                                at, full, rows, np.add) / words
        order = np.lexsort((h, owner))
        hs, ds = h[order], owner[order]
        new = np.ones(n, bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        heads = np.flatnonzero(new)
        f[:, 13] = np.bincount(ds[heads], minlength=rows) / words
        top = np.zeros(rows)
        np.maximum.at(top, ds[heads], np.diff(np.append(heads, n)))
        f[:, 14] = top / words
        same = np.zeros(n, bool)
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        f[:, 15] = _by_doc(same.astype(float), at, full, rows, np.add) / words
        run = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        f[:, 16] = np.log1p(_by_doc(run, at, full, rows, np.maximum))
        pair = np.zeros(n, bool)
        pair[2:] = (h[2:] == h[:-2]) & (owner[2:] == owner[:-2])
        f[:, 23] = _by_doc(pair.astype(float), at, full, rows, np.add) / words
    for col, keys in ((3, _UPPER), (4, _DIGIT), (5, _SYMBOL), (6, [46]), (7, [44]), (8, [9, 10, 11, 12, 13, 32])):
        f[:, col] = part(keys)
    f[:, 9], f[:, 10], f[:, 11], f[:, 12] = high, part([0xD0, 0xD1]), part(slice(0xC4, 256)), entropy
    lines = hist[:, 10] + 1
    f[:, 17], f[:, 18] = np.log1p(hist[:, 10]), np.log1p(counts / lines)
    ends = np.flatnonzero(raw == 10)
    if len(ends):
        # equal neighbouring line lengths stand for repeated lines
        d = np.searchsorted(off, ends, "right") - 1
        length = np.diff(np.concatenate(([0], ends)))
        twin = np.zeros(len(ends))
        twin[1:] = (length[1:] == length[:-1]) & (d[1:] == d[:-1])
        f[:, 19] = np.bincount(d, twin, minlength=rows) / lines
    f[size == 0] = 0
    return f
