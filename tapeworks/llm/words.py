"""Words and shingles of Arrow text columns as numpy arrays of 64-bit hashes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21  # bytes of text that are worked on at once; a longer text is one chunk of its own
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_OF = np.where(_BLANK, np.uint64(0), _BYTE[_FOLD])  # blanks add nothing; A-Z count as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK
    while size < n:
        size *= 2
    if size not in _powers:
        _powers.clear()
        pair = []
        for base in (_STEP, _BACK):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        _powers[size] = tuple(pair)
    return _powers[size]


def release() -> None:
    """Let go of the tables that earlier texts needed, and of Arrow's unused memory."""
    _powers.clear()
    pa.default_memory_pool().release_unused()


def text_chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with at most ``limit`` bytes, or one longer row; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, raw[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position of each word, number of words of each text); words are runs without ASCII blanks."""
    dark = ~_BLANK[raw]
    first = dark.copy()
    first[1:] &= ~dark[:-1]
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] = dark[edge]
    starts = np.flatnonzero(first)
    return starts, np.diff(np.searchsorted(starts, off))


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z as a-z, number of words of each text)."""
    starts, counts = word_bounds(raw, off)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    up, down = _power_table(len(raw))
    sums = np.add.reduceat(_BYTE_OF[raw] * up[:len(raw)], starts)
    return mixed(sums * down[starts]), counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` words, number of runs of each text).

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    out = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if not len(words):
        return np.zeros(0, np.uint64), out
    n = len(words)
    padded = np.concatenate((words, np.zeros(width - 1, np.uint64)))
    full = sum(padded[k:k + n] * _PLACE[k] for k in range(width))
    last = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = np.arange(n) + width <= last[doc]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        at = last[d] - counts[d]
        full[at] = (words[at:last[d]] * _PLACE[:counts[d]]).sum(dtype=np.uint64) + np.uint64(counts[d])
        ok[at] = True
    return mixed(full[ok]), out
