"""Best-fit packing of tokenised documents under several capacities."""
from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeworks.llm.words import release, text_chunks
from tapeworks.session import materialise

END = 2
GROUP = 1 << 13  # pieces that are packed together
CACHE = 1 << 23  # bytes of chunks of text and their ids that a worker remembers
_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_ODD = re.compile("[\x1c-\x1f]")


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold: tokens, documents, and attention cost (sum of squared piece lengths).

    ``weights`` scale the three loads when bins are compared; ``rule`` is ``norm`` (smallest weighted residual norm)
    or ``dot`` (largest weighted dot product of load and residual).
    """
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.001, 0.01)
    rule: str = "norm"


class _Ids(dict):
    """Ids of a chunk of text as little-endian bytes, computed on first sight and remembered while there is room."""

    def __init__(self, encoding, added: dict[str, int]) -> None:
        super().__init__()
        self.encoding, self.room = encoding, CACHE
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        longest = sorted(map(re.escape, added), key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(longest)})").split if added else None

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(chunk), "<u4").tobytes()
        if self.room > 0:
            self[chunk] = ids
            self.room -= len(chunk) + len(ids)
        return ids


@lru_cache(1)
def _tokenizer(path: str) -> _Ids:
    """The byte-level merges of a tokenizer file, run by rank, which gives the same ids several times as fast.

    The file's own pattern decides where merges stop. A text falls apart at the file's added tokens, which have ids of
    their own, and before every space that follows a visible character, so chunks of it can be remembered.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    tokens = spec.get("added_tokens", [])
    if any(t.get(k) for t in tokens for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take blanks with them are not supported")
    added = {t["content"]: t["id"] for t in tokens}
    ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
    return _Ids(tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), added)


def _plain_bytes(text: str, ids: _Ids) -> bytes:
    if _ODD.search(text):  # control characters on which two meanings of "space" differ
        return np.array(ids.encoding.encode_ordinary(text), "<u4").tobytes()
    return b"".join(map(ids.__getitem__, _PIECE.findall(text)))


def token_bytes(text: str, ids: _Ids) -> bytes:
    """Ids of the text, then the end id, as little-endian 32-bit values."""
    tail = np.array([END], "<u4").tobytes()
    if ids.split is None:
        return _plain_bytes(text, ids) + tail
    return b"".join(ids.added.get(part) or _plain_bytes(part, ids) for part in ids.split(text)) + tail


def pieces(docs: DataFrame, tokenizer: str, tokens: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), at most ``tokens`` ids each; a longer document has a shorter first piece.

    Texts are taken in stretches of bounded size (a longer text is one of its own), and each stretch's pieces leave as
    flat columns, so a task holds little beside its Arrow batch.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what this worker's earlier tasks kept
        ids = _tokenizer(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0)
            for row, raw, off in text_chunks(batch.column(1)):
                counts, first, crc = [], [], []
                for a, b in zip(off, off[1:]):
                    data = token_bytes(raw[a:b].tobytes().decode(), ids)
                    n = len(data) // 4
                    cuts = [0, *range(n % tokens or tokens, n + 1, tokens)]
                    counts.append(len(cuts) - 1), first.extend(cuts)
                    crc.extend(zlib.crc32(data[4 * x:4 * y]) for x, y in zip(cuts, cuts[1:]))
                counts, first = np.array(counts), np.array(first)
                ends = np.cumsum(counts + 1) - 1  # each text's last bound
                start = np.delete(first, ends)
                length = np.delete(np.append(first[1:], 0) - first, ends)
                owner = np.repeat(np.arange(len(counts)), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(row + owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                     pa.array(np.array(crc, np.int64))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: longest first, each into the open bin that fits best under every capacity."""
    order = np.argsort(-lengths, kind="stable")
    size = np.array([cap.tokens, cap.documents, cap.attention], float)
    weight = np.array(cap.weights)
    load = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / size
    left = np.ones((len(lengths), 3))
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = np.zeros(len(lengths), np.int64)
    smallest = lengths.min() if len(lengths) else 0
    live, opened = np.zeros(0, np.int64), 0
    for i in order:
        need = load[i]
        room = left[live]
        fits = np.flatnonzero((room >= need - 1e-12).all(1)) if len(live) else live
        if len(fits):
            after = room[fits]
            if cap.rule == "dot":
                pick = fits[np.argmax((after * need * weight).sum(1))]
            else:
                pick = fits[np.argmin((((after - need) ** 2) * weight).sum(1))]
            b = live[pick]
        else:
            b, opened = opened, opened + 1
            live = np.append(live, b)
            pick = len(live) - 1
        bins[i], offset[i] = b, used[b]
        used[b] += lengths[i]
        left[b] -= need
        if cap.tokens - used[b] < smallest or left[b, 1] * cap.documents < 0.5:
            live = np.delete(live, pick)
    return bins, offset


def pack(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece of each document.

    Null and empty texts are one end token. Only documents of more than ``cap.tokens`` ids are cut. Repeated rows
    are documents of their own. An empty table gives no rows; other columns play no part. Pieces are dealt at random
    into groups of about GROUP, and each group is packed by itself; a group leaves about one sequence half empty.
    """
    if cap.documents < 1 or cap.attention < cap.tokens ** 2:
        raise ValueError("a full piece must fit into an empty sequence")
    cut = materialise(pieces(docs, tokenizer, cap.tokens).withColumn("row", F.monotonically_increasing_id()))
    groups = -(-cut.count() // GROUP) or 1
    cut = cut.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def fill(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "piece", "row"], kind="stable")
        bins, offset = best_fit(p["length"].to_numpy(), cap)
        return p.assign(sequence_id=p["group"].to_numpy() * (1 << 24) + bins, offset=offset).drop(columns=["group", "row"])

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return cut.groupBy("group").applyInPandas(fill, kind)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
