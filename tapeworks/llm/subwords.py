"""SentencePiece ids and texts, by a table of the distinct marked words of each stretch of texts."""
from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tapeworks.llm.words import text_chunks

MARK = "▁"
STRETCH = 1 << 22  # bytes of text with one table of distinct words
REMEMBERED = 48 << 20  # bytes of words and ids that a worker carries from stretch to stretch


class Encoder:
    """A model with the words it has segmented so far."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_word = separable(self.model)
        if self.by_word:
            alone = self.model.encode("x ")[len(self.model.encode("x")):]
            self.alone = array("i", alone).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def segment(self, words: list[bytes]) -> list[bytes]:
        """Ids (32-bit) of distinct words, each of which begins with a marker (a space or the marker itself)."""
        new = [w for w in words if w not in self.known]
        if self.held > REMEMBERED:
            self.known, self.held, new = {}, 0, words
        # the model puts a marker before what it encodes, which stands for the word's first one
        texts = [(w[1:] if w[0] == 32 else w[3:]).decode() for w in new]
        for w, t, ids in zip(new, texts, self.model.encode(texts, num_threads=1)):
            self.known[w] = array("i", ids).tobytes() if t else self.alone
            self.held += 200 + len(w) + 4 * len(ids)
        return [self.known[w] for w in words]

    def stretches(self, texts: pa.Array, end: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of consecutive texts, number of ids of each); null is the empty text. ``end`` adds the model's end id."""
        for _, raw, off in text_chunks(texts, STRETCH):
            if self.by_word:
                ids, n = self._joined(raw, off)
            else:
                lists = self.model.encode([raw[a:b].tobytes().decode() for a, b in zip(off, off[1:])], num_threads=1)
                ids, n = np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists])
            yield (np.insert(ids, np.cumsum(n), self.model.eos_id()), n + 1) if end else (ids, n)

    def _joined(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), from the distinct words of these texts."""
        full = np.diff(off) > 0
        raw = np.insert(raw, off[:-1][full], 32)  # the marker before a text
        off = off + np.concatenate(([0], np.cumsum(full)))
        mark = raw == 32
        begin = mark.copy()
        long = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81))
        begin[long] = True
        for k in range(3):
            mark[long + k] = True
        begin[1:] &= ~mark[:-1]
        begin[off[:-1][full]] = True
        starts = np.flatnonzero(begin)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        bounds = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
        table = self.segment(words.dictionary.to_pylist())
        place = words.indices.to_numpy()
        length = np.fromiter(map(len, table), np.int64, len(table)) // 4
        first = np.cumsum(length) - length
        each = length[place]
        upto = np.cumsum(each)
        ids = np.frombuffer(b"".join(table), np.int32)[np.repeat(first[place] - (upto - each), each) + np.arange(upto[-1])]
        return ids, np.diff(np.concatenate(([0], upto))[np.searchsorted(starts, off)])

    def decode(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """Texts of consecutive lists of ids, by the model's own decoding."""
        upto = np.cumsum(n)
        return pa.array([self.model.decode(ids[b - k:b].tolist()) for k, b in zip(n, upto)], pa.string())


def _lists(flats: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], *sizes]).cumsum().astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *flats])))


def separable(model) -> bool:
    """Whether a text may be segmented word by word: no piece holds a marker after another character, texts reach the
    model unchanged but for one marker before them, and the marker is a piece of its own."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    n = proto.normalizer_spec
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
    inside = re.compile(f"[^{MARK}]{MARK}")
    return bool(plain and not proto.trainer_spec.treat_whitespace_as_suffix and not proto.HasField("denormalizer_spec")
                and model.piece_to_id(MARK) != model.unk_id() and not any(inside.search(p.piece) for p in proto.pieces))


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(text: Column | str, model: str, end: bool = True) -> Column:
    """Ids of a text (null: empty), with the end id last."""
    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        found = list(_encoder(model).stretches(texts, end))
        return _lists([i for i, _ in found], [n for _, n in found])

    return ids(text)


def decoded(ids: Column | str, model: str) -> Column:
    """Text of a list of ids; null stays null."""
    @arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _encoder(model).model.decode(x) for x in map(pa.ListScalar.as_py, lists)], pa.string())

    return text(ids)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded), one row per row of ``docs``: the ids of its text and what they decode to.

    Texts are whole, however long. Where the model's pieces cannot cross whitespace markers, each distinct marked word
    of a stretch of texts is segmented once (words of earlier stretches are remembered) and the ids are joined back by
    position; with other models whole texts are encoded. Null and empty texts have the end id alone and decode to the
    empty text. Repeated rows and null identifiers are rows like others; other columns play no part; an empty table
    gives no rows. Nothing is shuffled.
    """
    @arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(text: pa.Array) -> pa.Array:
        e, flats, sizes, texts = _encoder(model), [], [], []
        for ids, n in e.stretches(text):
            flats.append(ids), sizes.append(n), texts.append(e.decode(ids, n))
        back = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
        return pa.StructArray.from_arrays([_lists(flats, sizes), back], ["ids", "decoded"])

    return docs.select("doc_id", both("text").alias("__r")).select("doc_id", "__r.ids", "__r.decoded")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip``."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return round_trip(docs, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                                          F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")
