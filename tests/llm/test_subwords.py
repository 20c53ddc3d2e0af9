"""SentencePiece ids and texts against the library on whole texts."""
import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece

from tapeworks.llm import subwords

MODEL = subwords.default_model()
ODD = ["", None, " ", "  ", "a ", " a", "a  b", "▁", "▁ ", "x▁y", "a▁ b", "<s></s> <0x0A> <unk>", "tab\tnew\nline\r\n", "é\U0001F600 \x00 z"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    r = random.Random(7)
    return ODD + ["".join(r.choice("abcde  ▁▁\n\té\U0001F600x,.0") for _ in range(r.randint(0, 50))) for _ in range(1500)]


@pytest.mark.parametrize("stretch,remembered", [(1, 1 << 20), (60, 300), (1 << 22, 1 << 20)])
def test_joined_words_equal_whole_texts(model, monkeypatch, stretch, remembered):
    monkeypatch.setattr(subwords, "STRETCH", stretch)
    monkeypatch.setattr(subwords, "REMEMBERED", remembered)
    e = subwords.Encoder(MODEL)
    assert e.by_word
    for end in (True, False):
        got = [i for ids, n in e.stretches(pa.array(texts()), end) for i in subwords._lists([ids], [n]).to_pylist()]
        assert got == [model.encode(t or "", add_eos=end) for t in texts()]


def test_each_distinct_word_is_segmented_once(model):
    e, calls = subwords.Encoder(MODEL), []
    whole = e.model

    class Counting:
        def __getattr__(self, name):
            return getattr(whole, name)

        def encode(self, words, **more):
            calls.extend(words)
            return whole.encode(words, **more)

    e.model = Counting()
    list(e.stretches(pa.array(["the cat and the dog and the cat"] * 50)))
    list(e.stretches(pa.array(["the dog"])))
    assert sorted(calls) == ["and", "cat", "dog", "the"]


def test_models_with_crossing_pieces_take_whole_texts(model):
    e = subwords.Encoder(MODEL)
    e.by_word = False
    (ids, n), = e.stretches(pa.array(ODD))
    assert subwords._lists([ids], [n]).to_pylist() == [model.encode(t or "", add_eos=True) for t in ODD]


def test_query_per_row(odd, odd_rows, nothing, model):
    rows = subwords.digests(odd, MODEL).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in odd_rows:
        ids = model.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in rows)
    assert subwords.digests(nothing, MODEL).collect() == []


def test_columns_encode_and_decode(make, model):
    docs = make([(k, t) for k, t in enumerate(ODD)])
    for r in docs.select("doc_id", subwords.encoded("text", MODEL).alias("ids")).select(
            "*", subwords.decoded("ids", MODEL).alias("back")).collect():
        ids = model.encode(ODD[r.doc_id] or "", add_eos=True)
        assert (r.ids, r.back) == (ids, model.decode(ids))
