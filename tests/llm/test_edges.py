"""Every operator and stage on odd rows, on empty tables and with clashing column names."""
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeworks.llm import classlm, exact, imatch, mixing, near, packing, quality, secrets, templates, toxicity

TOK = packing.default_tokenizer()
PER_ROW = {
    "fingerprints": lambda d, l: imatch.edited_fingerprints(d),
    "own_fingerprints": lambda d, l: imatch.text_fingerprints(d),
    "toxicity": toxicity.score_toxicity,
    "quality": quality.score_quality,
    "exact": lambda d, l: exact.exact_duplicates(d),
    "secrets": lambda d, l: secrets.find_secrets(d),
    "class_lm": lambda d, l: classlm.corpus_scores(d),
    "mix": lambda d, l: mixing.mix(d),
    "near": lambda d, l: near.near_duplicates(d, 85),
    "lines": lambda d, l: templates.line_report(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(name, odd, odd_rows, some_labels):
    out = PER_ROW[name](odd, some_labels)
    rows = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in odd_rows)
    assert len(set(out.columns)) == len(out.columns)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(name, nothing, some_labels):
    assert PER_ROW[name](nothing, some_labels).collect() == []


def test_no_labels(odd, odd_rows, some_labels):
    for score in (quality.score_quality, toxicity.score_toxicity):
        got = score(odd, some_labels.limit(0)).select("score").distinct().collect()
        assert [r.score for r in got] == [0.5]


FILTERS = {"exact": lambda d, l: exact.drop_exact(d), "near": lambda d, l: near.drop_near(d), "mixed": lambda d, l: mixing.mixed(d),
           "quality": quality.keep_good, "lines": lambda d, l: templates.drop_recurring_lines(d)}


@pytest.mark.parametrize("name", FILTERS)
def test_stages_keep_the_columns(name, odd, nothing, some_labels):
    assert FILTERS[name](odd, some_labels).schema.names == odd.schema.names
    assert FILTERS[name](nothing, some_labels).collect() == []
    before = {tuple(r) for r in odd.drop("text").collect()}
    assert {tuple(r) for r in FILTERS[name](odd, some_labels).drop("text").collect()} <= before


def test_exact_stage_keeps_one_of_each(odd):
    kept = exact.drop_exact(odd).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t")).collect()
    assert len(kept) == len({r.t for r in kept})
    assert {r.t for r in kept} == {r.t for r in odd.select(F.lower(F.coalesce("text", F.lit(""))).alias("t")).collect()}


def test_packing_edges(odd, odd_rows, nothing):
    assert packing.pack(nothing, TOK).collect() == []
    rows = packing.pack(odd, TOK).collect()
    assert sum(r.piece == 0 for r in rows) == len(odd_rows)
    assert sum(r.length == 1 and r.start == 0 and r.piece == 0 for r in rows) == 3  # two nulls, one empty


def test_stages_are_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "source_mixing",
                                                      "best_fit_packing"]


def test_fingerprints_of_wide_identifiers(make):
    """Negative, 64-bit and far-off identifiers: each document's next one is the next smaller identifier."""
    ids = [-6 * 10**18, -5, 0, 3, 2**53 + 1, 2**53 + 2, 6 * 10**18, 2**63 - 1]
    docs = make([(i, f"text number {k} of eight with words w{k} v{k}") for k, i in enumerate(ids)])
    texts = {i: f"text number {k} of eight with words w{k} v{k}" for k, i in enumerate(ids)}
    order = sorted(ids, reverse=True)
    for r in imatch.edited_fingerprints(docs).collect():
        own, following = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(own) // 2
        assert r.edited_sha256 == hashlib.sha256((own[:len(own) - half] + following[:half]).encode()).hexdigest()
