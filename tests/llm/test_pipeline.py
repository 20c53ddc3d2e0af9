"""The pipeline's stages, each against a plain version of its rule on what the stage before kept."""
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeworks.llm import mixing, packing, quality

from .test_results import brute_components, lower

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def test_columns_stay_until_the_last(spark, staged):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert staged[name][0].__fields__ == columns
        assert set(staged[name]) <= set(staged["documents"])


def test_quality_stage_follows_the_score(spark, staged):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = quality.score_quality(docs, labels).collect()
    assert {r.doc_id for r in staged["quality_classifier"]} == {r.doc_id for r in scores if r.score >= 0.7}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = {r.doc_id for r in staged["quality_classifier"]}
    assert len(good & kept) >= 0.97 * len(good)


def test_dedup_stages(staged):
    groups = {}
    for r in staged["quality_classifier"]:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    assert {r.doc_id for r in staged["exact_dedup"]} == {max(v) for v in groups.values()}
    label = brute_components([(r.doc_id, r.text) for r in staged["exact_dedup"]], 80)
    assert {r.doc_id for r in staged["minhash_near_dedup"]} == {i for i, (_, c) in label.items() if i == c}


def test_mix_stage_takes_whole_documents(spark, staged):
    docs = spark.createDataFrame(staged["minhash_near_dedup"], spark.read.parquet(f"{SF}/documents.parquet").schema)
    want = Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
    assert Counter(r.doc_id for r in staged["source_mixing"]) == want and max(want.values()) <= mixing.CAP


def test_packed_pieces_cover_the_mix(staged):
    ids = packing._tokenizer(packing.default_tokenizer())
    pieces = Counter()
    for r in staged["source_mixing"]:
        n = len(packing.token_bytes(r.text or "", ids)) // 4
        first = n % 1024 or 1024
        bounds = [0, *range(first, n + 1, 1024)]
        data = packing.token_bytes(r.text or "", ids)
        pieces.update((r.doc_id, a, zlib.crc32(data[4 * a:4 * b])) for a, b in zip(bounds, bounds[1:]))
    got = staged["best_fit_packing"]
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in got) == pieces
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in places.values():
        v.sort()
        assert [o for o, _ in v] == list(np.cumsum([0, *(n for _, n in v)])[:-1]) and sum(n for _, n in v) <= 1024


def test_run_is_the_last_stage(spark, staged):
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF).select(*keys).collect()
    assert Counter(got) == Counter(tuple(r[k] for k in keys) for r in staged["best_fit_packing"])
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == sum(r.length for r in staged["best_fit_packing"])
