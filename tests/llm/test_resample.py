"""Resampling against plain Python: features, weights, the draw and its order."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import resample

from .conftest import prose


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [" ".join(w[i:i + r]) for r in (1, 2, 3) for i in range(len(w) - r + 1)]


def brute(rows, target, percent=5, least=20):
    place = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(place(f) for _, t in rows for f in features(t)[1])
    t = Counter(place(f) for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, text in rows:
        words, f = features(text)
        weight = sum(gain(place(x)) for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((len(words), i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-score, i is None, i or 0) for n, i, _, _, score in out if n >= least)
    drawn = able[:percent * len(able) // 100]
    return sorted(((i, nf, w, sc) for _, i, nf, w, sc in out), key=repr), [(-a, None if void else i) for a, void, i in drawn]


def test_buckets_of_features():
    r = random.Random(3)
    texts = ["", None, "a", "a b", "A b c", "x" * 200 + " y " + "z" * 65 + " q" + "é" * 40, "ÄÖ ß 12 é_x", "  "] + [
        " ".join("".join(r.choice("abcXYZ019é\U0001F600-") for _ in range(r.randint(1, r.choice([3, 90])))) for _ in range(r.randint(0, 60)))
        for _ in range(200)]
    for first, raw, off in resample.text_chunks(pa.array(texts), 5000):
        place, owner, counts = resample.buckets(raw, off)
        for d in range(len(counts)):
            words, f = features(texts[first + d])
            got = np.concatenate([p[o == d] for p, o in zip(place, owner)])
            assert counts[d] == len(words) and sorted(got.tolist()) == sorted(zlib.crc32(x.encode()) % 10000 for x in f)


def check(out, rows, target, **kw):
    rest, drawn = brute(rows, target, **kw)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in out), key=repr) == rest
    ranked = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.score, r.doc_id) for r in ranked] == drawn


def test_against_brute_force(make, spark):
    rng = random.Random(11)
    rows = [(k * 7 - 300, prose(rng, rng.randint(0, 60))) for k in range(400)]
    rows += [(9001, rows[5][1]), (9002, rows[5][1]), (9002, rows[5][1]), (None, rows[7][1]), (-(2**62), prose(rng, 40))]
    target = [rows[k][1] for k in range(0, 40, 4)] + [None, ""]
    goal = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, score string")
    docs = make(rows).repartition(13)
    check(resample.resample(docs, goal).collect(), rows, target)
    check(resample.resample(docs, goal, percent=60, least_words=3).collect(), rows, target, percent=60, least=3)
    check(resample.resample(docs, goal.limit(0), percent=100).collect(), rows, [], percent=100)


def test_odd_rows(odd, odd_rows, nothing, spark):
    goal = spark.createDataFrame([("one two three",)], "text string")
    check(resample.resample(odd, goal, percent=50).collect(), [r[:2] for r in odd_rows], ["one two three"], percent=50)
    assert resample.resample(nothing, goal).collect() == []


@pytest.mark.parametrize("n,parts", [(1, 1), (2, 2), (5, 5), (700, 9)])
def test_cutoff_is_exact_with_ties(spark, n, parts):
    rows = spark.range(0, n, 1, parts).select((F.col("id") % 4).alias("down"), F.lit(0).cast("long").alias("void"),
                                              (F.col("id") % 9).alias("id"), F.col("id").alias("row"))
    keys = sorted((k % 4, 0, k % 9, k) for k in range(n))
    for wanted in {1, 2, n // 20, n // 2, n - 1, n}:
        assert resample.cutoff(rows, wanted) == (keys[wanted - 1] if 0 < wanted <= n else None) or wanted > n
    assert resample.cutoff(rows, 0) is None


def test_weighted_median_splits_by_weight():
    assert resample.weighted_median([(1, (1, 0, 0, 0)), (1, (2, 0, 0, 0)), (5, (3, 0, 0, 0))]) == (3, 0, 0, 0)
    assert resample.weighted_median([(2, (1, 0, 0, 0)), (1, (2, 0, 0, 0)), (1, (3, 0, 0, 0))]) == (1, 0, 0, 0)
