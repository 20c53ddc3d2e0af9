"""What the near-duplicate join writes and shuffles besides its result."""
import os
import random

import numpy as np
from pyspark.sql import functions as F

from tapeworks.llm import near
from tapeworks.session import shared_folder

from .conftest import prose


def pair_among_others(rng):
    text = prose(rng, 200)
    return [(k, prose(rng, 60)) for k in range(40)] + [(100, text), (101, text + " more")]


def test_only_nodes_with_shared_coordinates_get_postings(make):
    docs = make(pair_among_others(random.Random(31)))
    _, nodes = near.representatives(near.signatures(docs))
    matches = near.match_threshold(85)
    got = {r.node: r for r in near.rare_prefix(nodes, matches).collect()}
    assert set(got) == {100, 101}
    same = sum(a == b for a, b in zip(got[100].sig, got[101].sig))
    assert got[100].tokens == got[101].tokens and len(got[100].tokens) == same - matches + 1


def test_rarest_coordinates_come_first(spark, make):
    rng = random.Random(32)
    often, seldom = prose(rng, 120), prose(rng, 120)
    docs = make([(k, f"{often} {prose(rng, 30)}") for k in range(6)] + [(k, f"{often} {seldom} {prose(rng, 3)}") for k in (6, 7)])
    _, nodes = near.representatives(near.signatures(docs))
    n = {}
    for r in nodes.collect():
        for k, v in enumerate(r.sig):
            n[k, v] = n.get((k, v), 0) + 1
    token = spark.createDataFrame(list(n), "k int, v int").select("k", "v", F.xxhash64("k", "v").alias("t")).collect()
    count = {r.t: n[r.k, r.v] for r in token}
    rows = near.rare_prefix(nodes, 8).collect()
    assert rows
    for r in rows:
        order = [(count[t], t) for t in r.tokens]
        every = sorted((count[x.t], x.t) for x in token if r.sig[x.k] == x.v and count[x.t] > 1)
        assert order == every[:len(every) - 7]


def test_bit_map_passes_all_keys_and_few_others(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    others = spark.range(10_000, 20_000).select(F.xxhash64("id").alias("h")).toArrow()["h"].to_numpy()
    held = near._may_hold(keys)
    assert held(keys.toArrow()["h"].to_numpy()).all() and held(others).mean() < 0.05
    assert not near._may_hold(keys.limit(0))(np.array([0, -1, 42])).any()


def test_tables_of_the_way_are_deleted(spark, make):
    docs = make(pair_among_others(random.Random(33)) + [(200 + k, "one passage that many share " * 3 + f"{k}") for k in range(5)])
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    left = near.drop_near(docs)
    assert len(set(os.listdir(folder)) - before) <= 2  # which rows stay, and which are dropped
    assert {r.doc_id for r in left.collect()} >= {*range(40), 100} and left.where("doc_id = 101").isEmpty()
