"""Vector codes against plain distances to every entry."""
import hashlib

import numpy as np
import pytest

from tapeworks.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, part string, __label string"


def brute(rows, parts, entries, rounds):
    """The contract, one vector after the other, in Python integers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width:(p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in sorted(kept)[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[nearest(cut(v)[p], books[p])].append(cut(v)[p])
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(own, books[p])]
    out = {}
    for i, v, lab in kept:
        e = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        out[i] = ("".join(f"{k:02x}" for k in e), sum(far(x, books[p][k]) for p, (x, k) in enumerate(zip(cut(v), e))), lab)
    digest = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    total = {}
    for _, err, lab in out.values():
        total[lab] = total.get(lab, 0) + err
    return {i: (c, err, total[lab], digest, lab) for i, (c, err, lab) in out.items()}


@pytest.mark.parametrize("n,k,dim,parts,leaf,span", [(700, 64, 4, 16, 16, 200), (41, 5, 3, 2, 4, 2), (1, 1, 1, 1, 16, 5),
                                                      (600, 64, 4, 4, 8, 1), (3, 64, 2, 8, 16, 50), (257, 7, 5, 3, 1, 30)])
def test_two_trees_equal_all_distances(n, k, dim, parts, leaf, span):
    rng = np.random.default_rng(n + k)
    x = rng.integers(-span, span + 1, (parts, n, dim))
    e = x[:, rng.integers(0, n, k)].copy()  # entries repeat, so ties occur
    far = ((x[:, :, None] - e[:, None]) ** 2).sum(-1)
    want = far.argmin(2)
    got, totals = codes.dual_tree(x, e, leaf)
    assert (got == want).all()
    for p in range(parts):
        for j in range(k):
            own = x[p][want[p] == j]
            assert (totals[p, j, :dim] == own.sum(0)).all() and totals[p, j, dim] == len(own)
    assert (codes.dual_tree(x, e, leaf, codes=False)[1] == totals).all()


def test_whole_nodes_are_settled_by_their_sums(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (1, 8, 3)) * 100
    x = (centres[:, rng.integers(0, 8, 500)] + rng.integers(-3, 4, (1, 500, 3)))
    monkeypatch.setattr(codes, "_measure", lambda *a: pytest.fail("far clusters need no measuring"))
    got, totals = codes.dual_tree(x, centres, 1)
    assert totals[..., -1].sum() == 500 and (centres[0][got[0]] - x[0] <= 3).all()


def test_query_against_the_contract(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.3, 12))], int(i) % 3 or None) for i in rng.permutation(150)]
    odd = [(500, None, 1), (501, [1.0] * 11 + [None], 1), (502, [float("nan")] * 12, 2), (503, [float("inf")] + [0.0] * 11, 2)]
    table = spark.createDataFrame([(*r, "c", 1, "p", "l") for r in rows + odd], SCHEMA).repartition(5)
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256, r.label)
           for r in codes.vector_codes(table, parts=4, entries=9).collect()}
    assert got == brute(rows, 4, 9, 2)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert codes.vector_codes(empty).collect() == []
    assert codes.vector_codes(spark.createDataFrame([(1, None, 1, *"c1pl"[:0], "c", 1, "p", "l")], SCHEMA)).collect() == []
    same = [0.5, -0.25] * 16
    rows = [(1, same, None), (1, same, None), (None, same, 4), (2, same[:20], 4), (3, [], None), (-9, [3e38] * 32, 5)]
    out = codes.vector_codes(spark.createDataFrame([(*r, "c", 1, "p", "l") for r in rows], SCHEMA)).collect()
    assert len(out) == len(rows) and all(r.error == 0 for r in out)  # every vector is an entry
    assert {r.code for r in out if r.vec_id == 1} == {"01" * 16}  # ties fall to the lower index
    assert {r.label_error for r in out} == {0}


def test_more_rows_than_a_label_can_hold_in_one_group(spark):
    table = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 32), i -> cast((id * i) % 17 / 17.0 as float)) AS embedding",
                                         "cast(if(id % 3 > 0, 7, id) as int) AS label")
    out = codes.vector_codes(table).selectExpr("sum(error) e", "count(distinct label) n", "sum(if(label = 7, error, 0)) s",
                                               "max(if(label = 7, label_error, 0)) t").first()
    assert out.n == 1001 and out.s == out.t


def test_codes_approximate_their_vectors(spark):
    table = spark.createDataFrame([(i, [float((i * j) % 7) for j in range(16)], 0) for i in range(80)],
                                  "vec_id long, embedding array<double>, label int")
    books = codes.fit(table, parts=8, entries=32)
    rows = codes.decode(codes.encode(table, books), books).collect()
    for r in rows:
        assert sum((256 * a - 256 * b) ** 2 for a, b in zip(r.embedding, r.approximation)) == pytest.approx(r.error)
