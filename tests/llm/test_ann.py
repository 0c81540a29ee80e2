import numpy as np
import pytest

from foldstore.llm import ann

R = np.random.default_rng(2)


def brute(rows, k, is_query):
    good = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, set()).add(tuple(np.float32(v).astype(float)))
    out = {}
    for q in (i for i in good if is_query(i)):
        d = sorted((min(float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())) for a in good[q] for b in good[i]), i) for i in good if i != q)
        out[q] = d[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    v = R.normal(size=(900, 8)) + R.integers(0, 5, (900, 1)) * 3
    out = [(i, v[i].tolist()) for i in range(900)]
    out += [(1000 + i, v[0].tolist()) for i in range(300)]  # one vector that a quarter of all rows share
    out += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] * 4), (2004, [float("inf")] * 8), (2005, [1.0] * 5), (None, v[3].tolist()), (7, v[7].tolist()), (100, v[101].tolist())]
    return out


def test_recall_and_exact_distances(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, 10, lambda i: i % 10 == 0)
    got = {}
    for r in ann.search(df, lambda c: c % 10 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and len({f[1] for f in found}) == 10 and q not in {f[1] for f in found}
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        true = dict((i, d) for d, i in want[q])
        hits += len(true.keys() & {f[1] for f in found})
        assert all(abs(true[i] - d) < 1e-12 for _, i, d in found if i in true)
    assert hits >= 0.9 * 10 * len(want)


def test_few_and_no_candidates(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], schema)
    got = [tuple(r)[:4] for r in ann.search(few, lambda c: c == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**0.5), (0, 2, 2, 2**0.5)]
    assert ann.search(few.limit(0), lambda c: c == 0).count() == 0
    assert ann.search(few.where("vec_id = 0"), lambda c: c == 0).count() == 0


def test_best_bins_reach_every_leaf_once():
    x = R.normal(size=(2000, 8))
    tree = ann.grow(x)
    assert sorted(tree.best_bins(x[0])) == list(range(tree.leaves)) and next(iter(tree.best_bins(x[0]))) >= 0
    assert ann.grow(np.ones((500, 3))).leaves == 1


def test_vectors_of_several_lengths_are_searched_apart(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(50)] + [(200, []), (300, [])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 10 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == {0, 10, 20, 100, 110, 120, 130, 140}
    assert sorted(got[10]) == [(1, 9), (2, 11), (3, 8)] and sorted(got[110]) == [(1, 109), (2, 111), (3, 108)]


def test_leaves_grow_with_the_rows_and_many_neighbours_are_found(spark):
    x = R.normal(size=(4000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    trees = []
    grow = ann.grow
    try:
        ann.grow = lambda *a: trees.append(grow(*a)) or trees[-1]
        few = ann.search(df.where("vec_id < 500"), lambda c: c == 0, k=10).collect()
        many = ann.search(df, lambda c: c % 1000 == 0, k=150).collect()
    finally:
        ann.grow = grow
    assert trees[1].leaves > 4 * trees[0].leaves > 4
    assert len(few) == 10 and len(many) == 600 and all(r.recall >= 0.95 for r in many)
