import random
import re

import pytest

from foldstore.llm import jaccard_join as J

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(doc_id, size, least doc_id reachable)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(map(tuple, J.join(df).collect()), key=repr)


def test_corpus_against_all_pairs(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.where("doc_id is not null").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_copies_and_shared_passages(spark, seed, monkeypatch):
    """Chains of edits around the limit, a passage that most documents share, regions in parts."""
    monkeypatch.setattr(J, "PART", 8)
    monkeypatch.setattr(J, "FREQUENT", 4)
    monkeypatch.setattr(J, "LEADERS", 1)
    monkeypatch.setattr(J, "LARGE", 3)
    monkeypatch.setattr(J, "PIVOTS", 2)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(40))
    rows, base = [], [word() for _ in range(60)]
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(60)] = word()
        rows.append((i, " ".join(w)))
        if i % 9 == 0:
            base = [word() if r.random() < 0.04 else x for x in base]
    for i in range(100, 180):
        rows.append((i, " ".join([*(word() for _ in range(r.randrange(40))), passage, *(word() for _ in range(r.randrange(30)))])))
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A  B\tc"), (6, "a b c d"), (7, "x " * 100), (8, "X " * 7), (9, "é b c d e"), (10, "É b c d e"), (4, "a b c")]
    assert run(spark, rows) == brute(rows)
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_chains(spark):
    n = 300
    links = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5, 5)]
    random.Random(1).shuffle(links)
    got = dict(map(tuple, J.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_windows_hold_a_shared_pivot():
    """The bound on shared pivots, against random pairs of sets."""
    r = random.Random(3)
    for _ in range(300):
        x = set(r.sample(range(10_000), r.randint(1, 60)))
        y = set(x)
        for _ in range(r.randrange(6)):
            (y.discard(r.choice(sorted(y))) if r.random() < 0.5 and len(y) > 1 else y.add(r.randrange(10_000)))
        c = len(x & y)
        if 100 * c < 75 * len(x | y):
            continue
        o = -(-75 * (len(x) + len(y)) // 175)
        reach = min(J.window(len(s)) - len(s) + o for s in (x, y))
        shared = len(set(sorted(x)[: J.window(len(x))]) & set(sorted(y)[: J.window(len(y))]))
        assert shared >= max(1, reach)


def test_near_copies_under_null_ids(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for k in range(12):
        w = [word() for _ in range(100)]
        first, last = [word(), *w[1:]], [*w[:-1], word()]
        # The middle one, which has no id, links the outer two only through itself now and then.
        rows += [(10 * k + 7, " ".join([*first[:94], *[word() for _ in range(6)]])), (None, " ".join(w)), (10 * k + 9, " ".join([*[word() for _ in range(7)], *last[7:]]))]
    rows += [(None, " ".join(map(str, range(50))))] * 3 + [(None, word())]
    assert run(spark, rows) == brute(rows)


def test_sketches_never_differ_more_than_the_sets():
    import numpy as np

    r = np.random.default_rng(5)
    for n in (1, 30, 400, 3000):
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for k in (0, 1, n // 10, n // 2):
            y = np.unique(np.concatenate([x[k:], r.integers(0, 2**63, k // 2).astype(np.uint64)]))
            places = np.bitwise_count((J.sketch(x) ^ J.sketch(y)).view(np.uint64)).sum()
            assert places <= len(np.setxor1d(x, y)) and (k or places == 0)


def test_sets_that_share_half_of_their_names(spark):
    """Every set of an odd size has one and the same lower half of its digest."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(80)]
    rows = [(k, " ".join([*base[: 80 - k], *(word() for _ in range(k))])) for k in range(12)] + [(k, " ".join(base[:k])) for k in range(40, 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = J.content_hash
    for digest in (whole, lambda s: (whole(s)[0], 7 if len(s) % 2 else whole(s)[1])):
        assert sorted(map(tuple, J.join(df, digest).collect()), key=repr) == brute(rows)


def test_replicas_survive_their_blocks():
    import numpy as np

    r = np.random.default_rng(6)
    rows = np.zeros(500, J.REPLICA)
    rows["pivot"] = np.sort(r.integers(0, 2**56, 500))
    nodes = r.integers(-(2**62), 2**62, 20)
    which = r.integers(0, 20, 500)
    rows["node"], rows["n"], rows["pos"], rows["part"] = nodes[which], which + 5, r.integers(1, 9999, 500), r.integers(-1, 70_000, 500)
    assert (J.from_block(J.to_block(rows)) == rows).all()


def test_pairs_of_large_regions_are_rows_once(spark, monkeypatch):
    """Documents that share most of their shingles, but too few to link, meet once and not at each pivot that they share."""
    kept, cut = [], J.cut
    monkeypatch.setattr(J, "cut", lambda df, what, path=None: (out := cut(df, what, path), kept.append(out.count()) if what == "join-many" else None)[0])
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(400)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(14):
            w[r.randrange(400)] = word()
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows)
    assert 60 < kept[-1] < 60 * 60
