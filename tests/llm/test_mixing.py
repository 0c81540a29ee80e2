import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldstore.llm import mixing

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows, i = [], 0
    for source, n in (("big", 300), ("mid", 60), ("small", 20), (None, 10), ("empty", 3)):
        for k in range(n):
            rows.append((i, "" if source == "empty" else " ".join(["w"] * (1 + (i * 7) % 13)), source))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def share(docs):
    t = Counter()
    for r in docs.collect():
        t[r.source] += len((r.text or "").split())
    return {s: n for s, n in t.items() if n}


def weights(t, a):
    p = {s: (n / sum(t.values())) ** a for s, n in t.items()}
    return {s: x / sum(p.values()) for s, x in p.items()}


def test_exponent_meets_the_entropy(spark, docs):
    t = share(docs)
    slim = docs.select("source", mixing.word_tokens().alias("n"))
    m = mixing.mixture(slim, "n", entropy_share=0.9, max_repeats=None)
    w = weights(t, m.exponent)
    assert abs(-sum(x * math.log(x) for x in w.values()) - 0.9 * math.log(len(t))) < 1e-6
    assert {r.mix_source: r.weight for r in m.plan.collect()} == {s: pytest.approx(x, abs=1e-8) for s, x in w.items()}
    assert mixing.mixture(slim, "n", entropy_share=0.0, max_repeats=None).exponent == 1.0
    assert mixing.mixture(slim, "n", entropy_share=1.0, max_repeats=None).exponent == 0.0


def test_exponent_meets_the_repetition_limit(spark, docs):
    t = share(docs)
    slim = docs.select("source", mixing.word_tokens().alias("n"))
    a = mixing.mixture(slim, "n", entropy_share=None, max_repeats=3.0).exponent
    total = sum(t.values())
    assert max(x * total / t[s] for s, x in weights(t, a).items()) == pytest.approx(3.0, abs=1e-5)


def test_schedule_is_blocks_of_permutations(spark, docs):
    t = share(docs)
    rows = mixing.schedule(docs, entropy_share=None, max_repeats=3.0, per_slice=30).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source, r.block), []).append(r)
    plan = {r.mix_source: r for r in mixing.mixture(docs.select("source", mixing.word_tokens().alias("n")), "n", entropy_share=None, max_repeats=3.0).plan.collect()}
    sizes = Counter(r.source for r in docs.collect())
    assert "empty" not in {s for s, _ in by}
    for (s, block), got in by.items():
        assert sorted(r.position for r in got) == list(range(1, len(got) + 1)) and len({r.doc_id for r in got}) == len(got)
        if block < plan[s].blocks:
            assert len(got) == sizes[s]
        else:
            assert sum(r.tokens for r in got) <= plan[s].rest
    for s, p in plan.items():
        assert sum(r.tokens for r in rows if r.source == s) == pytest.approx(p.blocks * t[s] + p.rest, abs=13)
    again = mixing.schedule(docs.repartition(7), entropy_share=None, max_repeats=3.0, per_slice=5).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def test_rows_are_read_as_the_schedule_says(spark, docs):
    want = Counter(r.doc_id for r in mixing.schedule(docs, entropy_share=None, max_repeats=3.0).collect())
    got = Counter(r.doc_id for r in mixing.apply_mixture(docs, entropy_share=None, max_repeats=3.0).collect())
    assert got == want


def test_cover_reads_everything(spark, docs):
    got = Counter(r.doc_id for r in mixing.apply_mixture(docs, entropy_share=None, max_repeats=1.25, cover=True).collect())
    want = {r.doc_id for r in docs.collect() if r.source != "empty"}
    assert set(got) == want and max(got.values()) == 2


def test_odd_tables(spark, corpus):
    assert mixing.schedule(corpus.limit(0)).count() == 0
    assert mixing.apply_mixture(spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, None, "s")], SCHEMA)
    assert sorted(r.doc_id for r in mixing.schedule(one).collect()) == [1, 1, 2]


def test_columns_of_any_name_go_along(spark, corpus):
    odd = corpus.withColumn("blocks", F.lit(3)).withColumn("p_source", F.lit("p")).withColumn("mix_end", F.lit(1)).withColumn("mix_times", F.lit(2)).withColumn("a.b", F.lit(9))
    back = mixing.apply_mixture(odd, entropy_share=None, max_repeats=2.0, cover=True)
    assert back.columns == odd.columns
    ids = {r.doc_id for r in odd.where("regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+') > 0").select("doc_id").collect()}
    assert ids <= {r.doc_id for r in back.select("doc_id").collect()}
    assert back.where("blocks <> 3 or p_source <> 'p' or mix_end <> 1 or mix_times <> 2 or `a.b` <> 9 or mix_n <> 1").count() == 0


def test_rows_without_an_id_and_long_texts(spark):
    rows = [(None, "w " * (k % 40 + 1), "a") for k in range(400)] + [(1, "w " * 300_000, "b"), (1, "w " * 300_000, "b"), (2, None, "b")]
    got = mixing.schedule(spark.createDataFrame(rows, SCHEMA), entropy_share=None, max_repeats=None, per_slice=20)
    # Equal weights: source a, short of tokens, is read again and again, b in part.
    places = Counter((r.source, r.block, r.position) for r in got.collect())
    assert max(places.values()) == 1
    assert sum(n for (source, block, _), n in places.items() if source == "a" and block == 0) == 400
