import pytest
from pyspark.sql import functions as F

from foldstore.llm.runtime import scratch
from foldstore.llm.token_rollup import DeltaRollup

SIDE = "struct<source:string,lang:string,tokenizer:string,tokens:bigint,chars:bigint>"


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), f"kind string, old {SIDE}, new {SIDE}")


def totals(r):
    return sorted(map(tuple, r.totals().collect()), key=repr)


def test_signed_changes_and_repeated_commits(spark):
    r = DeltaRollup(spark, scratch(spark, "rollup"))
    a, b, n = ("s", "en", "t1", 10, 50), ("s", "en", "t2", 8, 50), (None, None, "t1", None, None)
    first = changes(spark, ("insert", None, a), ("insert", None, a), ("insert", None, n))
    assert totals(r) == []
    assert r.commit("one", first) and not r.commit("one", first)
    assert totals(r) == sorted([("s", "en", "t1", 2, 20, 100), (None, None, "t1", 1, 0, 0)], key=repr)
    assert r.commit("two", changes(spark, ("revise", a, b), ("delete", n, None)))
    want = sorted([("s", "en", "t1", 1, 10, 50), ("s", "en", "t2", 1, 8, 50)], key=repr)
    assert totals(r) == want
    r.compact()
    assert totals(r) == want and not r.commit("two", first)
    assert r.commit("three", changes(spark, ("delete", a, None))) and r.commit("empty", first.limit(0))
    assert totals(r) == [("s", "en", "t2", 1, 8, 50)]
    r.compact()
    r.compact()
    assert totals(r) == [("s", "en", "t2", 1, 8, 50)] and not r.commit("one", first)


def test_unknown_kinds_fail_and_leave_nothing(spark):
    r = DeltaRollup(spark, scratch(spark, "rollup"))
    with pytest.raises(Exception, match="unknown kind"):
        r.commit("bad", changes(spark, ("upsert", None, ("s", "en", "t", 1, 1))))
    assert totals(r) == [] and r.commit("bad", changes(spark, ("insert", None, ("s", "en", "t", 1, 1))))
    assert r.totals().agg(F.sum("docs")).first()[0] == 1
