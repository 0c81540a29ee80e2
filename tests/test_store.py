"""The store end to end: writers, readers, drops, images, streaming.

Names of users and expected values of the first tests follow FIXTURES.md, A4 and A5.
"""

import pytest
from pyspark.sql import functions as F

from foldstore.config import ConfigBuilder, StoreConfig, merge_options
from foldstore.document import Document
from foldstore.functions.fields import FieldType
from foldstore.sources.event_log import RAW
from foldstore.store import Store

S, I, B = FieldType.STRING, FieldType.INT32, FieldType.BYTES
USER = {"userid": S, "firstname": S, "city": S}
SCHEMA = RAW


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, StoreConfig("acct", "users", "userid", path=f"file://{tmp_path}", partitions=3))


def put(store, *rows, fields=None):
    fields = fields or USER
    schema = ", ".join(f"{n} {'string' if k == S else 'int' if k == I else 'binary'}" for n, k in fields.items())
    return store.upsert(store.spark.createDataFrame([tuple(r.get(n) for n in fields) for r in rows], schema), fields)


def keys(store, *ids):
    return store.spark.createDataFrame([(i,) for i in ids], "userid string")


def test_single_document(store):
    put(store, {"userid": "0", "firstname": "Alice"})
    assert (store.get_string("0", "userid"), store.get_string(b"0", "firstname")) == ("0", "Alice")
    assert store.get("1000", "userid") is None and store.get("0", "foo_field") is None
    with pytest.raises(TypeError):
        store.multiget([5], [], ["userid"])


def test_multiget_is_dense_and_bytes_keys_come_first(store):
    put(store, {"userid": "8", "firstname": "Alice"}, {"userid": "9", "firstname": "Bob", "city": "NYC"}, {"userid": "10", "firstname": "Allison", "city": "NYC"})
    assert store.multiget([], [], ["firstname"]) == [] and store.multiget([b"8"], [], []) == []
    got = store.multiget([b"10"], ["8", "9", "foo"], ["firstname", "bar", "city"])
    assert got == [b"Allison", None, b"NYC", b"Alice", None, None, b"Bob", None, b"NYC", None, None, None]


def test_partial_upserts_merge_and_overwrite(store):
    put(store, {"userid": "a", "firstname": "Alice", "city": "Rome"})
    put(store, {"userid": "a", "city": "San Francisco"})
    assert store.multiget([], ["a"], ["firstname", "city"]) == [b"Alice", b"San Francisco"]


def test_delete_fields_then_document_then_resurrect(store):
    put(store, {"userid": "1", "firstname": "Alice", "city": "NYC"})
    store.delete_fields(keys(store, "1", "unknown"), USER, ["firstname", "nothing"])
    assert store.multiget([], ["1"], ["userid", "firstname", "city"]) == [b"1", None, b"NYC"]
    store.delete_documents(keys(store, "1"), USER)
    assert store.multiget([], ["1"], ["userid", "city"]) == [None, None]
    put(store, {"userid": "1", "firstname": "Ann"})
    assert store.multiget([], ["1"], ["userid", "firstname", "city"]) == [b"1", b"Ann", None]


def test_drops_spare_the_key_and_reach_all_partitions(store):
    put(store, *({"userid": str(i), "firstname": f"n{i}", "city": "NYC"} for i in range(20)))
    store.drop_fields(["firstname", "foo", "userid"], ["ci", "ciii"])
    state = store.state()
    assert state.count() == 20 and {r.field for r in state.collect()} == {"userid"}
    assert {r.field for r in store.fields().select("field").distinct().collect()} == {"userid"}
    assert store.drop_fields() is None
    store.drop_all()
    assert store.state().count() == 0


def test_writes_need_their_keys(store):
    with pytest.raises(Exception, match="lacks its primary"):
        put(store, {"firstname": "nobody"})


def test_bad_events_are_set_aside(store):
    put(store, {"userid": "1", "firstname": "Alice"})
    cell = "named_struct('type', {}, 'value', cast('{}' as binary))"
    raw = store.spark.sql(
        f"""SELECT 0 AS log_partition, 'upsert' AS op, map('firstname', {cell.format(5, 'x')}) AS doc, array() AS fields, array() AS prefixes, false AS drop_all
        UNION ALL SELECT 0, 'upsert', map('userid', {cell.format(5, '2')}, 'age', {cell.format(1, 'abc')}), array(), array(), false
        UNION ALL SELECT 0, 'upsert', map('userid', {cell.format(5, '3')}, 'x', {cell.format(0, 'y')}), array(), array(), false
        UNION ALL SELECT 0, 'noop', null, array(), array(), false"""
    )
    store.log.append_raw(raw.select("log_partition", "op", "doc", F.col("fields").cast("array<string>"), F.col("prefixes").cast("array<string>"), "drop_all"))
    assert sorted(r.problem for r in store.dead_letters().collect()) == ["no primary key", "payload of another width than its type"]
    assert store.multiget([], ["1", "2", "3"], ["userid"]) == [b"1", None, b"3"]


def test_typed_view(store):
    fields = {"userid": S, "age": I, "photo": B}
    put(store, {"userid": "1", "age": -22, "photo": b"\x00\xff"}, {"userid": "2"}, fields=fields)
    rows = {r.userid: (r.age, r.photo and bytes(r.photo)) for r in store.wide(fields).collect()}
    assert rows == {"1": (-22, b"\x00\xff"), "2": (None, None)}
    assert store.wide({"age": S}).where("age is not null").count() == 0


def test_compaction_changes_no_value(store):
    put(store, *({"userid": str(i), "firstname": "x", "city": "y"} for i in range(30)))
    put(store, {"userid": "3", "city": "z"})
    store.delete_documents(keys(store, *map(str, range(10, 20))), USER)
    before = sorted(map(tuple, store.state().select("pk", "field", "value").collect()))
    image, stats = store.compact(epoch=5)
    assert (image.cells, stats["cells_before"], stats["cells_after"], stats["documents_after"]) == (60, 92, 60, 20)
    put(store, {"userid": "99", "firstname": "late"})
    after = sorted(r for r in map(tuple, store.state().select("pk", "field", "value").collect()) if bytes(r[0]) != b"99")
    assert after == before and store.get_string("99", "firstname") == "late"
    assert store.compact(epoch=5)[0] is None
    assert store.images.needs_refresh(None, 10) and not store.images.needs_refresh(5, 10)


def test_stream_equals_batch(store, tmp_path):
    for k in range(4):
        put(store, *({"userid": str(i), "firstname": f"v{k}", "city": "c" if k % 2 else None} for i in range(k, k + 6)))
        if k == 2:
            store.drop_fields(["city"])
    m = store.maintainer(dead_letters=f"file://{tmp_path}/dead")
    m.catch_up(f"file://{tmp_path}/cp", max_files=1)
    rows = lambda df: sorted(map(tuple, df.select("pk", "field", "value").collect()))
    streamed = rows(store.live.cells(store.live.latest()))
    assert streamed == rows(store.state())
    put(store, {"userid": "new", "firstname": "n"})
    assert store.get_string("new", "firstname") == "n"
    m.catch_up(f"file://{tmp_path}/cp")
    assert len(rows(store.live.cells(store.live.latest()))) == len(streamed) + 2


def test_sql_views(store):
    put(store, {"userid": "1", "firstname": "Alice"})
    store.create_views(USER, prefix="t_")
    assert store.spark.sql("SELECT firstname FROM t_wide WHERE userid = '1'").first()[0] == "Alice"


def test_create_open_delete(store):
    with pytest.raises(ValueError):
        Store.create(store.spark, store.config)
    again = Store.open(store.spark, store.config.path, "acct", "users", {"log_level": "debug"})
    assert again.config.primary_key == "userid" and again.config.options["log_level"] == "debug" and again.healthy()
    store.delete()
    with pytest.raises(ValueError):
        Store.open(store.spark, store.config.path, "acct", "users")


def test_config():
    c = ConfigBuilder("a", "s", "id").partitioned_by("p", 4).at("/x").option("n", 1).build()
    assert StoreConfig.from_json(c.to_json()) == c and c.partitioning_key == "p"
    assert merge_options({"a": 1, "b": "x"}, {"a": 2}) == {"a": 2, "b": "x"}
    with pytest.raises(TypeError):
        merge_options({"a": 1}, {"a": "1"})
    for bad in ({"account": " "}, {"partitions": 0}, {"options": {"log_level": "loud"}}):
        with pytest.raises(ValueError):
            StoreConfig(**({"account": "a", "store": "s", "primary_key": "id"} | bad))


def test_documents_of_the_builder_and_typed_getters(store):
    store.put(
        Document().put_string("userid", "1").put_int("age", -5).put_long("big", 2**40).put_float("f", 1.5).put_double("d", -0.1).put_bool("yes", True).put_bytes("raw", b"\0\xff"),
        Document().put_string("userid", "2").put_int("age", 7).put_int("age", 8),
    )
    assert [store.get_int("1", "age"), store.get_long("1", "big"), store.get_float("1", "f"), store.get_double("1", "d"), store.get_bool("1", "yes"), store.get("1", "raw")] == [-5, 2**40, 1.5, -0.1, True, b"\0\xff"]
    assert store.get_int("2", "age") == 8 and store.get_int("1", "big") is None and store.get_long("3", "big") is None
    for bad in (lambda: Document().put_int("a", "1"), lambda: Document().put_int("a", True), lambda: Document().put_string("a", b"x"), lambda: Document().put_bool("a", 1)):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        Document().put_string(" ", "x")


def test_compaction_sizes_follow_the_store(store):
    put(store, *({"userid": str(i), "firstname": "x"} for i in range(50)))
    assert store.compact(epoch=1)[1]["cells_after"] == 100
    store.drop_all()
    assert [store.compact(epoch=2)[1][k] for k in ("cells_before", "documents_before", "bytes_before", "cells_after")] == [0, 0, 0, 0]


def test_fields_are_numbered_anew(store):
    put(store, {"userid": "1", "firstname": "a", "city": "b"})
    ids = lambda: {r.field: r.field_id for r in store.fields().collect()}
    assert ids() == {"userid": 0, "city": 1, "firstname": 2}
    store.drop_fields(["city"])
    store.upsert(store.spark.createDataFrame([("1", "n")], "userid string, nick string"), {"userid": S, "nick": S})
    assert ids() == {"userid": 0, "firstname": 2, "nick": 3}
    store.compact(epoch=1)
    assert ids() == {"userid": 0, "firstname": 1, "nick": 2}
    store.upsert(store.spark.createDataFrame([("1", "c")], "userid string, city string"), {"userid": S, "city": S})
    assert ids() == {"userid": 0, "firstname": 1, "nick": 2, "city": 3}
    store.drop_all()
    assert ids() == {"userid": 0}


def live(store):
    return sorted((bytes(r.pk), r.field, bytes(r.value)) for r in store.live.cells(store.live.latest()).collect())


def full(store):
    from foldstore.operators.validation import split
    from foldstore.plans.fold import fold

    return sorted((bytes(r.pk), r.field, bytes(r.value)) for r in fold(split(store.log.read(), "userid")[0], "userid").collect())


def test_events_are_neither_lost_nor_brought_back(store, tmp_path):
    put(store, *({"userid": str(i), "firstname": "x"} for i in range(4)))
    store.delete_documents(keys(store, "1"), USER)
    store.drop_fields(["city"])
    m = store.maintainer()
    m.catch_up(f"file://{tmp_path}/a")
    assert live(store) == full(store)
    first = store.live.latest().epoch
    put(store, *({"userid": str(i), "firstname": "y", "city": "c"} for i in range(3, 6)))
    m.catch_up(f"file://{tmp_path}/b", max_files=1)  # the checkpoint is lost: everything comes again
    assert live(store) == full(store) and store.live.latest().epoch > first
    last = store.live.latest().epoch
    m.catch_up(f"file://{tmp_path}/c")  # nothing new
    assert store.live.latest().epoch == last
    # Files of later commits come before those of earlier ones.
    put(store, {"userid": "7", "firstname": "late"}, {"userid": "8", "firstname": "late"})
    put(store, {"userid": "7", "firstname": "later"})
    a, b = (store.spark.read.schema(SCHEMA).parquet(f"{store.log.path}/commits/{c}").withColumn("log_file", F.col("_metadata.file_path")) for c in store.log.commits()[-2:])
    m._merge(b, 0)
    assert store.get_string("8", "firstname") == "late"  # readers take from the log what the image can't claim
    m._merge(a, 0)
    assert live(store) == full(store) and store.live.latest().through == int(store.log.commits()[-1])


def test_a_rival_for_an_epoch(store, tmp_path, monkeypatch):
    put(store, {"userid": "1", "firstname": "a"})
    m, publish, calls = store.maintainer(), store.live.publish, []

    def slow(*args, **kw):
        if not calls:
            calls.append(1)
            put(store, {"userid": "2", "firstname": "b"})
            store.maintainer().catch_up(f"file://{tmp_path}/rival")
        return publish(*args, **kw)

    monkeypatch.setattr(m.images, "publish", slow)
    m.catch_up(f"file://{tmp_path}/mine")
    assert calls and live(store) == full(store)


def test_following_stops_and_goes_on(store, tmp_path):
    put(store, {"userid": "1", "firstname": "a"})
    m = store.maintainer()
    running = m.follow(f"file://{tmp_path}/cp", every="100 milliseconds")
    put(store, {"userid": "2", "firstname": "b"})
    running.processAllAvailable()
    running.stop()
    assert live(store) == full(store)
    put(store, {"userid": "3", "firstname": "c"})
    m.catch_up(f"file://{tmp_path}/cp")
    assert live(store) == full(store)


def test_reads_skip_what_an_image_has(store):
    for k in range(4):
        put(store, {"userid": str(k), "firstname": "x"})
    image, _ = store.compact(epoch=1)
    put(store, {"userid": "9", "firstname": "x"})
    tail = store.log.read(image.offsets)
    assert tail.count() == 1 and len({f.split("/")[-2] for f in tail.inputFiles()}) == 1
    assert store.log.read(3).count() == 5 and store.log.read().count() == 5
