"""Queries that go through a store: its writers, log, images, maintainer and readers, each with its SQL form.

Documents are the rows of ``customer`` (key: c_custkey as text), written to a new store in the shared folder, or the
``events`` table as a binary log.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstore.config import StoreConfig
from foldstore.document import Document
from foldstore.functions import codec
from foldstore.functions.fields import FieldType
from foldstore.operators import lookup, maintenance
from foldstore.operators.validation import check, split
from foldstore.plans.fold import fold
from foldstore.plans.workload import _binary_log, fold_sql, query, read
from foldstore.sources import files, wire
from foldstore.store import Store

FIELDS = {"id": FieldType.STRING, "name": FieldType.STRING, "segment": FieldType.STRING, "nation": FieldType.INT32, "balance": FieldType.FLOAT64, "rich": FieldType.BOOLEAN, "big": FieldType.INT64}
PARTS = 3


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("int").alias("nation"),
        F.col("c_acctbal").cast("double").alias("balance"), (F.col("c_acctbal") > 5000).alias("rich"), (F.col("c_custkey").cast("bigint") * 3_000_000_000).alias("big"), F.col("c_custkey").alias("n"),
    )


def new_store(spark: SparkSession, name: str, rows: DataFrame | None = None) -> Store:
    store = Store.create(spark, StoreConfig("acct", name, "id", path=files.scratch(spark, "store"), partitions=PARTS))
    if rows is not None:
        store.upsert(rows, FIELDS)
    return store


def wide(store: Store) -> DataFrame:
    return store.wide(FIELDS).drop("log_partition", "pk")


def wide_sql(where: str = "true", **changed: str) -> str:
    columns = {"id": "CAST(c_custkey AS VARCHAR)", "name": "c_name", "segment": "c_mktsegment", "nation": "CAST(c_nationkey AS INTEGER)", "balance": "CAST(c_acctbal AS DOUBLE)", "rich": "c_acctbal > 5000", "big": "CAST(c_custkey AS BIGINT) * 3000000000"} | changed
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM customer WHERE {where}"


@query(wide_sql(segment="CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END"))
def kv_store_upsert(spark, sf_dir):
    """Two upserts through the store's writer; the later one has one field of a third of the documents."""
    rows = customers(spark, sf_dir)
    store = new_store(spark, "upsert", rows)
    store.upsert(rows.where("n % 3 = 0").select("id", F.lower("segment").alias("segment")), {"id": FieldType.STRING, "segment": FieldType.STRING})
    return wide(store)


@query(wide_sql(segment="CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END", nation="CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS INTEGER) END"))
def kv_store_delete_fields(spark, sf_dir):
    rows = customers(spark, sf_dir)
    store = new_store(spark, "fields", rows)
    store.delete_fields(rows.where("n % 5 = 0"), FIELDS, ["segment", "nation", "nothing"])
    return wide(store)


@query(wide_sql("c_custkey % 4 <> 0 OR c_custkey % 8 = 0", **{n: f"CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {e} END" for n, e in (("segment", "c_mktsegment"), ("nation", "CAST(c_nationkey AS INTEGER)"), ("balance", "CAST(c_acctbal AS DOUBLE)"), ("rich", "c_acctbal > 5000"), ("big", "CAST(c_custkey AS BIGINT) * 3000000000"))}))
def kv_store_delete_documents(spark, sf_dir):
    """Documents that are deleted, half of which come back with a name alone."""
    rows = customers(spark, sf_dir)
    store = new_store(spark, "documents", rows)
    store.delete_documents(rows.where("n % 4 = 0"), FIELDS)
    store.upsert(rows.where("n % 8 = 0"), {"id": FieldType.STRING, "name": FieldType.STRING})
    return wide(store)


@query(wide_sql(name="CASE WHEN c_custkey % 6 = 0 THEN c_name END", nation="NULL::INTEGER", big="NULL::BIGINT", balance="NULL::DOUBLE"))
def kv_store_drops(spark, sf_dir):
    """Drops by name and by prefix, which reach every log partition and spare the key; one field is written again."""
    rows = customers(spark, sf_dir)
    store = new_store(spark, "drops", rows)
    store.drop_fields(["name", "id", "foo"], ["nat", "b", "NAME"])
    store.upsert(rows.where("n % 6 = 0"), {"id": FieldType.STRING, "name": FieldType.STRING})
    return wide(store)


@query(wide_sql("c_custkey % 7 = 0"))
def kv_store_drop_all(spark, sf_dir):
    rows = customers(spark, sf_dir)
    store = new_store(spark, "all", rows)
    store.drop_all()
    store.upsert(rows.where("n % 7 = 0"), FIELDS)
    return wide(store)


@query(wide_sql("c_custkey <= 1") + " UNION ALL SELECT 'absent', NULL, NULL, NULL, NULL, NULL, NULL")
def kv_store_typed_getters(spark, sf_dir):
    """Documents made by the builder and read value by value with the typed getters of a store that was opened again."""
    store = new_store(spark, "typed")
    rows = customers(spark, sf_dir).where("n <= 1").collect()
    store.put(*[Document().put_string("id", r.id).put_string("name", r.name).put_bytes("segment", r.segment.encode()).put_int("nation", r.nation).put_double("balance", r.balance).put_bool("rich", r.rich).put_long("big", r.big) for r in rows])
    again = Store.open(spark, store.config.path, "acct", "typed")
    out = []
    for key in [*[r.id for r in rows], "absent"]:
        segment = again.get(key.encode(), "segment")
        out.append((key, again.get_string(key, "name"), segment and segment.decode(), again.get_int(key, "nation"), again.get_double(key, "balance"), again.get_bool(key, "rich"), again.get_long(key, "big")))
    return spark.createDataFrame(out, "id string, name string, segment string, nation int, balance double, rich boolean, big bigint")


@query(
    "WITH c AS (SELECT count(*) AS docs, sum(length(CAST(c_custkey AS VARCHAR)) + length(c_name) + length(c_mktsegment) + 4 + 8 + 1 + 8) AS bytes FROM customer) "
    "SELECT step, CAST(cells_before AS BIGINT) AS cells_before, CAST(documents_before AS BIGINT) AS documents_before, CAST(bytes_before AS BIGINT) AS bytes_before, CAST(cells_after AS BIGINT) AS cells_after, CAST(documents_after AS BIGINT) AS documents_after FROM ("
    "SELECT 1 AS step, 7 * docs AS cells_before, docs AS documents_before, bytes AS bytes_before, 7 * docs AS cells_after, docs AS documents_after FROM c UNION ALL "
    "SELECT 2, 14 * docs, docs, 2 * bytes, 7 * docs, docs FROM c UNION ALL SELECT 3, 0, 0, 0, 0, 0 UNION ALL SELECT 4, 0, 0, 0, 0, 0)"
)
def kv_compaction_twice(spark, sf_dir):
    """Sizes before and after four compactions: of all documents; of them written once more; after a drop of everything; of nothing."""
    rows = customers(spark, sf_dir)
    store = new_store(spark, "compact", rows)
    out = []
    for step in range(1, 5):
        if step == 2:
            store.upsert(rows, FIELDS)
        if step == 3:
            store.drop_all()
        s = store.compact(epoch=step)[1]
        out.append((step, s["cells_before"], s["documents_before"], s["bytes_before"], s["cells_after"], s["documents_after"]))
    return spark.createDataFrame(out, "step int, cells_before bigint, documents_before bigint, bytes_before bigint, cells_after bigint, documents_after bigint")


@query(
    "WITH f(step, field, field_id) AS (VALUES (1, 'id', 0), (1, 'balance', 1), (1, 'big', 2), (1, 'name', 3), (1, 'nation', 4), (1, 'rich', 5), (1, 'segment', 6), "
    "(2, 'id', 0), (2, 'big', 2), (2, 'name', 3), (2, 'rich', 5), (2, 'segment', 6), (2, 'later', 7), (3, 'id', 0), (3, 'big', 1), (3, 'name', 2), (3, 'rich', 3), (3, 'segment', 4), (3, 'later', 5)), "
    "p AS (SELECT unnest(range(3)) AS part) SELECT CAST(step AS INTEGER) AS step, CAST(part AS INTEGER) AS log_partition, field, CAST(field_id AS INTEGER) AS field_id FROM f, p WHERE (SELECT count(*) FROM customer) > 0"
)
def kv_schema_compacted(spark, sf_dir):
    """Ids of fields as written; after two drops and a new field; and after a compaction, which numbers them anew."""
    rows = customers(spark, sf_dir)
    store = new_store(spark, "schema", rows)
    out = [store.fields().withColumn("step", F.lit(1))]
    store.drop_fields(["balance"], ["nat"])
    store.upsert(rows.select("id", F.col("name").alias("later")), {"id": FieldType.STRING, "later": FieldType.STRING})
    out.append(store.fields().withColumn("step", F.lit(2)))
    store.compact(epoch=1)
    out.append(store.fields().withColumn("step", F.lit(3)))
    return out[0].unionByName(out[1]).unionByName(out[2]).select("step", "log_partition", "field", "field_id")


@query(wide_sql("c_custkey % 2 = 1 OR c_custkey % 10 = 0"))
def kv_store_image_and_tail(spark, sf_dir):
    """The image of a compaction, read back, and the events above its offsets; older commits aren't opened."""
    rows = customers(spark, sf_dir)
    store = new_store(spark, "tail", rows.where("n % 2 = 1"))
    image, _ = store.compact(epoch=1)
    store.upsert(rows.where("n % 10 = 0"), FIELDS)
    tail = store.log.read(image.offsets)
    pk = store.config.primary_key
    state = fold(split(tail, pk)[0], pk, store.images.cells(image), store.images.deleted(image))
    return lookup.wide_view(state, FIELDS).drop("log_partition", "pk")


@query("SELECT CAST(count(*) AS BIGINT) AS events FROM customer WHERE c_custkey % 10 = 0")
def kv_position_restore(spark, sf_dir):
    """Events that a reader still has to read from the offsets that an image stores."""
    rows = customers(spark, sf_dir)
    store = new_store(spark, "position", rows)
    image, _ = store.compact(epoch=1)
    store.upsert(rows.where("n % 10 = 0"), FIELDS)
    return store.log.read(store.images.latest().offsets).agg(F.count(F.lit(1)).alias("events"))


@query(wide_sql("c_custkey % 3 <> 0", name="lower(c_name)"))
def kv_lost_checkpoint(spark, sf_dir):
    """A maintainer whose checkpoint is lost reads the log again from its start, and so does one that starts beside it: the live image keeps every event, and what was deleted stays so."""
    rows = customers(spark, sf_dir)
    store = new_store(spark, "lost", rows.where("n % 2 = 0"))
    store.delete_documents(rows.where("n % 6 = 0"), FIELDS)
    store.maintainer().catch_up(f"{store.root}/checkpoint-1")
    store.upsert(rows.where("n % 2 = 1 and n % 3 <> 0"), FIELDS)
    store.upsert(rows.where("n % 3 <> 0").select("id", F.lower("name").alias("name")), {"id": FieldType.STRING, "name": FieldType.STRING})
    store.maintainer().catch_up(f"{store.root}/checkpoint-2", max_files=1)
    store.maintainer().catch_up(f"{store.root}/checkpoint-3")
    return lookup.wide_view(store.live.cells(store.live.latest()), FIELDS).drop("log_partition", "pk")


@query(wide_sql("c_custkey % 3 <> 0"))
def kv_redelivery_below_snapshot(spark, sf_dir):
    """Events that lie below an image come again, without the deletes after them: the image's horizons hold them off."""
    rows = customers(spark, sf_dir)
    store = new_store(spark, "again", rows)
    store.delete_documents(rows.where("n % 3 = 0"), FIELDS)
    image, _ = store.compact(epoch=1)
    first = split(store.log.read().where(F.col("log_offset") <= store.log.end_of(0)[0]), "id")[0]
    state = fold(first, "id", store.images.cells(image), store.images.deleted(image))
    return lookup.wide_view(state, FIELDS).drop("log_partition", "pk")


@query(wide_sql("c_custkey % 2 = 0 OR c_custkey % 9 = 0"))
def kv_follow(spark, sf_dir):
    """A maintainer that catches up, follows the log while it grows, is stopped, and goes on where it was."""
    rows = customers(spark, sf_dir)
    store = new_store(spark, "follow", rows.where("n % 4 = 0"))
    m = store.maintainer()
    running = m.follow(f"{store.root}/checkpoint", every="200 milliseconds")
    try:
        store.upsert(rows.where("n % 4 = 2"), FIELDS)
        running.processAllAvailable()
    finally:
        running.stop()
    store.upsert(rows.where("n % 9 = 0 and n % 2 = 1"), FIELDS)
    m.catch_up(f"{store.root}/checkpoint")
    return lookup.wide_view(store.live.cells(store.live.latest()), FIELDS).drop("log_partition", "pk")


@query(fold_sql(with_key=True, select="SELECT CAST(pk AS VARCHAR) AS pk, field, off FROM state"))
def kv_wire_events(spark, sf_dir):
    """The events in their wire form and back, folded."""
    raw = _binary_log(spark, sf_dir)
    good = split(wire.decoded(wire.encoded(raw, "user_id")), "user_id")[0]
    return fold(good, "user_id").select(F.decode("pk", "UTF-8").alias("pk"), "field", "off")


@query("SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (WHERE event_id % 10 = 0) AS BIGINT) AS damaged FROM events")
def kv_wire_damage(spark, sf_dir):
    """Records cut short are set aside by their reason; the others are read."""
    records = wire.encoded(_binary_log(spark, sf_dir), "user_id")
    cut = F.when(F.col("log_offset") % 10 == 0, F.expr("substring(value, 1, 3)")).otherwise(F.col("value"))
    return check(wire.decoded(records.withColumn("value", cut)), "user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("problem") == "unknown operation").alias("damaged"))


@query(fold_sql(parts=3, where="user_id % 3 = 1", select="SELECT pk, field, off FROM state"))
def kv_one_partition(spark, sf_dir):
    """A reader that is assigned one log partition."""
    from foldstore.plans.workload import event_log

    return fold(event_log(spark, sf_dir, parts=3).where("log_partition = 1"), "user_id").select("pk", "field", "off")


@query("SELECT CAST(sum(7) AS BIGINT) AS cells, count(*) AS documents, CAST(sum(length(CAST(c_custkey AS VARCHAR)) + length(c_name) + length(c_mktsegment) + 21) AS BIGINT) AS bytes FROM customer")
def kv_aggregate_stats(spark, sf_dir):
    """Sizes of each log partition, summed up."""
    store = new_store(spark, "stats", customers(spark, sf_dir))
    return maintenance.aggregate_stats(maintenance.sizes_by_partition(store.state()).drop("log_partition"))


@query("SELECT c_custkey, to_base64(encode(substr(repeat(c_name, 32), 1, 32))) AS pass_key, to_base64(unhex(md5(substr(repeat(c_name, 32), 1, 32)))) AS digest FROM customer")
def kv_key_digest(spark, sf_dir):
    key, digest = codec.key_digest_columns(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", key.alias("pass_key"), digest.alias("digest"))


@query("SELECT c_custkey, c_name AS first_key, c_mktsegment AS second_key, CAST(2 AS INTEGER) AS n FROM customer")
def kv_request_unpack(spark, sf_dir):
    """Packed requests, whose empty values are left out."""
    e = lambda c: F.encode(F.col(c), "UTF-8")
    packed = read(spark, sf_dir, "customer").select("c_custkey", codec.pack_column(F.array(F.lit(b""), e("c_name"), F.lit(None).cast("binary"), F.lit(b""), e("c_mktsegment"))).alias("packed"))
    v = packed.select("c_custkey", codec.unpack_request_column("packed").alias("v"))
    return v.select("c_custkey", *[F.decode(F.col("v")[k], "UTF-8").alias(n) for k, n in enumerate(("first_key", "second_key"))], F.size("v").alias("n"))


@query("SELECT c_custkey, CAST(c_custkey AS BIGINT) * 3000000000 AS n, CAST(len(CAST(bin(CAST(c_custkey AS BIGINT) * 3000000000) AS VARCHAR)) + 6 AS INTEGER) // 7 AS width FROM customer")
def kv_varint(spark, sf_dir):
    """Numbers as varints and back, with their widths."""
    @F.pandas_udf("struct<n: bigint, width: int>")
    def there_and_back(x: pd.Series) -> pd.DataFrame:
        coded = x.map(codec.varint)
        return pd.DataFrame({"n": coded.map(lambda b: codec.read_varint(b)[0]), "width": coded.map(len)})

    return customers(spark, sf_dir).select(F.col("n").alias("c_custkey"), there_and_back("big").alias("r")).select("c_custkey", "r.n", "r.width")
