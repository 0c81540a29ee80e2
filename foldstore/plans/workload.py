"""The store's queries over the driver's tables, each with its SQL form.

``events`` is read as a mutation log: view, click and purchase upsert {event_type: value, k: props.k}, error deletes the
field k, signup deletes the document; drops are literal rows at given shares of the log. Values are doubles, so that both
engines print them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstore.functions import codec
from foldstore.functions.fields import FieldType, cell, decode, decode_cell, encode
from foldstore.operators import lookup, maintenance, validation
from foldstore.plans.fold import KEY, fold, registry, writes

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}
DOUBLE = int(FieldType.FLOAT64)
CELL = "struct<type:int,value:double>"
UPSERTS = ("view", "click", "purchase")


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def register(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------------------------------------ events as a log


def event_log(spark: SparkSession, sf_dir: str, *, parts: int = 1, with_key: bool = False) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    c = lambda x: F.struct(F.lit(DOUBLE).alias("type"), x.cast("double").alias("value"))
    entries = [F.col("event_type"), c(F.col("value")), F.lit("k"), c(F.get_json_object("props", "$.k"))]
    if with_key:
        entries += [F.lit("user_id"), c(F.col("user_id"))]
    upsert = F.col("event_type").isin(*UPSERTS)
    none = F.array().cast("array<string>")
    return e.select(
        F.pmod(F.col("user_id"), F.lit(parts)).cast("int").alias("log_partition"), F.col("event_id").alias("log_offset"),
        F.when(upsert, "upsert").when(F.col("event_type") == "error", "delete_fields").when(F.col("event_type") == "signup", "delete_doc").otherwise("noop").alias("op"),
        F.col("user_id").alias("pk"), F.when(upsert, F.create_map(*entries)).cast(f"map<string,{CELL}>").alias("doc"),
        F.when(F.col("event_type") == "error", F.array(F.lit("k"))).otherwise(none).alias("fields"), none.alias("prefixes"), F.lit(False).alias("drop_all"),
    )


def drop_events(log: DataFrame, *drops: tuple, parts: int = 1) -> DataFrame:
    """Drop events (percent of the log, names, prefixes, drop_all), one for each log partition; each comes right after the event at that place."""
    top = log.agg(F.max("log_offset").alias("top"))
    words = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    rows = F.array(*[F.struct(F.lit(p).alias("percent"), words(n).alias("fields"), words(x).alias("prefixes"), F.lit(a).alias("drop_all")) for p, n, x, a in drops])
    each = top.select("top", F.inline(rows)).withColumn("log_partition", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # Doubled offsets leave a place after each event.
    return each.select("log_partition", (F.expr("top * percent div 100") * 2 + 1).alias("log_offset"), F.lit("drop").alias("op"), F.lit(None).cast("bigint").alias("pk"), F.lit(None).cast(f"map<string,{CELL}>").alias("doc"), "fields", "prefixes", "drop_all")


def with_drops(log: DataFrame, *drops: tuple, parts: int = 1) -> DataFrame:
    return log.withColumn("log_offset", F.col("log_offset") * 2).unionByName(drop_events(log, *drops, parts=parts))


def fold_sql(*drops: tuple, parts: int = 1, with_key: bool = False, where: str = "true", select: str = "SELECT part AS log_partition, pk, field, value, off FROM state") -> str:
    """The same log and fold as SQL; drops as above."""
    key = "UNION ALL SELECT part, pk, 'user_id', CAST(pk AS DOUBLE), off, false FROM e WHERE event_type IN ('view', 'click', 'purchase')" if with_key else ""
    named = " UNION ALL ".join(
        [f"SELECT '{kind}' AS kind, '{arg}' AS arg, top * {p} // 100 * 2 + 1 AS off FROM top" for p, names, prefixes, _ in drops for kind, args in (("name", names), ("prefix", prefixes)) for arg in args]
        or ["SELECT '' AS kind, '' AS arg, CAST(0 AS BIGINT) AS off WHERE false"]
    )
    whole = " UNION ALL ".join([f"SELECT top * {p} // 100 * 2 + 1 AS off FROM top" for p, n, x, a in drops if a and not n and not x] or ["SELECT CAST(-1 AS BIGINT) AS off"])
    return f"""
WITH top AS (SELECT max(event_id) AS top FROM events),
e AS (SELECT event_id * {2 if drops else 1} AS off, user_id AS pk, CAST(user_id % {parts} AS INTEGER) AS part, event_type, value,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE {where}),
cells AS (
  SELECT part, pk, event_type AS field, value, off, false AS deleted FROM e WHERE event_type IN ('view', 'click', 'purchase')
  UNION ALL SELECT part, pk, 'k', k, off, false FROM e WHERE event_type IN ('view', 'click', 'purchase')
  {key}
  UNION ALL SELECT part, pk, 'k', NULL, off, true FROM e WHERE event_type = 'error'),
latest AS (SELECT part, pk, field, arg_max_null(value, off) AS value, max(off) AS off, arg_max_null(deleted, off) AS deleted FROM cells GROUP BY part, pk, field),
docdel AS (SELECT part, pk, max(off) AS off FROM e WHERE event_type = 'signup' GROUP BY part, pk),
named AS ({named}),
dropf AS (SELECT f.field, max(n.off) AS off FROM (SELECT DISTINCT field FROM latest WHERE field <> 'user_id') f
          JOIN named n ON (n.kind = 'name' AND f.field = n.arg) OR (n.kind = 'prefix' AND starts_with(f.field, n.arg)) GROUP BY f.field),
dropall AS (SELECT max(off) AS off FROM ({whole})),
state AS (
  SELECT l.part, l.pk, l.field, l.value, l.off FROM latest l
  LEFT JOIN docdel d ON l.part = d.part AND l.pk = d.pk LEFT JOIN dropf f ON l.field = f.field CROSS JOIN dropall a
  WHERE NOT l.deleted AND l.off > coalesce(d.off, -1) AND l.off > coalesce(f.off, -1) AND l.off > coalesce(a.off, -1))
{select}"""


def cells(state: DataFrame) -> DataFrame:
    return state.select("log_partition", "pk", "field", "value", "off")


TWO_DROPS = ((20, ["view"], [], False), (60, ["click"], [], False))


@query(fold_sql(*TWO_DROPS))
def kv_state_full(spark, sf_dir):
    return cells(fold(with_drops(event_log(spark, sf_dir), *TWO_DROPS), "user_id"))


@query(fold_sql(where="event_type IN ('view', 'click', 'purchase')"))
def kv_upsert_merge(spark, sf_dir):
    return cells(fold(event_log(spark, sf_dir).where("op = 'upsert'"), "user_id"))


@query(fold_sql(where="event_type <> 'signup'"))
def kv_delete_fields(spark, sf_dir):
    return cells(fold(event_log(spark, sf_dir).where("op <> 'delete_doc'"), "user_id"))


@query(fold_sql(where="event_type <> 'error'"))
def kv_delete_document(spark, sf_dir):
    return cells(fold(event_log(spark, sf_dir).where("op <> 'delete_fields'"), "user_id"))


@query(fold_sql(select=", gone AS (SELECT part, pk FROM docdel) SELECT part AS log_partition, pk, count(*) AS fields FROM state JOIN gone USING (part, pk) GROUP BY part, pk"))
def kv_resurrect(spark, sf_dir):
    """Documents that were deleted and written again, with the number of fields they have now."""
    log = event_log(spark, sf_dir)
    gone = log.where("op = 'delete_doc'").select(*KEY).distinct()
    return fold(log, "user_id").join(gone, KEY, "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("fields"))


def _drop_query(name: str, *drops: tuple, parts: int = 1, with_key: bool = False, doc: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cells(fold(with_drops(event_log(spark, sf_dir, parts=parts, with_key=with_key), *drops, parts=parts), "user_id"))

    run.__name__, run.__doc__ = name, doc
    query(fold_sql(*drops, parts=parts, with_key=with_key))(run)


_drop_query("kv_drop_by_name", (99, ["view", "nothing"], [], False))
_drop_query("kv_drop_by_prefix", (99, [], ["vi", "PU"], False), doc="Prefixes match by case.")
_drop_query("kv_drop_empty_prefix", (98, [], [""], False), with_key=True, doc="The empty prefix matches all fields but the key.")
_drop_query("kv_drop_all", (98, [], [], True), with_key=True, doc="Everything goes, keys too.")
_drop_query("kv_drop_precedence", (98, ["click"], [], True), with_key=True, doc="Names come before drop_all.")
_drop_query("kv_drop_pk_ignored", (99, ["user_id", "k"], ["user"], False), with_key=True, doc="The key is protected.")
_drop_query("kv_drop_per_partition", (99, ["k"], ["cl"], False), (97, [], [], True), parts=4, doc="A drop reaches every log partition.")


@query(fold_sql(select="SELECT count(*) > 0 AS exists, max(value) AS value FROM state WHERE pk = 7 AND field = 'k'"))
def kv_get(spark, sf_dir):
    return lookup.get(fold(event_log(spark, sf_dir), "user_id"), 7, "k").select("exists", "value")


@query("SELECT false AS exists, CAST(NULL AS DOUBLE) AS value UNION ALL SELECT false, NULL")
def kv_get_missing(spark, sf_dir):
    """An unknown field and an unknown key can't be told apart."""
    state = fold(event_log(spark, sf_dir), "user_id")
    return lookup.get(state, 7, "nothing").union(lookup.get(state, -1, "k")).select("exists", "value")


@query(fold_sql(select="SELECT u.user_id, count(s.field) > 0 AS exists FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN state s ON s.pk = u.user_id AND s.field = 'purchase' GROUP BY u.user_id"))
def kv_get_exists(spark, sf_dir):
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("pk")).distinct().withColumn("kpos", F.lit(0))
    found = lookup.multiget(fold(event_log(spark, sf_dir), "user_id"), users, ["purchase"])
    return found.select(F.col("pk").alias("user_id"), F.col("value").isNotNull().alias("exists"))


# ------------------------------------------------------------------------------------------------ static stores

CUSTOMER = {"c_name": FieldType.STRING, "c_mktsegment": FieldType.STRING}


def table_state(rows: DataFrame, key: Column, fields: dict[str, FieldType]) -> DataFrame:
    """A table as live cells: one upsert for each row."""
    entries = [x for n, k in fields.items() for x in (F.lit(n), cell(n, k))]
    off = F.lit(0).cast("bigint")
    c = rows.select(F.lit(0).alias("log_partition"), key.alias("pk"), F.explode(F.create_map(*entries)).alias("field", "cell"))
    return c.where("cell is not null").select("log_partition", "pk", "field", "cell.type", "cell.value", off.alias("off"))


def customer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", *CUSTOMER)
    return table_state(rows, F.col("c_custkey").cast("string").cast("binary"), CUSTOMER)


def ask(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(k.encode())) for i, k in enumerate(keys)], "kpos int, pk binary")


def _answers(rows: DataFrame) -> DataFrame:
    return rows.select("kpos", "fpos", F.decode("value", "UTF-8").alias("value"))


def _multiget_sql(keys: list[str], fields: list[str]) -> str:
    k = ", ".join(f"({i}, '{x}')" for i, x in enumerate(keys)) or "(0, '')"
    f = ", ".join(f"({i}, '{x}')" for i, x in enumerate(fields)) or "(0, '')"
    return f"""
SELECT CAST(k.kpos AS INTEGER) AS kpos, CAST(f.fpos AS INTEGER) AS fpos, s.value
FROM (VALUES {k}) k(kpos, pk) CROSS JOIN (VALUES {f}) f(fpos, field)
LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS pk, unnest(['c_name', 'c_mktsegment']) AS field, unnest([c_name, c_mktsegment]) AS value FROM customer) s
  ON s.pk = k.pk AND s.field = f.field
WHERE k.pk <> '' AND f.field <> ''"""


def _multiget_query(name: str, keys: list[str], fields: list[str], doc: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _answers(lookup.multiget(customer_state(spark, sf_dir), ask(spark, keys), fields))

    run.__name__, run.__doc__ = name, doc
    query(_multiget_sql(keys, [f for f in fields if f]))(run)


_multiget_query("kv_multiget_dense", ["3", "foo", "1", "40"], ["c_mktsegment", "bar", "c_name"], "Dense, in request order, nulls for what is absent.")
_multiget_query("kv_multiget_dupes", ["5", "5", "2"], ["c_name", "c_name"], "Duplicates are kept.")
_multiget_query("kv_multiget_empty_keys", ["", "9", ""], ["", "c_name"], "Empty keys and names are left out, positions of keys stay.")
_multiget_query("kv_multiget_none", ["4"], [], "No fields, no rows.")


@query(_multiget_sql(["12", "8", "10"], ["c_name"]))
def kv_multiget_py_order(spark, sf_dir):
    """Bytes keys come before string keys."""
    keys = lookup.order_keys([b"12"], ["8", "", "10"])
    return _answers(lookup.multiget(customer_state(spark, sf_dir), ask(spark, [k.decode() for k in keys]), ["c_name"]))


PART = {"p_name": FieldType.STRING, "p_size": FieldType.INT32, "p_partkey": FieldType.INT64, "p_retailprice": FieldType.FLOAT64}


def part_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_state(read(spark, sf_dir, "part").select(*PART), F.col("p_partkey").cast("string").cast("binary"), PART)


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def kv_typed_decode(spark, sf_dir):
    return lookup.wide_view(part_state(spark, sf_dir), PART).select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS as_int, CASE WHEN p_partkey % 3 = 0 THEN 'size ' || p_size END AS as_string FROM part")
def kv_type_override(spark, sf_dir):
    """A later write with another type wins; a typed view of the old type then reads null."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    doc = lambda c: F.create_map(F.lit("size"), c)
    none = F.array().cast("array<string>")
    first = rows.select("p_partkey", F.lit(0).cast("bigint").alias("log_offset"), doc(cell("p_size", FieldType.INT32)).alias("doc"))
    later = rows.where("p_partkey % 3 = 0").select("p_partkey", F.lit(1).cast("bigint").alias("log_offset"), doc(cell(F.concat(F.lit("size "), F.col("p_size")), FieldType.STRING)).alias("doc"))
    events = first.union(later).select(F.lit(0).alias("log_partition"), "log_offset", F.lit("upsert").alias("op"), F.col("p_partkey").alias("pk"), "doc", none.alias("fields"), none.alias("prefixes"), F.lit(False).alias("drop_all"))
    state = fold(events, "p_partkey")
    return state.select(F.col("pk").alias("p_partkey"), decode_cell("type", "value", FieldType.INT32).alias("as_int"), decode_cell("type", "value", FieldType.STRING).alias("as_string"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 1")
def kv_unknown_type_filter(spark, sf_dir):
    """Values of unknown type aren't stored; an event of nothing else changes nothing."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    tag = F.when(F.col("p_partkey") % 2 == 1, F.lit(int(FieldType.STRING))).otherwise(F.lit(0))
    none = F.array().cast("array<string>")
    doc = F.create_map(F.lit("p_name"), F.struct(tag.alias("type"), F.encode("p_name", "UTF-8").alias("value")))
    events = rows.select(F.lit(0).alias("log_partition"), F.col("p_partkey").alias("log_offset"), F.lit("upsert").alias("op"), F.col("p_partkey").alias("pk"), doc.alias("doc"), none.alias("fields"), none.alias("prefixes"), F.lit(False).alias("drop_all"))
    return fold(events, "id").select(F.col("pk").alias("p_partkey"), F.decode("value", "UTF-8").alias("p_name"))


WIDE = ["view", "click", "purchase", "k"]


@query(fold_sql(select="SELECT pk, " + ", ".join(f"max(CASE WHEN field = '{n}' THEN value END) AS {n}" for n in WIDE) + " FROM state GROUP BY pk"))
def kv_wide_view(spark, sf_dir):
    return lookup.wide_view(fold(event_log(spark, sf_dir), "user_id"), WIDE).drop("log_partition")


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def kv_feature_join(spark, sf_dir):
    features = lookup.wide_view(customer_state(spark, sf_dir), CUSTOMER)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lookup.enrich(orders, features, F.col("o_custkey").cast("string").cast("binary") == F.col("pk"))
    return joined.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos, CAST(embedding[p] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings WHERE vec_id % 5 = 0)")
def kv_embedding_multiget(spark, sf_dir):
    """Array-valued features stay arrays."""
    e = read(spark, sf_dir, "embeddings")
    c = F.struct(F.lit(int(FieldType.BYTES)).alias("type"), F.col("embedding").alias("value"))
    state = e.select(F.lit(0).alias("log_partition"), F.col("vec_id").alias("pk"), F.lit("embedding").alias("field"), c["type"].alias("type"), c["value"].alias("value"), F.lit(0).cast("bigint").alias("off"))
    keys = e.where("vec_id % 5 = 0").select(F.lit(0).alias("kpos"), F.col("vec_id").alias("pk"))
    found = lookup.multiget(state, keys, ["embedding"])
    return found.select(F.col("pk").alias("vec_id"), F.posexplode("value").alias("pos", "v")).select("vec_id", "pos", F.col("v").cast("double").alias("value"))


@query(
    """WITH f AS (SELECT event_type AS field, min(event_id) AS first_offset FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1
       UNION ALL SELECT 'k', min(event_id) FROM events WHERE event_type IN ('view', 'click', 'purchase'))
       SELECT field, CAST(row_number() OVER (ORDER BY first_offset, field) AS INTEGER) AS field_id, first_offset FROM f
       UNION ALL SELECT 'user_id', 0, min(event_id) FROM events WHERE event_type IN ('view', 'click', 'purchase')"""
)
def kv_schema_registry(spark, sf_dir):
    return registry(event_log(spark, sf_dir, with_key=True), "user_id").select("field", "field_id", "first_offset")


def _halves(spark: SparkSession, sf_dir: str, overlap: int) -> DataFrame:
    """A fold of the first half, and of the rest on top of it; the rest begins ``overlap`` percent early."""
    log = event_log(spark, sf_dir)
    top = log.agg(F.max("log_offset").alias("top"))
    at = lambda p, sign: log.crossJoin(top).where(f"log_offset {sign} top * {p} div 100").drop("top")
    return cells(fold(at(50 - overlap, ">"), "user_id", fold(at(50, "<="), "user_id")))


@query(fold_sql())
def kv_snapshot_plus_delta(spark, sf_dir):
    return _halves(spark, sf_dir, 0)


@query(fold_sql())
def kv_redelivery(spark, sf_dir):
    return _halves(spark, sf_dir, 20)


@query(fold_sql(where="event_id <= (SELECT max(event_id) * 3 // 10 FROM events)"))
def kv_as_of_offset(spark, sf_dir):
    log = event_log(spark, sf_dir)
    top = log.agg(F.expr("max(log_offset) * 3 div 10").alias("at"))
    return cells(fold(log.crossJoin(top).where("log_offset <= at").drop("at"), "user_id"))


@query(
    fold_sql(
        select=""", w AS (SELECT part, pk, count(*) AS n, sum(CASE WHEN value IS NULL THEN 0 ELSE 8 END) AS b FROM cells WHERE NOT deleted GROUP BY part, pk),
        s AS (SELECT part, pk, count(*) AS n, sum(CASE WHEN value IS NULL THEN 0 ELSE 8 END) AS b FROM state GROUP BY part, pk)
        SELECT (SELECT CAST(sum(n) AS BIGINT) FROM w) AS cells_before, (SELECT count(*) FROM w) AS documents_before, (SELECT CAST(sum(b) AS BIGINT) FROM w) AS bytes_before,
          (SELECT CAST(sum(n) AS BIGINT) FROM s) AS cells_after, (SELECT count(*) FROM s) AS documents_after, (SELECT CAST(sum(b) AS BIGINT) FROM s) AS bytes_after"""
    )
)
def kv_compaction_stats(spark, sf_dir):
    log = event_log(spark, sf_dir)
    payload = lambda c: c.withColumn("value", F.when(F.col("value").isNotNull(), F.unhex(F.lit("00" * 8))))
    return maintenance.compaction_stats(payload(writes(log).where("not deleted")), payload(fold(log, "user_id")))


@query("SELECT CAST(user_id % 4 AS INTEGER) AS log_partition, min(event_id) AS low, max(event_id) + 1 AS high FROM events GROUP BY 1")
def kv_offset_bounds(spark, sf_dir):
    return maintenance.offset_bounds(event_log(spark, sf_dir, parts=4))


@query(
    """WITH b AS (SELECT CAST(user_id % 4 AS INTEGER) AS p, min(event_id) AS low FROM events GROUP BY 1),
       s AS (SELECT CAST(user_id % 4 AS INTEGER) AS p, CASE WHEN user_id % 4 = 2 THEN min(event_id) - 100000 ELSE max(event_id) END AS off FROM events WHERE event_type = 'click' AND user_id % 4 < 3 GROUP BY user_id % 4)
       SELECT b.p AS log_partition, CASE WHEN s.off >= b.low THEN s.off ELSE b.low END AS start FROM b LEFT JOIN s USING (p)"""
)
def kv_start_offsets(spark, sf_dir):
    """Stored are the last clicks of two log partitions, an offset that the log no longer has of a third, and none of a fourth."""
    log = event_log(spark, sf_dir, parts=4)
    clicks = log.where("map_contains_key(doc, 'click') and log_partition < 3").groupBy("log_partition").agg(F.max("log_offset").alias("last"), F.min("log_offset").alias("first"))
    stored = clicks.select("log_partition", F.when(F.col("log_partition") == 2, F.col("first") - 100_000).otherwise(F.col("last")).alias("off"))
    return maintenance.start_offsets(maintenance.offset_bounds(log), stored)


@query("SELECT 0 AS log_partition, event_id AS off FROM events WHERE (event_id + 1) % 100 = 0")
def kv_commit_points(spark, sf_dir):
    return maintenance.commit_points(event_log(spark, sf_dir))


@query(
    "SELECT 'acct' AS account, 'store' || o_custkey % 3 AS store, CAST(o_orderkey % 4 AS INTEGER) AS partition, max(CAST(o_orderkey AS BIGINT)) AS epoch, "
    "'acct/store' || o_custkey % 3 || '/' || o_orderkey % 4 || '/' || max(CAST(o_orderkey AS BIGINT)) AS path FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY o_custkey % 3, o_orderkey % 4"
)
def kv_latest_image(spark, sf_dir):
    """Paths named after orders; those that don't end in a number aren't images."""
    k = F.col("o_orderkey")
    path = codec.image_path(F.lit("acct"), F.concat(F.lit("store"), F.col("o_custkey") % 3), k % 4, F.when(k % 9 == 0, F.concat(k, F.lit("notes"))).otherwise(k.cast("string")))
    return maintenance.latest_image(read(spark, sf_dir, "orders").select(path.alias("path")))


DAY = 86_400_000


@query(
    "SELECT o_orderkey, coalesce(l IS NULL OR l = 0 OR (l >= 7 AND r < 7) OR NOT v, false) AS refresh FROM "
    "(SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 11 END AS l, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey % 10 END AS r, o_orderkey % 13 <> 0 AS v FROM orders)"
)
def kv_staleness(spark, sf_dir):
    """Ages in days, 0 for no image, from the keys of orders."""
    now, k = F.lit(1_000 * DAY), F.col("o_orderkey")
    local = F.when(k % 17 == 0, None).when(k % 11 == 0, 0).otherwise(now - k % 11 * DAY)
    remote = F.when(k % 19 == 0, None).otherwise(now - F.col("o_custkey") % 10 * DAY)
    return read(spark, sf_dir, "orders").select("o_orderkey", maintenance.stale(local.cast("bigint"), remote.cast("bigint"), now, k % 13 != 0).alias("refresh"))


@query("SELECT p_size || '.' || p_partkey % 20 || '.' || p_partkey % 7 AS version FROM part ORDER BY p_size DESC, p_partkey % 20 DESC, p_partkey % 7 DESC LIMIT 1")
def kv_semver_max(spark, sf_dir):
    k = F.col("p_partkey")
    return maintenance.newest_version(read(spark, sf_dir, "part").select(F.concat_ws(".", "p_size", k % 20, k % 7).alias("version")))


@query(
    """SELECT coalesce(problem, 'good') AS outcome, count(*) AS events FROM (
         SELECT CASE WHEN doc_id % 7 = 0 THEN 'no primary key' WHEN doc_id % 7 = 1 THEN 'no primary key' WHEN doc_id % 7 = 2 THEN 'payload of another width than its type'
           WHEN doc_id % 7 = 3 THEN 'primary key too long' WHEN doc_id % 7 = 4 THEN 'unknown operation' END AS problem FROM documents) GROUP BY 1"""
)
def kv_validation_dead_letter(spark, sf_dir):
    """Missing and untyped keys, wrong widths, long keys and unknown operations are set aside; empty documents are not."""
    kind = F.col("doc_id") % 7
    text = lambda c: cell(c, FieldType.STRING)
    key = F.when(kind == 1, F.struct(F.lit(0).alias("type"), F.encode(F.lit("x"), "UTF-8").alias("value"))).when(kind == 3, text(F.repeat(F.lit("k"), 70_000))).otherwise(text(F.col("doc_id").cast("string")))
    wide = F.struct(F.lit(int(FieldType.INT32)).alias("type"), F.unhex(F.lit("000102")).alias("value"))
    doc = F.when(kind == 0, F.create_map(F.lit("lang"), text(F.col("lang")))).when(kind == 2, F.create_map(F.lit("doc_id"), key, F.lit("size"), wide)).when(kind == 5, F.create_map().cast("map<string,struct<type:int,value:binary>>")).otherwise(F.create_map(F.lit("doc_id"), key))
    none = F.array().cast("array<string>")
    raw = read(spark, sf_dir, "documents").select(F.lit(0).alias("log_partition"), F.col("doc_id").alias("log_offset"), F.when(kind == 4, "merge").otherwise("upsert").alias("op"), doc.alias("doc"), none.alias("fields"), none.alias("prefixes"), F.lit(False).alias("drop_all"))
    return validation.check(raw, "doc_id").groupBy(F.coalesce("problem", F.lit("good")).alias("outcome")).agg(F.count(F.lit(1)).alias("events"))


@query("SELECT CAST(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 4) AS INTEGER) % 16 AS INTEGER) AS shard, count(*) AS customers FROM customer GROUP BY 1")
def kv_segment_histogram(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy(codec.shard(F.col("c_custkey").cast("string"), 16).alias("shard")).agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation WHERE n_nationkey % 5 <> 4 OR n_nationkey % 2 = 0")
def kv_config_merge(spark, sf_dir):
    """Options named after nations: the server has four of five, the client every second one."""
    from foldstore.config import merge_options

    nations = read(spark, sf_dir, "nation").collect()
    server = {r.n_name: str(r.n_regionkey) for r in nations if r.n_nationkey % 5 != 4}
    merged = merge_options(server, {r.n_name: r.n_name.lower() for r in nations if r.n_nationkey % 2 == 0})
    return spark.createDataFrame([(k, str(v)) for k, v in merged.items()], "name string, value string")


@query("SELECT c_custkey, c_name AS a, '' AS b, CAST(NULL AS VARCHAR) AS c, CAST(octet_length(encode(c_name)) + octet_length(encode(c_mktsegment)) + 16 AS INTEGER) AS packed_bytes FROM customer")
def kv_pack_unpack(spark, sf_dir):
    """A size-prefixed list of a name, an empty value, an absent one and a segment, packed and unpacked."""
    e = lambda c: F.encode(c, "UTF-8")
    rows = read(spark, sf_dir, "customer").select("c_custkey", codec.pack_column(F.array(e(F.col("c_name")), e(F.lit("")), F.lit(None).cast("binary"), e(F.col("c_mktsegment")))).alias("packed"))
    out = rows.select("c_custkey", F.octet_length("packed").alias("packed_bytes"), codec.unpack_column("packed").alias("v"))
    return out.select("c_custkey", *[F.decode(F.col("v")[i], "UTF-8").alias(n) for i, n in enumerate("abc")], "packed_bytes")


@query("SELECT p_partkey, p_size AS i32, -p_partkey * 3000000000 AS i64, CAST(p_retailprice AS DOUBLE) AS f64, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS f32, p_size > 25 AS flag FROM part")
def kv_numeric_codec(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    kinds = {"i32": (F.col("p_size"), FieldType.INT32), "i64": (-F.col("p_partkey") * F.lit(3_000_000_000), FieldType.INT64), "f64": (F.col("p_retailprice"), FieldType.FLOAT64), "f32": (F.col("p_retailprice").cast("float"), FieldType.FLOAT32), "flag": (F.col("p_size") > 25, FieldType.BOOLEAN)}
    coded = p.select("p_partkey", *[encode(c, k).alias(n) for n, (c, k) in kinds.items()])
    return coded.select("p_partkey", *[(decode(n, k).cast("double") if n == "f32" else decode(n, k)).alias(n) for n, (_, k) in kinds.items()])


@query(fold_sql(select="SELECT pk, count(*) AS fields, max(off) AS last FROM state GROUP BY pk"))
def kv_documents(spark, sf_dir):
    """Whole documents: the number of their live fields and their last write."""
    state = fold(event_log(spark, sf_dir), "user_id")
    docs = lookup.document(state).select(*KEY, F.size("doc").alias("n"))
    return docs.join(state.groupBy(*KEY).agg(F.max("off").alias("last")), KEY).select("pk", F.col("n").cast("long").alias("fields"), "last")


def _binary_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a raw binary log, as a store's log holds them."""
    e = read(spark, sf_dir, "events")
    text = lambda c: cell(c.cast("string"), FieldType.STRING)
    key = F.create_map(F.lit("user_id"), text(F.col("user_id")))
    full = F.create_map(F.lit("user_id"), text(F.col("user_id")), F.col("event_type"), text(F.col("event_id")), F.lit("k"), text(F.get_json_object("props", "$.k")))
    none = F.array().cast("array<string>")
    op = F.when(F.col("event_type").isin(*UPSERTS), "upsert").when(F.col("event_type") == "error", "delete_fields").otherwise("delete_doc")
    return e.select(
        F.lit(0).alias("log_partition"), F.col("event_id").alias("log_offset"), op.alias("op"), F.when(F.col("event_type").isin(*UPSERTS), full).otherwise(key).alias("doc"),
        F.when(F.col("event_type") == "error", F.array(F.lit("k"))).otherwise(none).alias("fields"), none.alias("prefixes"), F.lit(False).alias("drop_all"),
    )


@query(
    fold_sql(
        with_key=True,
        select=", t AS (SELECT s.*, e.off AS w FROM state s JOIN e USING (off)) SELECT CAST(pk AS VARCHAR) AS pk, field, CASE WHEN field = 'k' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) WHEN field = 'user_id' THEN CAST(pk AS VARCHAR) ELSE CAST(off AS VARCHAR) END AS value FROM t",
    )
)
def kv_stream_equals_batch(spark, sf_dir):
    """The log appended in four commits and folded by the streaming maintainer, one commit a micro-batch."""
    from foldstore.config import StoreConfig
    from foldstore.sources import files
    from foldstore.store import Store

    path = files.scratch(spark, "stream")
    store = Store.create(spark, StoreConfig("acct", "events", "user_id", path=path))
    raw = _binary_log(spark, sf_dir)
    top = raw.agg(F.max("log_offset")).first()[0]
    for k in range(4):
        part = raw.where((F.col("log_offset") > top * k // 4 - (k == 0)) & (F.col("log_offset") <= top * (k + 1) // 4))
        store.log.append_raw(part.coalesce(1).sortWithinPartitions("log_offset"))
    store.maintainer().catch_up(f"{path}/checkpoint", max_files=1)
    return store.live.cells(store.live.latest()).select(F.decode("pk", "UTF-8").alias("pk"), "field", F.decode("value", "UTF-8").alias("value"))
