import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldstore.functions import codec
from foldstore.functions.fields import FieldType, decode, encode
from foldstore.sources import wire


@given(st.lists(st.one_of(st.none(), st.binary(max_size=20))))
@settings(max_examples=100, deadline=None)
def test_pack_round_trip(values):
    assert codec.unpack(codec.pack(values)) == values
    assert codec.unpack(codec.pack(values), skip_empty=True) == [v for v in values if v]


def test_pack_layout():
    assert codec.pack(["bar", "", None]) == b"\x03\0\0\0bar\0\0\0\0\xff\xff\xff\xff"
    assert codec.unpack(codec.pack([b"bar", b"", "", "foo"])) == [b"bar", b"", b"", b"foo"]
    with pytest.raises(ValueError):
        codec.unpack(b"\x09\0\0\0ab")


@pytest.mark.parametrize(
    ("kind", "sql", "values", "payload"),
    [
        (FieldType.INT32, "int", [0, 1, -1, 2**31 - 1, -(2**31), None], b"\xff\xff\xff\xff"),
        (FieldType.INT64, "bigint", [0, 1, -1, 2**63 - 1, -(2**63), None], b"\xff" * 8),
        (FieldType.FLOAT64, "double", [0.0, 1.5, -2.25, 1e300, 3.0, None], b"\0\0\0\0\0\0\x02\xc0"),
        (FieldType.FLOAT32, "float", [0.0, 1.5, -2.25, 0.5, 3.0, None], b"\0\0\x10\xc0"),
        (FieldType.BOOLEAN, "boolean", [True, False, True, False, True, None], b"\x01"),
        (FieldType.STRING, "string", ["", "é", "x", "y", "z", None], b"x"),
    ],
)
def test_values_round_trip(spark, kind, sql, values, payload):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {sql}")
    got = df.select("i", "v", encode("v", kind).alias("p")).select("i", "v", "p", decode("p", kind).alias("back")).orderBy("i").collect()
    assert [r.back for r in got] == values
    assert bytes(got[2].p) == payload
    if kind not in (FieldType.STRING,):
        assert spark.range(1).select(decode(F.unhex(F.lit("010203")), kind).alias("x")).first().x is None


def test_versions_and_paths(spark):
    df = spark.createDataFrame([("0.10.2",), ("0.9.12",)], "v string")
    assert df.select(F.max_by("v", codec.version("v"))).first()[0] == "0.10.2"
    path = codec.image_path(F.lit("a"), F.lit("s"), F.lit(1), F.lit(99))
    assert spark.range(1).select(codec.image_parts(path).alias("p")).first().p.asDict() == {"account": "a", "store": "s", "partition": 1, "epoch": 99}


def test_arguments():
    assert codec.require_key(bytearray(b"x")) == b"x" and codec.require_key("x") == b"x"
    with pytest.raises(TypeError):
        codec.require_key(5)
    with pytest.raises(ValueError):
        codec.require_name(" ", "field")
    assert len(codec.key_digest("secret")[0]) == 44


NAMES = st.text(max_size=12)
CELLS = st.dictionaries(NAMES, st.tuples(st.integers(0, 7), st.binary(max_size=30)), max_size=5)


@given(st.integers(0, 2**64 - 1), st.binary(max_size=5))
@settings(max_examples=200, deadline=None)
def test_varints(n, rest):
    b = codec.varint(n)
    assert codec.read_varint(b + rest) == (n, len(b)) and len(b) == max(1, -(-n.bit_length() // 7))
    with pytest.raises(ValueError):
        codec.read_varint(b[:-1])


@given(st.sampled_from(["upsert", "delete_fields", "delete_doc", "drop"]), CELLS, st.lists(NAMES, max_size=4), st.lists(NAMES, max_size=3), st.booleans())
@settings(max_examples=200, deadline=None)
def test_events_on_the_wire(op, doc, fields, prefixes, everything):
    got = wire.decode_event(wire.encode_event(op, doc, fields, prefixes, everything))
    drop = op == "drop"
    assert got == (op, {} if drop else doc, fields if drop or op == "delete_fields" else [], prefixes if drop else [], everything and drop)


def test_events_of_other_writers():
    # A header comes first, and a field that isn't known in between; an upsert of {"a": INT32 7}.
    cell = bytes([0x08, 1, 0x12, 4, 7, 0, 0, 0])
    entry = b"\x0a\x01a\x12" + bytes([len(cell)]) + cell
    document = b"\x0a" + bytes([len(entry)]) + entry
    event = b"\x0a\x02\x0a\x00" + b"\x7d\x01\x02\x03\x04" + b"\x12" + bytes([len(document) + 2, 0x0A, len(document)]) + document
    assert wire.decode_event(event) == ("upsert", {"a": (1, b"\x07\0\0\0")}, [], [], False)
    assert wire.decode_event(b"")[0] == "noop" and wire.decode_event(b"\x12\x7f")[0] == "damaged" and wire.decode_event(b"\xff")[0] == "damaged"
    assert wire.decode_event(b"\x2a\x02\x18\x01") == ("drop", {}, [], [], True)


def test_columns_of_pass_keys(spark):
    key, digest = codec.key_digest_columns(F.col("k"))
    for r in spark.createDataFrame([("secret",), ("x",), ("a" * 40,)], "k string").select("k", key.alias("a"), digest.alias("b")).collect():
        assert (r.a, r.b) == codec.key_digest(r.k)


def test_floats_that_are_not_numbers(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, float("inf")), (2, None), (3, -0.0)], "i int, v double")
    got = df.select("i", decode(encode("v", FieldType.FLOAT64), FieldType.FLOAT64).alias("b")).orderBy("i").collect()
    assert got[1].b == float("inf") and got[2].b is None and str(got[3].b) == "-0.0"
