"""Types of field values: tags, payload widths, and codecs between payload bytes and typed columns.

A cell is a tag and a payload. Integers are little-endian two's complement, floats IEEE 754 little-endian, booleans one
byte, strings UTF-8. Integers, booleans and strings are encoded and decoded by built-in expressions; floats have no
built-in form and go through Arrow batches.
"""

from __future__ import annotations

from enum import IntEnum

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class FieldType(IntEnum):
    UNKNOWN = 0
    INT32 = 1
    INT64 = 2
    FLOAT32 = 3
    FLOAT64 = 4
    STRING = 5
    BYTES = 6
    BOOLEAN = 7


#: Bytes of the types of fixed width.
WIDTH = {FieldType.INT32: 4, FieldType.INT64: 8, FieldType.FLOAT32: 4, FieldType.FLOAT64: 8, FieldType.BOOLEAN: 1}
SQL_TYPE = {
    FieldType.INT32: "int", FieldType.INT64: "bigint", FieldType.FLOAT32: "float", FieldType.FLOAT64: "double",
    FieldType.STRING: "string", FieldType.BYTES: "binary", FieldType.BOOLEAN: "boolean",
}
CELL = "struct<type:int,value:binary>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _swapped(digits: Column, width: int) -> Column:
    """Hex digits of ``width`` bytes in the other byte order."""
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))])


def encode_int(c: Column | str, width: int) -> Column:
    digits = F.lpad(F.hex(col(c).cast("bigint")), 16, "0")
    return F.unhex(_swapped(F.substring(digits, 17 - 2 * width, 2 * width), width))


def decode_int(payload: Column | str, width: int) -> Column:
    unsigned = F.conv(_swapped(F.hex(col(payload)), width), 16, 10).cast("decimal(20,0)")
    top = F.lit(str(1 << (8 * width - 1))).cast("decimal(20,0)")
    whole = F.lit(str(1 << (8 * width))).cast("decimal(21,0)")
    signed = F.when(unsigned >= top, unsigned - whole).otherwise(unsigned)
    return F.when(F.octet_length(col(payload)) == width, signed.cast("int" if width == 4 else "bigint"))


def _float_codec(width: int):
    import numpy as np

    kind = "<f4" if width == 4 else "<f8"

    @F.pandas_udf("binary")
    def encode(x: pd.Series) -> pd.Series:
        raw, missing = x.to_numpy(kind).tobytes(), x.isna().to_numpy()
        return pd.Series([None if gone else raw[k : k + width] for k, gone in zip(range(0, len(raw), width), missing.tolist(), strict=True)], dtype=object)

    @F.pandas_udf("float" if width == 4 else "double")
    def decode(x: pd.Series) -> pd.Series:
        there = np.fromiter((v is not None and len(v) == width for v in x), bool, len(x))
        out = np.full(len(x), np.nan)
        out[there] = np.frombuffer(b"".join(x[there]), kind)
        # Values that are there may be NaN themselves; those that aren't are null.
        return pd.Series(pd.arrays.ArrowExtensionArray(pa.array(out.astype("f4" if width == 4 else "f8"), mask=~there)))

    return encode, decode


def encode(c: Column | str, kind: FieldType) -> Column:
    """Payload of a typed column; null stays null."""
    c = col(c)
    if kind in (FieldType.INT32, FieldType.INT64):
        return encode_int(c, WIDTH[kind])
    if kind in (FieldType.FLOAT32, FieldType.FLOAT64):
        return _float_codec(WIDTH[kind])[0](c)
    if kind == FieldType.BOOLEAN:
        return F.when(c, F.unhex(F.lit("01"))).when(~c, F.unhex(F.lit("00")))
    if kind == FieldType.STRING:
        return F.encode(c, "UTF-8")
    if kind == FieldType.BYTES:
        return c.cast("binary")
    raise ValueError("values of an unknown type have no payload")


def decode(payload: Column | str, kind: FieldType) -> Column:
    """Typed column of a payload; null where the payload hasn't the type's width."""
    payload = col(payload)
    if kind in (FieldType.INT32, FieldType.INT64):
        return decode_int(payload, WIDTH[kind])
    if kind in (FieldType.FLOAT32, FieldType.FLOAT64):
        return _float_codec(WIDTH[kind])[1](payload)
    if kind == FieldType.BOOLEAN:
        return F.when(F.octet_length(payload) == 1, F.hex(payload) != "00")
    if kind == FieldType.STRING:
        return F.decode(payload, "UTF-8")
    if kind == FieldType.BYTES:
        return payload
    raise ValueError("values of an unknown type can't be read")


def decode_cell(tag: Column | str, payload: Column | str, kind: FieldType) -> Column:
    """As ``decode``, and null where the cell's own tag is another."""
    return F.when(col(tag) == int(kind), decode(payload, kind))


def cell(c: Column | str, kind: FieldType) -> Column:
    """A cell of a typed column; null where the value is."""
    payload = encode(c, kind)
    return F.when(payload.isNotNull(), F.struct(F.lit(int(kind)).alias("type"), payload.alias("value")))


def known(tag: Column) -> Column:
    return tag.between(int(FieldType.INT32), int(FieldType.BOOLEAN))


def well_formed(tag: Column, payload: Column) -> Column:
    """True where a payload is there and has its type's width."""
    width = F.create_map(*[F.lit(int(x)) for kv in WIDTH.items() for x in kv])
    return payload.isNotNull() & F.coalesce(F.octet_length(payload) == width[tag], F.lit(True))
