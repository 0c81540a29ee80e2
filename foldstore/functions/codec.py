"""Scalar helpers: size-prefixed lists, versions, paths of images, key digests, shards, and checks of arguments."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack(values: list[bytes | str | None]) -> bytes:
    """Each value as a 32-bit little-endian length and its bytes; length -1 for a null."""
    out = []
    for v in values:
        if v is None:
            out.append(struct.pack("<i", -1))
            continue
        b = v.encode() if isinstance(v, str) else bytes(v)
        out.append(struct.pack("<i", len(b)) + b)
    return b"".join(out)


def unpack(data: bytes, *, skip_empty: bool = False) -> list[bytes | None]:
    """The values of a packed list. skip_empty: values without bytes are left out, as in requests."""
    out: list[bytes | None] = []
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        if n > 0:
            if at + n > len(data):
                raise ValueError("a value ends past its list")
            out.append(data[at : at + n])
            at += n
        elif not skip_empty:
            out.append(None if n < 0 else b"")
    return out


def varint(n: int) -> bytes:
    """A number below 2^64 in groups of seven bits, lowest first, all but the last marked by their top bit."""
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | 128 if n else low)
        if not n:
            return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, place after it)."""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number that doesn't end")
        b = data[at]
        n, at, shift = n | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return n, at


@F.pandas_udf(T.BinaryType())
def pack_column(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else pack(list(v)))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def unpack_column(data: pd.Series) -> pd.Series:
    return data.map(lambda v: None if v is None else unpack(bytes(v)))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def unpack_request_column(data: pd.Series) -> pd.Series:
    return data.map(lambda v: None if v is None else unpack(bytes(v), skip_empty=True))


def version(c: Column | str) -> Column:
    """major.minor.patch as a struct that compares in order."""
    parts = F.split(F.col(c) if isinstance(c, str) else c, r"\.")
    return F.struct(*[F.try_element_at(parts, F.lit(k + 1)).try_cast("int").alias(n) for k, n in enumerate(("major", "minor", "patch"))])


def image_path(account: Column, store: Column, partition: Column, epoch: Column) -> Column:
    return F.concat_ws("/", account, store, partition.cast("string"), epoch.cast("string"))


def image_parts(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.struct(parts[0].alias("account"), parts[1].alias("store"), parts[2].try_cast("int").alias("partition"), parts[3].try_cast("bigint").alias("epoch"))


def key_digest(passkey: str) -> tuple[str, str]:
    """(base64 of a 32-byte key made of the repeated pass key, base64 of its MD5), as object stores take them."""
    import base64
    import hashlib

    if not passkey:
        raise ValueError("a pass key isn't empty")
    raw = (passkey.encode() * (32 // len(passkey.encode()) + 1))[:32]
    return base64.b64encode(raw).decode(), base64.b64encode(hashlib.md5(raw).digest()).decode()


def key_digest_columns(passkey: Column) -> tuple[Column, Column]:
    """As ``key_digest``, of a column of pass keys of single-byte characters."""
    raw = F.substring(F.repeat(passkey, 32), 1, 32)
    return F.base64(raw.cast("binary")), F.base64(F.unhex(F.md5(raw.cast("binary"))))


def shard(key: Column, shards: int) -> Column:
    """A stable shard of a key by the head of its MD5; the same in every SQL engine."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int") % shards).cast("int")


def require_name(value: object, what: str) -> str:
    if not isinstance(value, str):
        raise TypeError(f"{what} is a string")
    if not value.strip():
        raise ValueError(f"{what} isn't empty")
    return value


def require_key(value: object) -> bytes:
    """Bytes of a key given as string or bytes."""
    if isinstance(value, str):
        return value.encode()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    raise TypeError("a key is a string or bytes")
