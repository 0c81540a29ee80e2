"""Documents built value by value, for writers that hold a few of them rather than a table."""

from __future__ import annotations

import struct

from foldstore.functions.codec import require_name
from foldstore.functions.fields import FieldType


class Document:
    """Chained setters; a name that is set twice keeps the last value."""

    def __init__(self):
        self.cells: dict[str, tuple[int, bytes]] = {}

    def _put(self, name: str, kind: FieldType, payload: bytes) -> Document:
        self.cells[require_name(name, "field")] = int(kind), payload
        return self

    def _need(self, value: object, kinds: type | tuple[type, ...]) -> None:
        if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in (kinds if isinstance(kinds, tuple) else (kinds,))):
            raise TypeError(f"a value of type {type(value).__name__} doesn't go there")

    def put_string(self, name: str, value: str) -> Document:
        self._need(value, str)
        return self._put(name, FieldType.STRING, value.encode())

    def put_bytes(self, name: str, value: bytes) -> Document:
        self._need(value, (bytes, bytearray))
        return self._put(name, FieldType.BYTES, bytes(value))

    def put_int(self, name: str, value: int) -> Document:
        self._need(value, int)
        return self._put(name, FieldType.INT32, struct.pack("<i", value))

    def put_long(self, name: str, value: int) -> Document:
        self._need(value, int)
        return self._put(name, FieldType.INT64, struct.pack("<q", value))

    def put_float(self, name: str, value: float) -> Document:
        self._need(value, (int, float))
        return self._put(name, FieldType.FLOAT32, struct.pack("<f", value))

    def put_double(self, name: str, value: float) -> Document:
        self._need(value, (int, float))
        return self._put(name, FieldType.FLOAT64, struct.pack("<d", value))

    def put_bool(self, name: str, value: bool) -> Document:
        self._need(value, bool)
        return self._put(name, FieldType.BOOLEAN, bytes([value]))
