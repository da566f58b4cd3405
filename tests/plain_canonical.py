"""The canonical bytes of one value at a time: what the array version is held against."""

import struct

import pyarrow as pa
from pyspark.sql import types as T

from attestry.functions.canonical import BINARY, LIST, MAP, STRING, STRUCT, _raw, fixed


def value_bytes(v, t: T.DataType) -> bytes:
    """The canonical bytes of one value as Arrow gives it to Python."""
    if v is None:
        return b"\0"
    if isinstance(t, T.ArrayType):
        return _sequence(LIST, [value_bytes(x, t.elementType) for x in v])
    if isinstance(t, T.StructType):
        return _sequence(STRUCT, [value_bytes(v[f.name], f.dataType) for f in t])
    if isinstance(t, T.MapType):
        return _sequence(MAP, [_sequence(STRUCT, [value_bytes(k, t.keyType), value_bytes(x, t.valueType)]) for k, x in v])
    if isinstance(t, T.StringType):
        v = v.encode()
    if isinstance(t, (T.StringType, T.BinaryType)):
        return bytes([STRING if isinstance(t, T.StringType) else BINARY]) + struct.pack("<Q", len(v)) + v
    tag, width = fixed(t)
    raw = _raw(pa.array([v], _arrow(t)), width)
    return bytes([tag]) + raw.tobytes()


def _arrow(t: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def _sequence(tag: int, items: list[bytes]) -> bytes:
    return bytes([tag]) + struct.pack("<Q", len(items)) + b"".join(struct.pack("<Q", len(x)) + x for x in items)
