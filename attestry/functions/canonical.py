"""The canonical bytes of cells and rows, made by array operations at any depth.

Fixed values, so that equal data have equal fingerprints everywhere: a cell is the marker CELL, the column's number,
the length of its value and the value; a null is one zero byte; any other value begins with its type's tag. Integers
are little-endian; strings, binaries and sequences state their length in eight bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedType

# Fixed values of the format.
MAGIC, FIELD, BODY, CELL = b"pf-fp-v1\0", b"pf-schema-field-v1\0", b"pf-fp-body-v1\0", b"pf-cell-v1\0"
FIXED = {T.ByteType: (1, 1), T.ShortType: (2, 2), T.IntegerType: (3, 4), T.LongType: (4, 8), T.FloatType: (9, 4), T.DoubleType: (10, 8), T.DateType: (11, 4), T.TimestampType: (15, 8), T.TimestampNTZType: (15, 8), T.DecimalType: (17, 16), T.BooleanType: (18, 1)}
STRING, BINARY, LIST, STRUCT, MAP = 19, 21, 23, 26, 27
HEAD = len(CELL) + 16


def fixed(t: T.DataType) -> tuple[int, int] | None:
    """Tag and width of a type whose values all have one width."""
    return next((v for k, v in FIXED.items() if isinstance(t, k)), None)


def supported(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return supported(t.elementType)
    if isinstance(t, T.MapType):
        return supported(t.keyType) and supported(t.valueType)
    if isinstance(t, T.StructType):
        return all(supported(f.dataType) for f in t)
    return fixed(t) is not None or isinstance(t, (T.StringType, T.BinaryType, T.NullType))


def header(fields: list[tuple[str, str, bool]]) -> bytes:
    """What comes before the rows; fields: name, type's name, nullable."""
    out = bytearray(MAGIC)
    for name, kind, nullable in fields:
        out += FIELD
        for s in (name.encode(), kind.encode()):
            out += struct.pack("<Q", len(s)) + s
        out.append(nullable)
    return bytes(out + BODY)


def length(c: Column, t: T.DataType) -> Column:
    """Bytes of a value, as a Spark expression: sizes are known without encoding anything."""
    flat = fixed(t)
    if isinstance(t, T.NullType):
        return F.lit(1).cast("long")
    if flat:
        size = F.lit(1 + flat[1]).cast("long")
    elif isinstance(t, (T.StringType, T.BinaryType)):
        size = F.octet_length(c).cast("long") + 9
    elif isinstance(t, T.ArrayType):
        size = F.aggregate(F.transform(c, lambda x: 8 + length(x, t.elementType)), F.lit(9).cast("long"), lambda a, x: a + x)
    elif isinstance(t, T.MapType):
        pair = lambda e: 8 + 1 + 8 + 8 + length(e["key"], t.keyType) + 8 + length(e["value"], t.valueType)
        size = F.aggregate(F.transform(F.map_entries(c), pair), F.lit(9).cast("long"), lambda a, x: a + x)
    elif isinstance(t, T.StructType):
        size = F.lit(9).cast("long")
        for f in t:
            size = size + 8 + length(c.getField(f.name), f.dataType)
    else:
        raise UnsupportedType(f"Unsupported type `{t.simpleString()}` for canonical fingerprinting")
    return F.when(c.isNull(), F.lit(1).cast("long")).otherwise(size)


def row_length(fields: list[T.StructField]) -> Column:
    """Bytes of a row's cells. A column of a type that has no canonical bytes can only hold nulls, of one byte each."""
    total = F.lit(HEAD * len(fields)).cast("long")
    for f in fields:
        total = total + (length(F.col(f"`{f.name}`"), f.dataType) if supported(f.dataType) else F.lit(1).cast("long"))
    return total


def _raw(a: pa.Array, width: int) -> np.ndarray:
    """(n, width) bytes of a flat array's values; what stands under nulls doesn't matter."""
    n = len(a)
    if pa.types.is_boolean(a.type):
        bits = np.unpackbits(np.frombuffer(a.buffers()[1], np.uint8), bitorder="little")
        return bits[a.offset:a.offset + n].reshape(n, 1)
    return np.frombuffer(a.buffers()[1], np.uint8)[a.offset * width:(a.offset + n) * width].reshape(n, width)


def _eights(n: np.ndarray) -> np.ndarray:
    """Whole numbers as eight little-endian bytes each."""
    return np.ascontiguousarray(n.astype("<u8")).view(np.uint8).reshape(len(n), 8)


def _place(out: np.ndarray, at: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> None:
    """Copy consecutive pieces of data, of the given sizes, to where they belong."""
    if not len(sizes):
        return
    if sizes[0] == sizes.min() == sizes.max():
        out[at[:, None] + np.arange(sizes[0])] = data.reshape(len(sizes), sizes[0])
        return
    ends = np.cumsum(sizes)
    if ends[-1] > 64 * len(sizes):
        for p, e, n in zip(at.tolist(), ends.tolist(), sizes.tolist(), strict=True):
            out[p:p + n] = data[e - n:e]
    else:
        out[np.arange(ends[-1]) + np.repeat(at - ends + sizes, sizes)] = data


def encoded(a: pa.Array, t: T.DataType) -> tuple[np.ndarray, np.ndarray]:
    """The canonical bytes of all values of an array, one after the other, and the size of each."""
    n = len(a)
    if isinstance(t, T.NullType) or not supported(t):
        return np.zeros(n, np.uint8), np.ones(n, np.int64)
    null = np.asarray(a.is_null()) if a.null_count else np.zeros(n, bool)
    full = ~null
    if fixed(t):
        tag, width = fixed(t)
        parts = [(np.full(n, width), _raw(a, width)[full].reshape(-1))] if n else []
        sizes = np.full(n, 1 + width, np.int64)
    elif isinstance(t, (T.StringType, T.BinaryType)):
        tag, lengths = (STRING if isinstance(t, T.StringType) else BINARY), pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
        off = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset:a.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(a.buffers()[2], np.uint8)[off[0]:off[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
        if len(raw) != lengths.sum():  # bytes under nulls
            raw = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(a.buffers()[2], np.uint8)[off[i]:off[i + 1]] for i in np.flatnonzero(full))])
        parts, sizes = [(np.full(n, 8), _eights(lengths[full]).reshape(-1)), (lengths, raw)], 9 + lengths
    else:
        if isinstance(t, T.StructType):
            tag, counts = STRUCT, np.full(n, len(t), np.int64)
            children = [encoded(x, f.dataType) for x, f in zip(a.flatten(), t, strict=True)]
        else:
            tag = LIST if isinstance(t, T.ArrayType) else MAP
            off = a.offsets.to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(1, np.int64)
            counts = np.where(null, 0, np.diff(off))
            inner = t.elementType if isinstance(t, T.ArrayType) else T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)])
            children = [encoded(_items(a), inner)]
        return _nested(tag, counts, null, children)
    sizes = np.where(null, 1, sizes)
    out, at = np.zeros(int(sizes.sum()), np.uint8), np.cumsum(sizes) - sizes
    at = at[full]
    out[at] = tag
    at = at + 1
    for width, data in parts:
        width = width[full]
        _place(out, at, data, width)
        at = at + width
    return out, sizes


def _items(a: pa.Array) -> pa.Array:
    """The elements of lists, or the entries of maps, that aren't null."""
    if not pa.types.is_map(a.type):
        return a.flatten()
    begin, end = a.offsets[0].as_py() if len(a) else 0, a.offsets[-1].as_py() if len(a) else 0
    return pa.StructArray.from_arrays([a.keys[begin:end] if len(a.keys) != end - begin else a.keys, a.items[begin:end] if len(a.items) != end - begin else a.items], ["key", "value"])


def _nested(tag: int, counts: np.ndarray, null: np.ndarray, children: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences: their tag, their number of items, and each item after its size. Several children take turns."""
    n, k = len(counts), len(children)
    if k == 1 and tag != STRUCT:
        owner, inner = np.repeat(np.arange(n), counts), [children[0]]
    else:
        owner, inner = None, children
    sizes = np.full(n, 9, np.int64)
    for _, s in inner:
        sizes += np.bincount(owner, s + 8, n).astype(np.int64) if owner is not None else s + 8
    sizes = np.where(null, 1, sizes)
    out, begin = np.zeros(int(sizes.sum()), np.uint8), np.cumsum(sizes) - sizes
    at = begin[~null]
    out[at] = tag
    out[at[:, None] + 1 + np.arange(8)] = _eights(counts[~null])
    if owner is not None:
        data, s = inner[0]
        ends = np.cumsum(s + 8)
        before = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
        at = begin[owner] + 9 + ends - s - 8 - before[owner]
        out[at[:, None] + np.arange(8)] = _eights(s)
        _place(out, at + 8, data, s)
        return out, sizes
    at = begin + 9
    for data, s in inner:
        keep = ~null
        if not keep.all():
            data, s = data[np.repeat(keep, s)], s[keep]
            at, keep = at[keep] if len(at) == n else at, None
        out[at[:, None] + np.arange(8)] = _eights(s)
        _place(out, at + 8, data, s)
        at = at + 8 + s
    return out, sizes


def encoded_rows(batch: pa.RecordBatch, types: list[T.DataType], numbers: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All cells of the batch, row by row, in one buffer; and where each row ends. numbers: of the columns."""
    n = batch.num_rows
    if not n or not types:
        return np.empty(0, np.uint8), np.zeros(n, np.int64)
    columns = [encoded(batch.column(j), t) for j, t in enumerate(types)]
    sizes = np.stack([s for _, s in columns], axis=1)
    ends = np.cumsum(sizes + HEAD, axis=None).reshape(n, len(types))
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for j, (data, size) in enumerate(columns):
        at = ends[:, j] - size - HEAD
        head = np.frombuffer(CELL + struct.pack("<Q", numbers[j] if numbers else j), np.uint8)
        out[at[:, None] + np.arange(len(head))] = head
        out[at[:, None] + len(head) + np.arange(8)] = _eights(size)
        _place(out, at + HEAD, data, size)
    return out, ends[:, -1]
