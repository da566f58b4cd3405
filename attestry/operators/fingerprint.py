"""The ordered content fingerprint of a dataset, hashed where the data lie.

The hash is a tree over 1 KiB chunks of the encoded rows. The length of a row's encoding is a sum of arithmetic
expressions, so the place in the stream of every small block of consecutive rows is known before anything is encoded.
Neighbouring blocks of about GROUP bytes go to one task, which gives the chaining values of the whole subtrees that lie
in them and their ragged ends; tasks join these for regions of the stream, and the driver a few dozen values of each
region. How the data are partitioned makes no difference. Columns of types without canonical bytes may hold nulls only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship, written
from ..errors import UnsupportedType
from ..functions.blake3 import CHUNK, Tree, chunk_values, parents, subtrees
from ..functions.canonical import encoded_rows, header, row_length, supported
from ..sources.order import ROW, with_row
from .profile import type_name

#: Rows of a small block; encoded bytes that go to a task together (about), that are hashed at once, and of a region (as a power of 2).
BLOCK, GROUP, PIECE, REGION = 1 << 7, 8 << 20, 8 << 20, 35
#: Bytes of Arrow data that are encoded at once, about.
SLICE = 1 << 20


def fingerprint(df: DataFrame, row=None, block: int = BLOCK, group: int = GROUP, region: int = REGION) -> str:
    fields = list(df.schema)
    bad = [f for f in fields if not supported(f.dataType)]
    if bad:
        filled = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"n{i}") for i, f in enumerate(bad)]).first()
        for f, n in zip(bad, filled, strict=True):
            if n:
                raise UnsupportedType(f"Unsupported type `{f.dataType.simpleString()}` for canonical fingerprinting")
    head = header([(f.name, type_name(f.dataType), f.nullable) for f in fields])
    tree, rest = Tree(), head
    if fields:
        ship(df.sparkSession)
        # nulls of a plain type have the same bytes
        flat = [T.StructField(f"__c{i}", T.BooleanType() if f in bad else f.dataType) for i, f in enumerate(fields)]
        cells = [(F.lit(None).cast("boolean") if f in bad else F.col(f"`{f.name}`")).alias(g.name) for f, g in zip(fields, flat, strict=True)]
        numbered = with_row(df, row).select(*cells, F.floor(F.col(ROW) / block).alias("__block"), ROW)
        begins = _begins(numbered.groupBy("__block").agg(F.sum(row_length(flat)).alias("__size")), len(head), group)
        parts = numbered.join(begins, "__block").groupBy("__far", "__near").applyInArrow(_hashed([g.dataType for g in flat], [g.name for g in flat]), PARTS)
        parts = parts.withColumn("region", F.shiftright("at", region)).groupBy("region").applyInArrow(_gathered, PARTS)
        for r in parts.orderBy("at").toLocalIterator(prefetchPartitions=True):
            tree, rest = _joined(tree, rest, r["level"], bytes(r["value"]))
    while len(rest) > CHUNK:
        tree.add(0, chunk_values(rest[:CHUNK], tree.chunks)[0])
        rest = rest[CHUNK:]
    return "pf-fp-v1:" + tree.finish(rest).hex()


#: A part of the stream: its place, and a subtree's level and value, or -1 and bytes.
PARTS = "at long, level int, value binary"


def _begins(sizes: DataFrame, head: int, group: int) -> DataFrame:
    """Each small block's place in the stream, and whom it goes with: runs of blocks, cut where another `group` bytes are full."""
    sizes = written(sizes.withColumn("__far", F.shiftright("__block", 13)), "sizes")
    far = sizes.groupBy("__far").agg(F.sum("__size").alias("__all"))
    far = far.select("__far", (F.sum("__all").over(Window.orderBy("__far")) - F.col("__all") + head).alias("__begin"))  # a row for a million
    within = F.sum("__size").over(Window.partitionBy("__far").orderBy("__block")) - F.col("__size")
    return sizes.withColumn("__within", within).join(far, "__far").select("__block", "__far", F.floor(F.col("__within") / group).alias("__near"), (F.col("__begin") + F.col("__within")).alias("__begin"))


def _joined(tree: Tree, rest: bytes, level: int, value: bytes) -> tuple[Tree, bytes]:
    """level -1: bytes that follow; else the chaining value of the next aligned subtree."""
    if level < 0:
        rest += value
    if level >= 0 or len(rest) > CHUNK:
        # a whole chunk may only be closed once something is known to follow it
        keep = 0 if level >= 0 else 1
        while len(rest) >= CHUNK + keep:
            tree.add(0, chunk_values(rest[:CHUNK], tree.chunks)[0])
            rest = rest[CHUNK:]
        if level >= 0:
            tree.add(level, value)
    return tree, rest


def _hashed(types: list[T.DataType], names: list[str]):
    """For neighbouring blocks: their head up to a chunk's border, whole subtrees, and their tail, which is never empty."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ROW)
        at = table.column("__begin")[0].as_py()
        out: list[tuple[int, int, bytes]] = []
        left = np.zeros(0, np.uint8)  # what is left over, from `at` on
        table = table.select(names)
        step = max(1, SLICE * table.num_rows // max(1, table.nbytes))
        for i in range(0, table.num_rows, step):
            for batch in table.slice(i, step).combine_chunks().to_batches():
                left = np.concatenate([left, encoded_rows(batch, types)[0]])
                while len(left) > PIECE + CHUNK:
                    at, left = _emit(out, at, left, PIECE)
        at, left = _emit(out, at, left, len(left))
        out.append((at, -1, left.tobytes()))
        return _table(out)

    return run


def _table(parts: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"at": pa.array([x[0] for x in parts], pa.int64()), "level": pa.array([x[1] for x in parts], pa.int32()), "value": pa.array([x[2] for x in parts], pa.binary())})


def _gathered(table: pa.Table) -> pa.Table:
    """Join what lies side by side: bytes to chunks, subtrees to larger ones. The last bytes stay bytes."""
    parts = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "level", "value")), strict=True), key=lambda x: x[0])
    out: list[tuple[int, int, bytes]] = []

    def add(level: int, chunk: int, value: np.ndarray) -> None:
        while out and out[-1][1] == level and not chunk >> level == out[-1][0] // CHUNK >> level and chunk >> level & 1 and out[-1][0] == (chunk - (1 << level)) * CHUNK:
            begin, _, left = out.pop()
            value, chunk, level = parents(np.frombuffer(left, np.uint32)[None], value[None])[0], begin // CHUNK, level + 1
        out.append((chunk * CHUNK, level, value.tobytes()))

    begin, rest = 0, b""
    for at, level, value in parts:
        if level < 0:
            begin, rest = (begin, rest + value) if rest else (at, value)
        if begin % CHUNK and rest:  # the stream's head comes before
            n = CHUNK - begin % CHUNK
            if len(rest) > n or level >= 0:
                out.append((begin, -1, rest[:n]))
                begin, rest = begin + n, rest[n:]
        while begin % CHUNK == 0 and len(rest) > (CHUNK if level < 0 else CHUNK - 1):
            add(0, begin // CHUNK, chunk_values(rest[:CHUNK], begin // CHUNK)[0])
            begin, rest = begin + CHUNK, rest[CHUNK:]
        if level >= 0:
            add(level, at // CHUNK, np.frombuffer(value, np.uint32))
    if rest:
        out.append((begin, -1, rest))
    return _table(out)


def _emit(out: list, at: int, data: np.ndarray, most: int) -> tuple[int, np.ndarray]:
    """Hash whole chunks of the first `most` bytes, but never the last byte of them."""
    head = min(-at % CHUNK, len(data))
    if head:
        out.append((at, -1, data[:head].tobytes()))
        at, data = at + head, data[head:]
    n = max(0, (min(most, len(data)) - 1) // CHUNK)
    if n:
        for level, chunk, cv in subtrees(chunk_values(np.ascontiguousarray(data[:n * CHUNK]), at // CHUNK), at // CHUNK):
            out.append((chunk * CHUNK, level, cv))
        at, data = at + n * CHUNK, data[n * CHUNK:]
    return at, data


def fingerprint_table(df: DataFrame, row=None) -> DataFrame:
    return df.sparkSession.createDataFrame([(fingerprint(df, row),)], "fingerprint string")
