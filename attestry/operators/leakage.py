"""Overlap of a training and a test set, by key columns or by whole rows; examples are shown as hashes only."""

from __future__ import annotations

from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..errors import MissingColumn, SchemaMismatch
from ..functions.canonical import encoded_rows
from ..functions.identity import idkey, is_own_key

DOMAIN = b"attestry:leakage:v1\0"


def columns_of(train: DataFrame, test: DataFrame, keys: list[str]) -> list[str]:
    """The columns compared. They are matched by name; unequal types are refused."""
    if not keys:
        if train.columns != test.columns:
            raise SchemaMismatch("Schemas differ; full-row leakage detection requires identical columns")
        keys = train.columns
    for df in (train, test):
        for k in keys:
            if k not in df.columns:
                raise MissingColumn(f"Key column `{k}` is missing")
    for k in keys:
        if train.schema[k].dataType != test.schema[k].dataType:
            raise SchemaMismatch(f"Schemas differ; column `{k}` is {train.schema[k].dataType.simpleString()} and {test.schema[k].dataType.simpleString()}")
    return list(keys)


def _ids(df: DataFrame, columns: list[str], carried: list[str] = ()) -> DataFrame:
    return df.select(*[idkey(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"k{i}") for i, c in enumerate(columns)], *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(carried)])


def overlap(train: DataFrame, test: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The identities k0, k1, ... that both sides have; nulls are equal to each other."""
    columns = columns_of(train, test, list(keys))
    return _ids(train, columns).intersect(_ids(test, columns))


def _each(train: DataFrame, test: DataFrame, columns: list[str], carried: list[str] = ()) -> DataFrame:
    """Each identity k0, k1, ... once: a and b, its rows on either side, and v0, v1, ..., the carried columns of one of them.

    One aggregation over both sides, with partial results before the shuffle.
    """
    both = _ids(train, columns, carried).withColumn("side", F.lit(0)).unionByName(_ids(test, columns, carried).withColumn("side", F.lit(1)))
    values = [F.first(f"v{i}").alias(f"v{i}") for i in range(len(carried))]
    return both.groupBy(*[f"k{i}" for i in range(len(columns))]).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"), *values)


def summary(train: DataFrame, test: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row: train_rows, test_rows, overlap_count, train_overlap_rate, test_overlap_rate."""
    each = _each(train, test, columns_of(train, test, list(keys)))
    shared = (F.col("a") > 0) & (F.col("b") > 0)
    n = each.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("train_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("test_rows"), F.count_if(F.col("a") > 0).alias("da"), F.count_if(F.col("b") > 0).alias("db"), F.count_if(shared).alias("overlap_count"))
    rate = lambda d: F.when(F.col(d) > 0, F.col("overlap_count") / F.col(d)).otherwise(F.lit(0.0))
    return n.select("train_rows", "test_rows", "overlap_count", rate("da").alias("train_overlap_rate"), rate("db").alias("test_overlap_rate"))


def samples(train: DataFrame, test: DataFrame, keys: list[str], most: int) -> list[str]:
    """Hashes of the first shared identities, in order of the hash. Each is hashed once, however many rows it has, on the executors."""
    columns = columns_of(train, test, keys)
    ship(train.sparkSession)
    fields = [train.schema[c] for c in columns]
    places = [train.columns.index(c) for c in columns]
    carried = [f.name for f in fields if not is_own_key(f.dataType)]  # idkeys lose the bits of their values
    rows = _each(train, test, columns, carried).where("a > 0 AND b > 0").select(*[f"v{carried.index(c)}" if c in carried else f"k{i}" for i, c in enumerate(columns)])

    def run(batches):
        from ..functions.blake3 import digests

        first: list[bytes] = []
        for batch in batches:
            first = nsmallest(most, {*first, *digests(DOMAIN, *encoded_rows(batch, [f.dataType for f in fields], places))})
        yield pa.record_batch({"id": pa.array([x.hex() for x in first], pa.string())})

    return [r["id"] for r in rows.mapInArrow(run, "id string").distinct().orderBy("id").limit(most).collect()]


def detect(train: DataFrame, test: DataFrame, keys=None, max_samples: int = 20) -> dict:
    if max_samples < 0:
        raise ValueError(f"max_samples is {max_samples}; no fewer than 0 can be shown")
    keys = [] if keys is None else [keys] if isinstance(keys, str) else list(keys)
    n = summary(train, test, keys).first()
    shown = samples(train, test, keys, max_samples) if n["overlap_count"] and max_samples else []
    return {"detected": n["overlap_count"] > 0, "mode": "key" if keys else "full_row", "keys": keys, **n.asDict(), "sample_fingerprints": shown, "truncated": n["overlap_count"] > len(shown)}
