"""What the operators share: tables, bounded key filters, the place of vocabulary files."""

from __future__ import annotations

import ctypes
import gc
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import gathered, new_path, remove_shared, shared_dir, ship, written

__all__ = ["exists", "flagged", "gathered", "key_bitmap", "maybe_in", "new_path", "partitions", "parts", "prepare", "release", "remove_shared", "restore", "shared_dir", "ship", "table", "tokenizer_path", "written"]

#: Positions of a key bitmap: 2 MB in all, whatever the input's size.
BITMAP_BITS = 24
#: Bytes of rows that go to Python at a time, and the setting that says so.
BATCH, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_before: dict[str, str | None] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Before a job with Python in it: ship the code, and let fewer bytes at a time go to Python, as texts are long.

    The setting is read when a result is computed, so it holds until ``restore``; results don't depend on it.
    """
    ship(spark)
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING))
    if now > BATCH:
        _before.setdefault(spark.sparkContext.applicationId, spark.conf.get(BATCH_SETTING))
        spark.conf.set(BATCH_SETTING, str(BATCH))


def restore(spark: SparkSession) -> None:
    """Give the session its setting back; operators whose results are computed do so, others' callers may."""
    before = _before.pop(spark.sparkContext.applicationId, None)
    if before is not None:
        spark.conf.set(BATCH_SETTING, before)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def release() -> None:
    """Give back what a Python worker no longer needs: it lives on after its task, and has other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own counsel


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _position(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))


def key_bitmap(keys: DataFrame, key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """(bucket, bits): a bitmap of hashed keys in rows of 4 KB, at most 2**bits / 8 bytes in all whatever the number of keys."""
    at = _position(F.col(key), bits)
    return (
        keys.select(F.shiftright(at, 15).alias("_bucket"), at.bitwiseAND(F.lit(32767)).cast("int").alias("_bit"))
        .groupBy("_bucket")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )


def flagged(df: DataFrame, key: str, bitmap: DataFrame, flag: str, bits: int = BITMAP_BITS) -> DataFrame:
    """df with a boolean: false only if the key surely isn't in the bitmap. No key in it is lost; a later join decides.

    The bitmap is broadcast: its size is bounded by ``bits``, not by the data.
    """
    at = _position(F.col(key), bits)
    low = at.bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(low, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumn("_bucket", F.shiftright(at, 15))
        .join(F.broadcast(bitmap), "_bucket", "left")
        .withColumn(flag, F.coalesce((byte.bitwiseAND(F.expr(f"shiftleft(1, cast(xxhash64(`{key}`) & 7 as int))")) != 0), F.lit(False)))
        .drop("_bucket", "_bits")
    )


def maybe_in(df: DataFrame, key: str, bitmap: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows whose key may be in the bitmap."""
    return flagged(df, key, bitmap, "_maybe", bits).where("_maybe").drop("_maybe")


def parts(df: DataFrame, key: str, keys: DataFrame, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among keys' column of that name, the others). Rows of the second part need no shuffle."""
    both = flagged(df, key, written(key_bitmap(keys, key, bits), "bitmap", 1 << max(0, bits - 15)), "_maybe", bits)
    return both.where("_maybe").drop("_maybe"), both.where("NOT _maybe").drop("_maybe")


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file; ATTESTRY_TOKENIZERS names another folder than the installed one."""
    folder = os.environ.get("ATTESTRY_TOKENIZERS")
    if folder:
        return str(Path(folder, name))
    import public_tokenizers

    return public_tokenizers.path(name)
