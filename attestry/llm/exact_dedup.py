"""Exact deduplication over disk-backed keyed state (operator 10, DataFrame functions only).

Rows are taken into a content store, where each has a place of its own: a whole number made of the number of its run,
its file and its row. Their digests stream into a keyed state held by RocksDB that never expires. For each digest the
state retains the number of rows, the identifier of the row that stays and the place of its content; with the same
folder, a later run goes on from the state and the store it has. Rows that hit a digest are then held against the content
at its place byte by byte: hits and that row fall into one group only if all their bytes are equal. Rows that differ
in spite of equal digests are regrouped by their whole text.

All aggregates are over numbers, so they are hash aggregates with partial results before their shuffle; rows whose
digest nobody shares are in no shuffle but the state's, of digests.

Defined results: a null text counts as empty; equal texts are those identical after lower-casing A-Z; of equal texts
the row with the largest doc_id stays, a null doc_id below all others, and of rows repeated with one doc_id exactly
one; texts are read whole, however long; an empty table gives an empty result; other columns are ignored whatever
their names (the stage keeps them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # one small file for each store and batch, instead of a copy of the store
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Places of a run: 2**23 files of 2**33 rows, for 128 runs over one state.
RUN = 56


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else changed; plain ASCII takes the faster function with the same result."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def taken_in(docs: DataFrame, at: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The content store with docs added: id, place, digest, row (a struct of docs' columns), of this and all runs before."""
    spark = docs.sparkSession
    run = 0
    while common.exists(spark, f"{at}/content/run={run}"):
        run += 1
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), (F.monotonically_increasing_id() + (run << RUN)).alias("place"), digest(normalised(F.col("text"))).alias("digest"), row.alias("row"))
    rows.write.parquet(f"{at}/content/run={run}")
    return spark.read.schema(rows.schema).parquet(f"{at}/content")


def _kept() -> list[Column]:
    """Of equal texts: the largest id and the place of one row that has it, and their number."""
    order = F.coalesce("id", F.lit(-(2**63)))
    return [F.max("id").alias("keep_id"), F.max_by("place", order).alias("keep_place"), F.count(F.lit(1)).alias("n")]


def run_state(content: DataFrame, at: str) -> DataFrame:
    """Stream what is new in the content store into the keyed state; return the state: digest, keep_id, keep_place, n."""
    spark = content.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(content.schema).parquet(f"{at}/content")
        state = stream.select("id", "place", "digest").groupBy("digest").agg(*_kept())
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stored = spark.read.format("statestore").load(f"{at}/state")
    keep_id, keep_place, _, n = stored.schema["value"].dataType.names  # the third is what max_by goes by
    return stored.select(F.col("key.digest").alias("digest"), F.col(f"value.{keep_id}").alias("keep_id"), F.col(f"value.{keep_place}").alias("keep_place"), F.col(f"value.{n}").alias("n"))


def decide(docs: DataFrame, digest: Callable[[Column], Column] = sha256, at: str | None = None) -> DataFrame:
    """doc_id, place, digest, keep_id, group_size, kept: one row for each row of docs, and of the runs before."""
    return decided(docs, digest, at)[0]


def decided(docs: DataFrame, digest: Callable[[Column], Column] = sha256, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The decisions on each row of the content store, and the store.

    digest: of the normalised text; tests pass one that collides. at: the folder of an earlier run to go on from.
    """
    at = at or common.new_path(docs.sparkSession, "exact")
    content = taken_in(docs, at, digest)
    rows = content.select("id", "place", "digest")
    n = rows.count()
    if not n:
        return rows.select(F.col("id").alias("doc_id"), "place", "digest", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept")), content
    shared = common.written(run_state(content, at).where("n > 1"), "shared", n)
    near, far = common.parts(content, "digest", shared)
    alone = far.select(F.col("id").alias("doc_id"), "place", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    # what a bitmap let through too much is alone, too
    found = near.select("id", "place", "digest").join(shared, "digest", "left")
    size, keep = F.coalesce("n", F.lit(1)), F.coalesce("keep_place", "place")
    made = found.select(F.col("id").alias("doc_id"), "place", "digest", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), size.alias("group_size"), (F.col("place") == keep).alias("kept"))
    made = common.written(made, "decided", n)
    texts = near.select("id", "place", "digest", normalised(F.col("row.text")).alias("text"))
    equal = texts.groupBy("digest", "text").agg(*_kept())
    bad = common.written(equal.select("digest", F.col("n").alias("m")).join(shared, "digest").where("m < n").select("digest").distinct(), "unequal", n)
    if not bad.isEmpty():
        own = texts.join(bad, "digest").join(common.written(equal.join(bad, "digest"), "regrouped"), ["digest", "text"])
        own = own.select(F.col("id").alias("doc_id"), "place", "digest", "keep_id", F.col("n").alias("group_size"), (F.col("place") == F.col("keep_place")).alias("kept"))
        made = common.written(made.join(bad, "digest", "left_anti").unionByName(own), "decided")
    return made.unionByName(alone), content


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the largest doc_id stays, with all its columns, read at its place.

    Only rows whose place may be that of a row that goes are read into a shuffle.
    """
    made, content = decided(docs)
    gone = made.where("NOT kept").select("place")
    near, far = common.parts(content.select("place", "row"), "place", gone)
    stays = common.gathered(near.join(gone, "place", "left_anti").select("row"), content.count())
    return far.select("row").unionByName(stays).select("row.*")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""
