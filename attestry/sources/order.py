"""Row numbers: a DataFrame has no order of its own, so evidence about rows needs one.

In order of preference: a column of the caller's that holds the numbers; for a bare scan of files, or columns of one,
the place in the files (files by name, Parquet rows by their index, filtered rows and those of other files by the
blocks that tasks read: no sort, no shuffle); for data that lie in memory, the place in their partitions. Anything else
(sorts, limits, unions, joins) is written once in the order that it has, and numbered by that, so that all passes speak
of the same rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import shared_dir, written

ROW = "__row"
#: Logical plans that leave rows where they are, and such as read data that lie still.
NARROW, FILES, STILL = {"Project", "SubqueryAlias", "View", "Filter"}, {"LogicalRelation"}, {"LocalRelation", "LogicalRDD", "Range", "OneRowRelation"}


def with_row(df: DataFrame, row: str | Column | None = None) -> DataFrame:
    """df with a column ROW: 0, 1, 2, ... in the order of the DataFrame given."""
    if row is not None:
        return df.withColumn(ROW, (F.col(row) if isinstance(row, str) else row).cast("long"))
    source, whole = _source(df)
    if source in FILES and df.inputFiles():
        try:
            if whole:
                return _by_file(df)
        except AnalysisException:
            pass  # not Parquet
        try:
            return _by_block(df)
        except AnalysisException:
            pass  # not of files
    placed = df.withColumn("__id", F.monotonically_increasing_id())
    return _by_partition(placed if source in STILL else _stilled(placed))


def _stilled(placed: DataFrame) -> DataFrame:
    try:
        return written(placed, "ordered")
    except AnalysisException:  # a type that Parquet doesn't hold
        placed.sparkSession.sparkContext.setCheckpointDir(shared_dir(placed.sparkSession))
        return placed.checkpoint()


def _source(df: DataFrame) -> tuple[str, bool]:
    """The kind of plan that df's rows come from as they lie ('' if they don't), and whether all of its rows are there."""
    plan, whole = df._jdf.queryExecution().analyzed(), True
    while (name := plan.getClass().getSimpleName()) in NARROW and plan.deterministic():
        plan, whole = plan.children().apply(0), whole and name != "Filter"
    return (name if name in FILES | STILL else ""), whole


def _by_file(df: DataFrame) -> DataFrame:
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    # one row for each file; the count comes from one narrow column
    sizes = placed.groupBy("__file").agg((F.max("__index") + 1).alias("__n"))
    if sizes.count() <= 1:
        return placed.withColumn(ROW, F.col("__index")).drop("__file", "__index")
    begins = sizes.select("__file", (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")).alias("__begin"))
    return placed.join(begins, "__file").withColumn(ROW, F.col("__begin") + F.col("__index")).drop("__file", "__index", "__begin")


def _by_block(df: DataFrame) -> DataFrame:
    """By files' names, their blocks, and the place in a block, which a task reads without a break."""
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    sizes = placed.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    begins = sizes.select("__file", "__block", (F.sum("__n").over(Window.orderBy("__file", "__block")) - F.col("__n") - F.col("__first")).alias("__begin"))
    return placed.join(begins, ["__file", "__block"]).withColumn(ROW, F.col("__begin") + F.col("__id")).drop("__file", "__block", "__id", "__begin")


def _by_partition(placed: DataFrame) -> DataFrame:
    """By the partitions that gave __id its upper bits, and the place in them."""
    part = F.shiftrightunsigned("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    begins = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__begin"))
    placed = placed.withColumn("__part", part).join(begins, "__part")
    return placed.withColumn(ROW, F.col("__begin") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__begin")
