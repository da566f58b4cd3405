"""Row-local rules of a contract over a stream: violations are kept, counts grow, batch by batch.

Uniqueness needs all rows and is left to batch validation; asking for it here is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.validate import findings, marked, predicates
from ..plans.contract import RULES, parse
from ..sources.order import ROW


def violations(stream: DataFrame, contract, row: str) -> DataFrame:
    """A stream of findings (row, column, rule, value) of rows numbered by `row`; it holds no state."""
    contract = parse(contract)
    if any(r.unique for r in contract.columns.values()):
        raise ValueError("unique can't be decided on a stream without end; validate it in batch")
    return findings(stream.withColumn(ROW, F.col(row).cast("long")), contract).select("row", "column", F.col("name").alias("rule"), "value")


def counts(stream: DataFrame, contract) -> DataFrame:
    """(column, rule, n): running counts of violations, one row of state for each rule."""
    contract = parse(contract)
    stream = marked(stream, contract)
    local = predicates(stream, contract)
    hit = F.filter(F.array(*[F.when(cond, F.struct(F.lit(c).alias("column"), F.lit(RULES[r]).alias("rule"))) for _, c, r, cond in local]), lambda x: x.isNotNull())
    return stream.select(F.explode(hit).alias("v")).select("v.*").groupBy("column", "rule").agg(F.count(F.lit(1)).alias("n"))


def write_violations(stream: DataFrame, contract, row: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append findings to Parquet files as data arrive, each once; stops when all that is there has been read."""
    return violations(stream, contract, row).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
