"""Scan of every cell for personal data. What was found is never shown, only a fingerprint of it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship
from ..functions.identity import FLOATS, INTEGERS, render
from ..functions.pii import KINDS, classified
from ..sources.order import ROW, with_row

DOMAIN = b"attestry:privacy:v1\0"
#: Types whose text can't be of any class: a point, letters or brackets are always in it.
NEVER = (T.BooleanType, *FLOATS, T.TimestampType, T.TimestampNTZType, T.ArrayType, T.MapType, T.StructType, T.NullType)


def scanned(df: DataFrame) -> list[tuple[int, T.StructField]]:
    return [(i, f) for i, f in enumerate(df.schema) if not isinstance(f.dataType, NEVER)]


def found_in(df: DataFrame) -> Column:
    """A row's cells that are personal data: an array of col, column, kind, confidence and text."""
    found = []
    for i, f in scanned(df):
        text = render(F.col(f"`{f.name}`"), f.dataType)
        hit = classified(text, F.lit(isinstance(f.dataType, INTEGERS)))
        found.append(F.when(hit.isNotNull(), F.struct(F.lit(i).alias("col"), F.lit(f.name).alias("column"), hit.getField("kind").alias("kind"), hit.getField("confidence").alias("confidence"), text.alias("text"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<col:int,column:string,kind:string,confidence:string,text:string>>")


def cells(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """kind, confidence, column, col (and `extra` columns, and the cell's text) of each cell that is personal data."""
    return df.select(*extra, F.explode(found_in(df)).alias("c")).select(*extra, "c.*")


def counts_by_kind(df: DataFrame) -> DataFrame:
    return cells(df).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def privacy_fingerprints(texts: list[str]) -> list[str]:
    from ..functions.blake3 import blake3

    return [blake3(DOMAIN + t.encode()).hex()[:16] for t in texts]


def scan(df: DataFrame, max_findings: int = 100, row=None) -> dict:
    """The report; one pass counts rows and kinds, another seeks the first findings, if there are any."""
    if max_findings < 0:
        raise ValueError(f"max_findings is {max_findings}; no fewer than 0 can be kept")
    of = lambda kind: lambda cell: cell.getField("kind") == kind
    rows = df.select(found_in(df).alias("found"))
    seen = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(F.size(F.filter("found", of(k)))), F.lit(0)).alias(k) for k in KINDS]).first()
    kinds = {k: seen[k] for k in sorted(KINDS) if seen[k]}
    total, kept = sum(kinds.values()), []
    if total and max_findings:
        ship(df.sparkSession)
        # the few rows kept are hashed where they lie: no raw value comes to the driver
        hashed = F.pandas_udf(lambda s: pd.Series(privacy_fingerprints(list(s))), "string")
        top = cells(with_row(df, row), [ROW]).orderBy(ROW, "col").limit(max_findings)
        rows = top.withColumn("value_fingerprint", hashed("text")).drop("text").orderBy(ROW, "col").collect()
        kept = [{"kind": r["kind"], "confidence": r["confidence"], "column": r["column"], "row": r[ROW], "value_fingerprint": r["value_fingerprint"]} for r in rows]
    return {"detected": total > 0, "scanned_rows": seen["rows"], "finding_count": total, "counts_by_kind": kinds, "truncated": total > len(kept), "findings": kept}


def tokens(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Each word of a text column as a cell of its own: `keep`, position, token, kind, confidence."""
    words = df.select(*keep, F.posexplode(F.split(F.col(column), r"\s+")).alias("position", "token"))
    hit = classified(F.col("token"), F.lit(False))
    # cheap test first: every class holds a digit or an at sign
    words = words.where(F.col("token").rlike("[0-9@]"))
    return words.withColumn("hit", hit).where("hit IS NOT NULL").select(*keep, "position", "token", "hit.kind", "hit.confidence")


