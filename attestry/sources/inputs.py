"""Anything tabular as a Spark DataFrame."""

from __future__ import annotations

from pathlib import PurePosixPath
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a CSV file that mean null.
CSV_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null")


def as_dataframe(spark: SparkSession, data: Any) -> DataFrame:
    """A DataFrame as it is; Arrow tables, batches and readers; pandas (without index); what has ``to_arrow`` or an
    Arrow C stream; a path that ends in .parquet or .csv. Anything else is a TypeError."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, (str, PurePosixPath)) or hasattr(data, "__fspath__"):
        return read(spark, str(data))
    table = _table(data)
    if table is None:
        raise TypeError(f"Expected a DataFrame, Arrow or pandas data, or a path; got {type(data).__module__}.{type(data).__name__}")
    return spark.createDataFrame(_narrowed(table))


def _table(data: Any) -> pa.Table | None:
    if isinstance(data, pa.RecordBatchReader):
        return data.read_all()
    if isinstance(data, pa.Table):
        return data
    if isinstance(data, pa.RecordBatch):
        return pa.Table.from_batches([data])
    if callable(getattr(data, "to_arrow", None)):
        return _table(data.to_arrow())
    if type(data).__module__.partition(".")[0] == "pandas":
        return pa.Table.from_pandas(data, preserve_index=False)
    if hasattr(data, "__arrow_c_stream__"):
        return pa.RecordBatchReader.from_stream(data).read_all()
    return None


def _narrowed(table: pa.Table) -> pa.Table:
    """Spark has no unsigned integers: they take the next wider type, the widest a decimal."""
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}
    for i, f in enumerate(table.schema):
        if f.type in wider:
            table = table.set_column(i, pa.field(f.name, wider[f.type], f.nullable), table.column(i).cast(wider[f.type]))
    return table


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV file or folder, by its suffix."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        return read_csv(spark, path)
    raise ValueError(f"Unsupported input: {path}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header; types are inferred after the null tokens are set aside. A quoted empty string is null too."""
    raw = spark.read.csv(path, header=True, inferSchema=False, nullValue="", multiLine=False)
    clean = raw.select([F.when(~F.col(f"`{c}`").isin(*CSV_NULLS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if not raw.columns:
        return clean
    kinds = {"long": r"^[+-]?[0-9]+\z", "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z|^[+-]?(inf|Inf|infinity|Infinity)\z", "boolean": r"(?i)^(true|false)\z", "date": r"^\d{4}-\d{2}-\d{2}\z", "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?\z"}
    # one pass over the file: for each column and kind whether all cells fit
    checks = [F.coalesce(F.every(F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`").rlike(p) & F.col(f"`{c}`").try_cast(k).isNotNull())), F.lit(False)).alias(f"{i}:{k}") for i, c in enumerate(raw.columns) for k, p in kinds.items()]
    fits = clean.agg(*checks).first().asDict()
    out = []
    for i, c in enumerate(raw.columns):
        kind = next((k for k in ("long", "double", "boolean", "date", "timestamp_ntz") if fits[f"{i}:{k}"]), None)
        out.append(F.col(f"`{c}`").cast(kind).alias(c) if kind else F.col(f"`{c}`"))
    return clean.select(out)
