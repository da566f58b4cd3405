"""Row, null, distinct and range statistics of every column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import idkey, number

DISTINCT = ("exact", "none")


def type_name(t: T.DataType) -> str:
    """The columnar type's name, as profiles and fingerprints state it (version 1 of our own table)."""
    names = {T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float32", T.DoubleType: "Float64", T.StringType: "Utf8", T.BooleanType: "Boolean", T.DateType: "Date32", T.BinaryType: "Binary", T.TimestampNTZType: "Timestamp(Microsecond, None)", T.TimestampType: 'Timestamp(Microsecond, Some("UTC"))', T.NullType: "Null"}
    if isinstance(t, T.DecimalType):
        return f"Decimal128({t.precision}, {t.scale})"
    if isinstance(t, T.ArrayType):
        return f"List({type_name(t.elementType)})"
    if isinstance(t, T.MapType):
        return f"Map({type_name(t.keyType)}, {type_name(t.valueType)})"
    if isinstance(t, T.StructType):
        return f"Struct({', '.join(f'{f.name}: {type_name(f.dataType)}' for f in t)})"
    return next((n for k, n in names.items() if isinstance(t, k)), t.simpleString())


def statistics(df: DataFrame) -> DataFrame:
    """One row: rows, and for each column i n_i (non-null), lo_i and hi_i. One pass, partly aggregated before its shuffle."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"n_{i}"))
        x = number(c, f.dataType)
        if x is not None:
            x = F.nanvl(x, F.lit(None).cast("double")) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else x
            aggs += [F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}")]
    return df.agg(*aggs)


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, distinct_count): exact, nulls left out. Each column is scanned and shuffled for itself, so a wide table
    is read once in all and no row is multiplied."""
    wanted = [(i, f) for i, f in enumerate(df.schema) if columns is None or f.name in columns]
    each = [df.select(idkey(F.col(f"`{f.name}`"), f.dataType).alias("k")).agg(F.count_distinct("k").alias("distinct_count")).select(F.lit(i).alias("i"), F.lit(f.name).alias("column"), "distinct_count") for i, f in wanted]
    return reduce(DataFrame.unionByName, each)


def _known(distinct: str) -> None:
    if distinct not in DISTINCT:
        raise ValueError(f"distinct is one of {', '.join(DISTINCT)}, not {distinct!r}")


def profile_table(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """name, data_type, null_count, non_null_count, distinct_count, min, max: a row for each column."""
    _known(distinct)
    parts = []
    for i, f in enumerate(df.schema):
        ranged = number(F.col(f"`{f.name}`"), f.dataType) is not None
        lo, hi = (F.col(f"lo_{i}"), F.col(f"hi_{i}")) if ranged else (F.lit(None).cast("double"),) * 2
        parts.append(F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("name"), F.lit(type_name(f.dataType)).alias("data_type"), (F.col("rows") - F.col(f"n_{i}")).alias("null_count"), F.col(f"n_{i}").alias("non_null_count"), lo.alias("min"), hi.alias("max")))
    if not parts:
        return df.sparkSession.createDataFrame([], "name string, data_type string, null_count long, non_null_count long, distinct_count long, min double, max double")
    rows = statistics(df).select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    if distinct == "none":
        rows = rows.withColumn("distinct_count", F.lit(None).cast("long"))
    else:
        rows = rows.join(distinct_counts(df).select("i", "distinct_count"), "i")
    return rows.select("name", "data_type", "null_count", "non_null_count", "distinct_count", "min", "max")


def profile(df: DataFrame, distinct: str = "exact", row=None, fingerprint: bool = True) -> dict:
    """The report: rows, columns, fingerprint. Ranges that aren't finite are None."""
    from .fingerprint import fingerprint as digest

    _known(distinct)
    if not df.columns:
        return {"rows": df.count(), "columns": [], "fingerprint": digest(df, row) if fingerprint else None}
    stats = statistics(df).first().asDict()
    counts = {r["i"]: r["distinct_count"] for r in distinct_counts(df).collect()} if distinct == "exact" else {}
    columns = []
    for i, f in enumerate(df.schema):
        n = stats[f"n_{i}"]
        finite = lambda x: x if x is not None and abs(x) != float("inf") else None
        columns.append({"name": f.name, "data_type": type_name(f.dataType), "null_count": stats["rows"] - n, "non_null_count": n, "distinct_count": counts.get(i), "min": finite(stats.get(f"lo_{i}")), "max": finite(stats.get(f"hi_{i}"))})
    return {"rows": stats["rows"], "columns": columns, "fingerprint": digest(df, row) if fingerprint else None}
