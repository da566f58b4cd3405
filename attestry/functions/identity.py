"""When two values are the same value, and how they are shown.

Spark holds 0.0 and -0.0, and all NaNs, for equal when it groups and joins; here values are the same only if their
bits are. ``idkey`` gives an expression that Spark groups and joins by bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
TIMES = (T.TimestampType, T.TimestampNTZType)


def has_float(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return has_float(t.elementType)
    if isinstance(t, T.StructType):
        return any(has_float(f.dataType) for f in t)
    if isinstance(t, T.MapType):
        return has_float(t.keyType) or has_float(t.valueType)
    return isinstance(t, FLOATS)


def is_own_key(t: T.DataType) -> bool:
    """Whether a value of this type is its own idkey."""
    return not has_float(t) and not _has_map(t)


def idkey(c: Column, t: T.DataType) -> Column:
    """Equal, in groups and joins, exactly for the same values; null for null."""
    if isinstance(t, FLOATS):
        raw = "java.lang.Double", "doubleToRawLongBits"
        if isinstance(t, T.FloatType):
            raw = "java.lang.Float", "floatToRawIntBits"
        odd = F.when(F.isnan(c), F.java_method(F.lit(raw[0]), F.lit(raw[1]), c)).when(c == 0, c.cast("string"))
        return F.when(c.isNotNull(), F.struct(c.alias("value"), odd.alias("bits")))
    if isinstance(t, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", t.keyType, False), T.StructField("value", t.valueType)]))
        return idkey(F.map_entries(c), entries)
    if is_own_key(t):
        return c
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: idkey(x, t.elementType))
    parts = [idkey(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(t)]
    return F.when(c.isNotNull(), F.struct(*parts))


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t)
    return isinstance(t, T.MapType)


def ticks(c: Column, t: T.DataType) -> Column:
    """Microseconds since the epoch, whatever the session's time zone."""
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.unix_micros(c)


def number(c: Column, t: T.DataType) -> Column | None:
    """The value as a double, for ranges; None for types that have no range: dates, decimals, booleans, strings."""
    if isinstance(t, INTEGERS + FLOATS):
        return c.cast("double")
    if isinstance(t, TIMES):
        return ticks(c, t).cast("double")
    return None


def render(c: Column, t: T.DataType) -> Column:
    """The text that patterns, lists and scans of personal data see."""
    if isinstance(t, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(t, TIMES):
        return _time(c, t)
    if isinstance(t, FLOATS):
        return _float(c)
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def render_id(k: Column, t: T.DataType) -> Column:
    """The text of a value, given its idkey."""
    return render(value_of(k, t), t) if not isinstance(t, FLOATS) else F.when(k.getField("value") == 0, F.when(k.getField("bits").startswith("-"), "-0.0").otherwise("0.0")).otherwise(render(k.getField("value"), t))


def value_of(k: Column, t: T.DataType) -> Column:
    """The value that an idkey was made of; in it, zeros and NaNs may have lost their bits."""
    if isinstance(t, FLOATS):
        return k.getField("value")
    if isinstance(t, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", t.keyType, False), T.StructField("value", t.valueType)]))
        return F.map_from_entries(value_of(k, entries))
    if is_own_key(t):
        return k
    if isinstance(t, T.ArrayType):
        return F.transform(k, lambda x: value_of(x, t.elementType))
    return F.when(k.isNotNull(), F.struct(*[value_of(k.getField(f"f{i}"), f.dataType).alias(f.name) for i, f in enumerate(t)]))


def _time(c: Column, t: T.DataType) -> Column:
    text = F.regexp_replace(c.cast("string"), " ", "T")
    return F.concat(text, F.lit("Z")) if isinstance(t, T.TimestampType) else text


def _float(c: Column) -> Column:
    """Whole numbers with .0 and without an exponent up to 1e16, as plain decimals elsewhere."""
    whole = (F.abs(c) < 1e16) & (c == F.floor(c.cast("double")).cast("double")) & (F.abs(c) >= 1e7)
    return F.when(whole, F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(F.regexp_replace(c.cast("string"), r"E(-?\d+)$", "e$1"))
