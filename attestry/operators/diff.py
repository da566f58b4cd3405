"""Keyed difference of two datasets: a full outer join on the keys' identity, nulls equal to each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateKey, MissingColumn, NoKeyColumns, SchemaMismatch
from ..functions.identity import idkey, render, render_id

SEPARATOR, NULL = "\u001f", "<null>"


@dataclass
class Diff:
    """added and removed: column key. changed: key, columns. All as DataFrames of any size."""

    before: DataFrame
    after: DataFrame
    keys: list[str]
    joined: DataFrame

    @property
    def added(self) -> DataFrame:
        return self.joined.where("kind = 'added'").select("key")

    @property
    def removed(self) -> DataFrame:
        return self.joined.where("kind = 'removed'").select("key")

    @property
    def changed(self) -> DataFrame:
        return self.joined.where("kind = 'changed'").select("key", "columns")

    def counts(self) -> DataFrame:
        """One row: added_count, removed_count, changed_count, before_rows, after_rows."""
        return self.joined.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("added", "removed", "changed")], F.count_if(F.col("kind") != "added").alias("before_rows"), F.count_if(F.col("kind") != "removed").alias("after_rows"))

    def report(self) -> dict:
        """Counts and ordered lists; the lists come to the driver, so this is for differences that fit there."""
        by: dict[str, list] = {"added": [], "removed": [], "changed": []}
        for r in self.joined.where("kind <> 'same'").orderBy("key").collect():
            by[r["kind"]].append({"key": r["key"], "columns": list(r["columns"])} if r["kind"] == "changed" else r["key"])
        counts = {"before_rows": self.before.count(), "after_rows": self.after.count()} | {f"{kind}_count": len(x) for kind, x in by.items()}
        return {"keys": self.keys, **counts, "added_keys": by["added"], "removed_keys": by["removed"], "changed": by["changed"]}


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, n) of keys that several rows have."""
    types, names = [df.schema[k].dataType for k in keys], [f"k{i}" for i in range(len(keys))]
    ids = df.select(*[idkey(F.col(f"`{k}`"), t).alias(n) for k, t, n in zip(keys, types, names, strict=True)])
    twice = ids.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # keys are shown after they have been counted, so that the buffers hold numbers only
    return twice.select(_shown([render_id(F.col(n), t) for n, t in zip(names, types, strict=True)]).alias("key"), "n")


def display(df: DataFrame, keys: list[str], side: str = "") -> Column:
    pre = f"{side}." if side else ""
    return _shown([render(F.col(f"{pre}`{k}`"), df.schema[k].dataType) for k in keys])


def _shown(texts: list[Column]) -> Column:
    return F.concat_ws(SEPARATOR, *[F.coalesce(t, F.lit(NULL)) for t in texts])


def checked_keys(before: DataFrame, after: DataFrame, keys) -> list[str]:
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        raise NoKeyColumns("At least one key column is required")
    for df in (before, after):
        for k in keys:
            if k not in df.columns:
                raise MissingColumn(f"Key column `{k}` is missing")
    if [(f.name, f.dataType, f.nullable) for f in before.schema] != [(f.name, f.dataType, f.nullable) for f in after.schema]:
        raise SchemaMismatch("Schemas differ; normalize columns before row-level diff")
    return keys


def diff(before: DataFrame, after: DataFrame, keys, check: bool = True) -> Diff:
    """The difference; with `check`, a key that isn't unique on its side is refused first."""
    keys = checked_keys(before, after, keys)
    if check:
        for df in (before, after):
            twice = duplicate_keys(df, keys).first()
            if twice:
                raise DuplicateKey(f"Duplicate key `{twice['key']}`; diff keys must be unique")
    ids = lambda df, side: df.select(F.struct("*").alias("r"), *[idkey(F.col(f"`{k}`"), df.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(True).alias("here")).alias(side)
    b, a = ids(before, "b"), ids(after, "a")
    on = None
    for i in range(len(keys)):
        same = F.col(f"b.k{i}").eqNullSafe(F.col(f"a.k{i}"))
        on = same if on is None else on & same
    others = [f for f in before.schema if f.name not in keys]
    changes = [F.when(~idkey(F.col(f"b.r.`{f.name}`"), f.dataType).eqNullSafe(idkey(F.col(f"a.r.`{f.name}`"), f.dataType)), F.lit(f.name)) for f in others]
    changed = F.array_compact(F.array(*changes)) if changes else F.array().cast("array<string>")
    kind = F.when(F.col("b.here").isNull(), "added").when(F.col("a.here").isNull(), "removed").when(F.size("columns") > 0, "changed").otherwise("same")
    joined = b.join(a, on, "full_outer").withColumn("columns", changed)
    key = F.when(F.col("b.here").isNull(), display(after, keys, "a.r")).otherwise(display(before, keys, "b.r"))
    return Diff(before, after, keys, joined.select(kind.alias("kind"), key.alias("key"), F.when(kind == "changed", F.col("columns")).alias("columns")))
