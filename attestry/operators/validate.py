"""Validation against a contract: a true count of violations, and the first of them with their rows.

Rules that look at one cell are counted together in one pass. Uniqueness is counted as rows minus distinct values,
each column for itself. Evidence is only sought where there is a violation: row-local findings by a filter, repeated
values by a minimum over rows and a join, so that no value's rows meet in one task; both end in one bounded top list.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import idkey, number, render
from ..functions.patterns import checked
from ..plans.contract import RULES, Contract, parse
from ..sources.order import ROW, with_row
from .profile import profile

#: Allowed values beyond which a list is joined, not written into the plan. A list is part of its contract, and on the driver.
LISTED = 200
SCHEMA = "row long, col int, rule int, column string, name string, value string"


def present(df: DataFrame, contract: Contract) -> list[tuple[int, T.StructField]]:
    return [(i, f) for i, f in enumerate(df.schema) if f.name in contract.columns]


def marked(df: DataFrame, contract: Contract) -> DataFrame:
    """df with a column for each rule with a long list of allowed values: not null where the value is in the list."""
    for i, f in present(df, contract):
        allowed = contract.columns[f.name].allowed
        if allowed is not None and len(allowed) > LISTED and _mark(i) not in df.columns:
            values = df.sparkSession.createDataFrame(pd.DataFrame({_mark(i): sorted(allowed)}), f"{_mark(i)} string")
            df = df.join(F.broadcast(values), render(F.col(f"`{f.name}`"), f.dataType) == F.col(_mark(i)), "left")
    return df


def _mark(i: int) -> str:
    return f"__allowed_{i}"


def predicates(df: DataFrame, contract: Contract) -> list[tuple[int, str, int, Column]]:
    """(column's place, column, rule's place, condition of a violation) of the rules that look at one cell."""
    out, spark = [], df.sparkSession
    for rules in contract.columns.values():  # a bad pattern is refused even if its column isn't there
        if rules.pattern is not None:
            checked(spark, rules.pattern)
    for i, f in present(df, contract):
        rules, c = contract.columns[f.name], F.col(f"`{f.name}`")
        x = number(c, f.dataType)
        if rules.not_null:
            out.append((i, f.name, 1, c.isNull()))
        if rules.min is not None and x is not None:
            out.append((i, f.name, 3, x < F.lit(rules.min)))
        if rules.max is not None and x is not None:
            above = x > F.lit(rules.max)
            out.append((i, f.name, 4, above & ~F.isnan(x) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else above))
        if rules.pattern is not None:
            out.append((i, f.name, 5, ~render(c, f.dataType).rlike(checked(spark, rules.pattern))))
        if rules.allowed is not None:
            text = render(c, f.dataType)
            if _mark(i) in df.columns:
                out.append((i, f.name, 6, text.isNotNull() & F.col(_mark(i)).isNull()))
            else:
                out.append((i, f.name, 6, ~text.isin(*sorted(rules.allowed)) if rules.allowed else text.isNotNull()))
    return out


def counts(df: DataFrame, contract: Contract) -> tuple[int, dict[tuple[int, int], int]]:
    """The number of rows, and of violations by (column's place, rule's place)."""
    given, df = df, marked(df, contract)
    local = predicates(df, contract)
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(cond).alias(f"{i}:{r}") for i, _, r, cond in local]).first()
    found = {(i, r): row[f"{i}:{r}"] for i, _, r, _ in local}
    unique = [(i, f) for i, f in present(given, contract) if contract.columns[f.name].unique]
    if unique:
        found |= {(r["i"], 2): r["n"] for r in reduce(DataFrame.unionByName, [repeated_count(given, i, f) for i, f in unique]).collect()}
    return row["rows"], found


def repeated_count(df: DataFrame, i: int, f: T.StructField) -> DataFrame:
    """(i, n): how many values have been there before."""
    by = df.select(idkey(F.col(f"`{f.name}`"), f.dataType).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit(i).alias("i"), "n")


def repeats(df: DataFrame, name: str) -> DataFrame:
    """Rows of df (with ROW) whose value of the column has been there in an earlier row."""
    t = df.schema[name].dataType
    keyed = df.withColumn("__k", idkey(F.col(f"`{name}`"), t)).where("__k IS NOT NULL")
    first = keyed.groupBy("__k").agg(F.min(ROW).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return keyed.join(first, "__k").where(F.col(ROW) > F.col("__first")).drop("__k", "__first")


def findings(df: DataFrame, contract: Contract, found: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """Every violation that has a row: row, col, rule, column, name, value; df has ROW. Messages come later, for few."""
    wanted = lambda i, r: found is None or found.get((i, r), 0) > 0
    parts, given, df = [], df, marked(df, contract)
    local = [x for x in predicates(df, contract) if wanted(x[0], x[2])]
    if local:
        at = [F.when(cond, F.struct(F.lit(i).alias("col"), F.lit(r).alias("rule"), F.lit(c).alias("column"), F.lit(RULES[r]).alias("name"), render(F.col(f"`{c}`"), df.schema[c].dataType).alias("value"))) for i, c, r, cond in local]
        hits = df.where(reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for *_, c in local])).select(F.col(ROW).alias("row"), F.explode(F.filter(F.array(*at), lambda x: x.isNotNull())).alias("v"))
        parts.append(hits.select("row", "v.*"))
    for i, f in present(given, contract):
        if contract.columns[f.name].unique and wanted(i, 2):
            parts.append(repeats(given, f.name).select(F.col(ROW).alias("row"), F.lit(i).alias("col"), F.lit(2).alias("rule"), F.lit(f.name).alias("column"), F.lit("unique").alias("name"), render(F.col(f"`{f.name}`"), f.dataType).alias("value")))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], SCHEMA)


def shown(x: float) -> str:
    """A bound as it is printed: whole numbers without a point."""
    return str(int(x)) if x == int(x) else repr(x)


# The texts of findings, which reports have to share.
def message(contract: Contract, column: str, rule: str, value: str | None, values: bool) -> str:
    rules = contract.columns[column]
    if rule == "required":
        return f"Required column `{column}` is missing"
    if rule == "not_null":
        return "Null value is not allowed"
    if rule == "unique":
        return f"Duplicate value `{value}`" if values else "Duplicate value detected"
    what = f"Value `{value}`" if values else "Value"
    if rule == "min":
        return f"{what} is below {shown(rules.min)}"
    if rule == "max":
        return f"{what} is above {shown(rules.max)}"
    if rule == "pattern":
        return f"{what} does not match `{rules.pattern}`" if values else f"{what} does not match the required pattern"
    return f"{what} is not in the allowlist"


def validate(df: DataFrame, contract, include_profile: bool = True, row=None) -> dict:
    """The report: valid, violation_count, truncated, findings; with the profile, or rows and the mode."""
    contract = parse(contract)
    missing = sorted(name for name, rules in contract.columns.items() if rules.required and name not in df.columns)
    rows, found = counts(df, contract)
    total, most = len(missing) + sum(found.values()), contract.max_findings
    kept = [{"rule": "required", "column": c, "row": None, "message": message(contract, c, "required", None, include_profile)} for c in missing[:most]]
    if most > len(kept) and sum(found.values()):
        top = findings(with_row(df, row), contract, found).orderBy("row", "col", "rule").limit(most - len(kept)).collect()
        kept += [{"rule": r["name"], "column": r["column"], "row": r["row"], "message": message(contract, r["column"], r["name"], r["value"], include_profile)} for r in top]
    report = {"valid": total == 0, "violation_count": total, "truncated": total > len(kept), "findings": kept}
    if include_profile:
        return report | {"profile": profile(df, "exact", row)}
    return report | {"rows": rows, "mode": "rules_only"}


def validation_table(df: DataFrame, contract) -> DataFrame:
    """The report's head as a one-row DataFrame, without a job on the way: valid, violation_count, rows."""
    contract = parse(contract)
    missing = sum(rules.required and name not in df.columns for name, rules in contract.columns.items())
    local = predicates(listed := marked(df, contract), contract)
    out = listed.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(cond).alias(f"x{k}") for k, (*_, cond) in enumerate(local)])
    total = reduce(Column.__add__, [F.col(f"x{k}") for k in range(len(local))], F.lit(missing).cast("long"))
    parts = [out.select("rows", total.alias("violation_count"))]
    for i, f in present(df, contract):
        if contract.columns[f.name].unique:
            parts.append(repeated_count(df, i, f).select(F.lit(0).cast("long").alias("rows"), F.col("n").alias("violation_count")))
    both = reduce(DataFrame.unionByName, parts).agg(F.sum("rows").alias("rows"), F.sum("violation_count").alias("violation_count"))
    return both.select((F.col("violation_count") == 0).alias("valid"), "violation_count", "rows")
