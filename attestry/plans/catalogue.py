"""Named queries over the test tables, and the SQL that gives the same rows.

The tables' ids are their row numbers, so both sides speak of the same rows. The tables hold no nulls; where nulls
matter, both sides make them by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pii import classified
from ..operators import diff as D
from ..operators import leakage as L
from ..operators import pii as P
from ..operators import validate as V
from ..operators.fingerprint import fingerprint_table
from ..operators.profile import profile_table
from ..plans.contract import parse
from ..sources.order import ROW, with_row

FLAGSHIP = "validate_orders"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CONTRACT = {
    "columns": {
        "o_orderkey": {"required": True, "not_null": True, "unique": True},
        "o_custkey": {"unique": True},
        "o_orderstatus": {"allowed": ["F", "O"]},
        "o_totalprice": {"min": 1000.0, "max": 450000.0},
        "o_orderpriority": {"pattern": "^[1-3]-"},
        "missing": {"required": True},
    },
    "max_findings": 100,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# Profiles

#: Columns by table: (name, name of the type, whether it has a range).
_TABLES = {
    "orders": [("o_orderkey", "Int64", 1), ("o_custkey", "Int64", 1), ("o_orderstatus", "Utf8", 0), ("o_totalprice", "Float64", 1), ("o_orderdate", "Timestamp(Microsecond, None)", 2), ("o_orderpriority", "Utf8", 0)],
    "lineitem": [("l_orderkey", "Int64", 1), ("l_partkey", "Int64", 1), ("l_suppkey", "Int64", 1), ("l_linenumber", "Int32", 1), ("l_quantity", "Float64", 1), ("l_extendedprice", "Float64", 1), ("l_discount", "Float64", 1), ("l_tax", "Float64", 1), ("l_returnflag", "Utf8", 0), ("l_linestatus", "Utf8", 0), ("l_shipdate", "Timestamp(Microsecond, None)", 2)],
    "events": [("event_id", "Int64", 1), ("ts", "Timestamp(Microsecond, None)", 2), ("user_id", "Int64", 1), ("event_type", "Utf8", 0), ("value", "Float64", 1), ("props", "Utf8", 0)],
    "customer": [("c_custkey", "Int64", 1), ("c_name", "Utf8", 0), ("c_nationkey", "Int32", 1), ("c_acctbal", "Float64", 1), ("c_mktsegment", "Utf8", 0)],
    "embeddings": [("vec_id", "Int64", 1), ("embedding", "List(Float32)", 0), ("label", "Int32", 1)],
}


def _profile_sql(name: str, exact: bool) -> str:
    parts = []
    for c, kind, ranged in _TABLES[name]:
        x = {0: None, 1: c, 2: f"epoch_us({c})"}[ranged]
        lo, hi = (f"min({x})::DOUBLE", f"max({x})::DOUBLE") if x else ("NULL::DOUBLE", "NULL::DOUBLE")
        parts.append(f"SELECT '{c}' AS name, '{kind}' AS data_type, count(*) - count({c}) AS null_count, count({c}) AS non_null_count, {f'count(DISTINCT {c})' if exact else 'NULL::BIGINT'} AS distinct_count, {lo} AS min, {hi} AS max FROM {name}")
    return " UNION ALL ".join(parts)


for _name in _TABLES:
    query(f"profile_{_name}", _profile_sql(_name, True))(lambda spark, d, n=_name: profile_table(table(spark, d, n)))
query("profile_orders_none", _profile_sql("orders", False))(lambda spark, d: profile_table(table(spark, d, "orders"), "none"))


@query("profile_nulls", "SELECT 'x' AS name, 'Int64' AS data_type, count(*) - count(x) AS null_count, count(x) AS non_null_count, count(DISTINCT x) AS distinct_count, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS x FROM orders)")
def profile_nulls(spark, d):
    return profile_table(table(spark, d, "orders").select(F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS x")))


@query("distinct_float_bits", "SELECT 'v' AS \"column\", CAST(5 AS BIGINT) AS distinct_count")
def distinct_float_bits(spark, d):
    from ..operators.profile import distinct_counts

    odd = spark.sql("SELECT explode(array(0.0D, -0.0D, double('NaN'), 1.5D, -0.0D, double('inf'), double('NaN'), null)) AS v")
    return distinct_counts(odd).select("column", "distinct_count")


# Rules: findings of one rule, all of them

def _findings(name: str, row: str, contract: dict, prepare=lambda df: df):
    def run(spark, d):
        df = prepare(table(spark, d, name)).withColumn(ROW, F.col(row))
        return V.findings(df, parse(contract)).select("row", "column", F.col("name").alias("rule"), "value")

    return run


def _rule(key: str, sql: str, name: str, row: str, columns: dict, prepare=lambda df: df) -> None:
    query(key, sql)(_findings(name, row, {"columns": columns}, prepare))


_rule("rule_not_null", "SELECT o_orderkey AS \"row\", 'x' AS \"column\", 'not_null' AS rule, NULL::VARCHAR AS value FROM orders WHERE o_orderkey % 7 = 0", "orders", "o_orderkey", {"x": {"not_null": True}}, lambda df: df.withColumn("x", F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END")))
_rule("rule_unique", "SELECT \"row\", 'o_custkey' AS \"column\", 'unique' AS rule, value FROM (SELECT o_orderkey AS \"row\", o_custkey::VARCHAR AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i > 1", "orders", "o_orderkey", {"o_custkey": {"unique": True}})
_rule("rule_unique_timestamp", "SELECT event_id AS \"row\", 'ts' AS \"column\", 'unique' AS rule FROM (SELECT event_id, row_number() OVER (PARTITION BY ts ORDER BY event_id) AS i FROM events) WHERE i > 1", "events", "event_id", {"ts": {"unique": True}})
QUERIES["rule_unique_timestamp"] = lambda spark, d, f=QUERIES["rule_unique_timestamp"]: f(spark, d).drop("value")
_rule("rule_min", "SELECT o_orderkey AS \"row\", 'o_custkey' AS \"column\", 'min' AS rule, o_custkey::VARCHAR AS value FROM orders WHERE o_custkey::DOUBLE < 100.5", "orders", "o_orderkey", {"o_custkey": {"min": 100.5}})
_rule("rule_max", "SELECT c_custkey AS \"row\", 'c_nationkey' AS \"column\", 'max' AS rule, c_nationkey::VARCHAR AS value FROM customer WHERE c_nationkey > 20", "customer", "c_custkey", {"c_nationkey": {"max": 20}})
_rule("rule_pattern", "SELECT p_partkey AS \"row\", 'p_brand' AS \"column\", 'pattern' AS rule, p_brand AS value FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-5]$')", "part", "p_partkey", {"p_brand": {"pattern": "^Brand#[1-5]$"}})
_rule("rule_pattern_number", "SELECT o_orderkey AS \"row\", 'o_custkey' AS \"column\", 'pattern' AS rule, o_custkey::VARCHAR AS value FROM orders WHERE NOT regexp_matches(o_custkey::VARCHAR, '[13579]')", "orders", "o_orderkey", {"o_custkey": {"pattern": "[13579]"}})
_rule("rule_allowed", "SELECT o_orderkey AS \"row\", 'o_orderstatus' AS \"column\", 'allowed' AS rule, o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", "orders", "o_orderkey", {"o_orderstatus": {"allowed": ["F", "O"]}})
_rule("rule_allowed_lineitem_count", "SELECT event_id AS \"row\", 'event_type' AS \"column\", 'allowed' AS rule, event_type AS value FROM events", "events", "event_id", {"event_type": {"allowed": []}})


@query("rule_required", "SELECT 'missing' AS \"column\", 'required' AS rule, 'Required column `missing` is missing' AS message")
def rule_required(spark, d):
    report = V.validate(table(spark, d, "orders"), {"columns": {"missing": {"required": True}}}, False)
    return spark.createDataFrame([(f["column"], f["rule"], f["message"]) for f in report["findings"]], "column string, rule string, message string")


# Whole contracts

_COUNTS = """
SELECT 1 + (SELECT count(*) - count(DISTINCT o_custkey) FROM orders) + (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders)
  + (SELECT count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) + count(*) FILTER (o_totalprice < 1000) + count(*) FILTER (o_totalprice > 450000) + count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]-')) FROM orders) AS violation_count"""


@query("validate_orders", f"SELECT violation_count = 0 AS valid, violation_count::BIGINT AS violation_count, (SELECT count(*) FROM orders) AS rows FROM ({_COUNTS})")
def validate_orders(spark, d):
    return V.validation_table(table(spark, d, "orders"), CONTRACT)


@query("validate_clean", "SELECT true AS valid, 0::BIGINT AS violation_count, count(*) AS rows FROM lineitem")
def validate_clean(spark, d):
    return V.validation_table(table(spark, d, "lineitem"), {"columns": {"l_orderkey": {"required": True, "not_null": True, "min": 0}, "l_quantity": {"min": 0, "max": 1000}}})


_TOP = """
WITH f AS (
  SELECT o_orderkey AS "row", 1 AS col, 'o_custkey' AS "column", 2 AS r, 'unique' AS rule, o_custkey::VARCHAR AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i > 1
  UNION ALL SELECT o_orderkey, 2, 'o_orderstatus', 6, 'allowed', o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL SELECT o_orderkey, 5, 'o_orderpriority', 5, 'pattern', o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')
) """


@query("validate_findings", _TOP + "SELECT \"row\", \"column\", rule, CASE r WHEN 2 THEN 'Duplicate value `' || value || '`' WHEN 6 THEN 'Value `' || value || '` is not in the allowlist' ELSE 'Value `' || value || '` does not match `^[1-3]-`' END AS message FROM f ORDER BY f.\"row\", col, r LIMIT 100")
def validate_findings(spark, d):
    """The bounded report: the first 100 findings, which is the feature."""
    contract = {"columns": {k: CONTRACT["columns"][k] for k in ("o_custkey", "o_orderstatus", "o_orderpriority")}, "max_findings": 100}
    df = table(spark, d, "orders")
    parsed = parse(contract)
    top = V.findings(df.withColumn(ROW, F.col("o_orderkey")), parsed).orderBy("row", "col", "rule").limit(parsed.max_findings)
    text = F.concat(F.when(F.col("rule") == 2, "Duplicate value `").otherwise("Value `"), "value", F.when(F.col("rule") == 2, "`").when(F.col("rule") == 6, "` is not in the allowlist").otherwise("` does not match `^[1-3]-`"))
    return top.select("row", "column", F.col("name").alias("rule"), text.alias("message"))


@query("validate_report_fast", _COUNTS.replace("SELECT 1 +", "SELECT 'rules_only' AS mode, (SELECT count(*) FROM orders) AS rows, 100 AS kept, true AS truncated, 1 +"))
def validate_report_fast(spark, d):
    r = V.validate(table(spark, d, "orders"), CONTRACT, include_profile=False, row="o_orderkey")
    return spark.createDataFrame([(r["mode"], r["rows"], len(r["findings"]), r["truncated"], r["violation_count"])], "mode string, rows long, kept int, truncated boolean, violation_count long")


_ALL = _TOP.replace("UNION ALL SELECT o_orderkey, 5", """UNION ALL SELECT NULL, -1, 'missing', 0, 'required', NULL
  UNION ALL SELECT o_orderkey, 3, 'o_totalprice', CASE WHEN o_totalprice < 1000 THEN 3 ELSE 4 END, CASE WHEN o_totalprice < 1000 THEN 'min' ELSE 'max' END, o_totalprice::VARCHAR FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 450000
  UNION ALL SELECT o_orderkey, 5""", 1)
_MESSAGE = "CASE r WHEN 0 THEN 'Required column `missing` is missing' WHEN 2 THEN 'Duplicate value `' || value || '`' WHEN 3 THEN 'Value `' || value || '` is below 1000' WHEN 4 THEN 'Value `' || value || '` is above 450000' WHEN 6 THEN 'Value `' || value || '` is not in the allowlist' ELSE 'Value `' || value || '` does not match `^[1-3]-`' END"


def _evidence(spark: SparkSession, report: dict) -> DataFrame:
    rows = [(i, f["row"], f["column"], f["rule"], f["message"], report["violation_count"], report["valid"], report["truncated"]) for i, f in enumerate(report["findings"])]
    return spark.createDataFrame(rows, "place int, row long, column string, rule string, message string, violation_count long, valid boolean, truncated boolean")


@query("validate_report_full", _ALL + f", n AS ({_COUNTS}) SELECT (row_number() OVER (ORDER BY f.\"row\" NULLS FIRST, col, r) - 1)::INT AS place, f.\"row\", \"column\", rule, {_MESSAGE} AS message, violation_count::BIGINT AS violation_count, false AS valid, true AS truncated FROM f, n QUALIFY place < 100")
def validate_report_full(spark, d):
    """The whole report, profile and all: its evidence in order, several rules for a cell included; rows are the files' own."""
    report = V.validate(table(spark, d, "orders"), CONTRACT)
    assert report["profile"]["rows"] == table(spark, d, "orders").count()
    return _evidence(spark, report)


_CELL = {"columns": {"p_brand": {"pattern": "^Brand#[1-3]$", "allowed": ["Brand#1", "Brand#5"], "unique": True}}, "max_findings": 200}


@query("validate_rules_of_a_cell", """
WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
f AS (SELECT p_partkey AS "row", 2 AS r, 'unique' AS rule, 'Duplicate value detected' AS message FROM p WHERE i > 1
  UNION ALL SELECT p_partkey, 5, 'pattern', 'Value does not match the required pattern' FROM p WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]$')
  UNION ALL SELECT p_partkey, 6, 'allowed', 'Value is not in the allowlist' FROM p WHERE p_brand NOT IN ('Brand#1', 'Brand#5'))
SELECT (row_number() OVER (ORDER BY "row", r) - 1)::INT AS place, "row", 'p_brand' AS "column", rule, message, (SELECT count(*) FROM f) AS violation_count, false AS valid, true AS truncated FROM f QUALIFY place < 200""")
def validate_rules_of_a_cell(spark, d):
    """Up to three findings of one cell, in the rules' order."""
    return _evidence(spark, V.validate(table(spark, d, "part"), _CELL, include_profile=False))


_KEPT = 'SELECT row_number() OVER (ORDER BY {key}) - 1 AS "row", {value} FROM orders WHERE o_orderkey % 10 = 3'


@query("rule_min_filtered", f"SELECT \"row\", 'o_custkey' AS \"column\", 'min' AS rule, o_custkey::VARCHAR AS value FROM ({_KEPT.format(key='o_orderkey', value='o_custkey')}) WHERE o_custkey < 100.5")
def rule_min_filtered(spark, d):
    """Rows are numbered in the data given, which are filtered, and no column numbers them."""
    return _first_rows(table(spark, d, "orders").where("o_orderkey % 10 = 3"), {"o_custkey": {"min": 100.5}})


@query("rule_min_sorted", f"SELECT \"row\", 'o_custkey' AS \"column\", 'min' AS rule, o_custkey::VARCHAR AS value FROM ({_KEPT.format(key='o_orderkey DESC', value='o_custkey')}) WHERE o_custkey < 100.5")
def rule_min_sorted(spark, d):
    return _first_rows(table(spark, d, "orders").where("o_orderkey % 10 = 3").orderBy(F.desc("o_orderkey")), {"o_custkey": {"min": 100.5}})


def _first_rows(df: DataFrame, columns: dict) -> DataFrame:
    return V.findings(with_row(df), parse({"columns": columns})).select("row", "column", F.col("name").alias("rule"), "value")


@query("profile_csv", "SELECT name, data_type, null_count, non_null_count, distinct_count, min, max FROM (" + _profile_sql("customer", True).replace("'Int32'", "'Int64'") + ")")
def profile_csv(spark, d):
    """The customers, written as CSV and read again: types are inferred, whole numbers are of 64 bits."""
    from ..cluster import new_path
    from ..sources.inputs import read

    path = new_path(spark, "customers") + ".csv"
    table(spark, d, "customer").write.csv(path, header=True)
    return profile_table(read(spark, path))


# Differences

_BEFORE, _AFTER = "SELECT * FROM orders WHERE o_orderkey % 10 <> 0", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, CASE WHEN o_orderkey % 26 = 0 THEN 'x' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0"


def _sides(spark, d):
    o = table(spark, d, "orders")
    after = o.where("o_orderkey % 11 <> 0").withColumns({"o_totalprice": F.expr("CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"), "o_orderpriority": F.expr("CASE WHEN o_orderkey % 26 = 0 THEN 'x' ELSE o_orderpriority END")})
    return o.where("o_orderkey % 10 <> 0"), after.select(o.columns)


def _diff(spark, d):
    b, a = _sides(spark, d)
    return D.diff(b, a, "o_orderkey")


_FULL = f"FROM ({_BEFORE}) b FULL JOIN ({_AFTER}) a ON b.o_orderkey = a.o_orderkey"
_CHANGED = "b.o_totalprice <> a.o_totalprice OR b.o_orderpriority <> a.o_orderpriority"
query("diff_added", f"SELECT a.o_orderkey::VARCHAR AS key {_FULL} WHERE b.o_orderkey IS NULL")(lambda spark, d: _diff(spark, d).added)
query("diff_removed", f"SELECT b.o_orderkey::VARCHAR AS key {_FULL} WHERE a.o_orderkey IS NULL")(lambda spark, d: _diff(spark, d).removed)
query("diff_changed", f"SELECT b.o_orderkey::VARCHAR AS key, concat_ws(',', CASE WHEN b.o_totalprice <> a.o_totalprice THEN 'o_totalprice' END, CASE WHEN b.o_orderpriority <> a.o_orderpriority THEN 'o_orderpriority' END) AS columns {_FULL} WHERE {_CHANGED}")(lambda spark, d: _diff(spark, d).changed.select("key", F.concat_ws(",", "columns").alias("columns")))
query("diff_counts", f"SELECT count(*) FILTER (b.o_orderkey IS NULL) AS added_count, count(*) FILTER (a.o_orderkey IS NULL) AS removed_count, count(*) FILTER ({_CHANGED}) AS changed_count, count(b.o_orderkey) AS before_rows, count(a.o_orderkey) AS after_rows {_FULL}")(lambda spark, d: _diff(spark, d).counts())
query("diff_duplicate_keys", "SELECT l_orderkey || chr(31) || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")(lambda spark, d: D.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("diff_composite", "SELECT l_orderkey || chr(31) || l_linenumber AS key FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) WHERE q > 40")
def diff_composite(spark, d):
    before = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return D.diff(before, before.withColumn("q", F.expr("CASE WHEN q > 40 THEN q + 1 ELSE q END")), ["l_orderkey", "l_linenumber"]).changed.select("key")


@query("diff_null_keys", "SELECT '<null>' AS key, 'changed' AS kind UNION ALL SELECT k::VARCHAR, 'added' FROM (SELECT DISTINCT c_nationkey AS k FROM customer) WHERE k % 2 = 0")
def diff_null_keys(spark, d):
    k = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("v")).distinct()
    null = spark.sql("SELECT cast(null AS int) AS k, 1 AS v")
    schema = "k int, v int"
    before = k.where("k % 2 = 1").unionByName(null).to(_nullable(spark, schema))
    after = k.unionByName(null.withColumn("v", F.lit(2))).to(_nullable(spark, schema))
    return D.diff(before, after, "k").joined.where("kind <> 'same'").select("key", "kind")


def _nullable(spark, ddl):
    return spark.createDataFrame([], ddl).schema


# Leakage

def _split(spark, d, name, key, n=5):
    t = table(spark, d, name)
    return t.where(F.col(key) % n != 0), t.where(F.col(key) % n == 0)


def _leak_sql(source: str, key: str, part: str) -> str:
    return f"""
WITH tr AS (SELECT {key} AS k FROM {source} WHERE {part} % 5 <> 0), te AS (SELECT {key} AS k FROM {source} WHERE {part} % 5 = 0),
o AS (SELECT count(*) AS n FROM (SELECT k FROM tr INTERSECT SELECT k FROM te))
SELECT (SELECT count(*) FROM tr) AS train_rows, (SELECT count(*) FROM te) AS test_rows, o.n AS overlap_count, o.n / (SELECT count(DISTINCT k) FROM tr) AS train_overlap_rate, o.n / (SELECT count(DISTINCT k) FROM te) AS test_overlap_rate FROM o"""


@query("leakage_key_summary", _leak_sql("orders", "o_custkey", "o_orderkey"))
def leakage_key_summary(spark, d):
    return L.summary(*_split(spark, d, "orders", "o_orderkey"), ["o_custkey"])


@query("leakage_full_row", _leak_sql("documents", "text", "doc_id"))
def leakage_full_row(spark, d):
    return L.summary(*(x.select("text") for x in _split(spark, d, "documents", "doc_id")))


@query("leakage_overlap", "SELECT o_custkey AS k0, o_orderstatus AS k1 FROM orders WHERE o_orderkey % 5 <> 0 INTERSECT SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0")
def leakage_overlap(spark, d):
    return L.overlap(*_split(spark, d, "orders", "o_orderkey"), ["o_custkey", "o_orderstatus"])


@query("leakage_benchmark_text", "SELECT count(DISTINCT d.text) AS overlap_count FROM documents d JOIN benchmark b ON d.text = b.text")
def leakage_benchmark_text(spark, d):
    return L.summary(table(spark, d, "documents").select("text"), table(spark, d, "benchmark").select("text")).select("overlap_count")


# Personal data

_LUHN = "list_sum([CASE WHEN (len(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT ELSE CASE WHEN substr(d, i, 1)::INT > 4 THEN substr(d, i, 1)::INT * 2 - 9 ELSE substr(d, i, 1)::INT * 2 END END for i in range(1, len(d) + 1)]) % 10 = 0"
_PII = rf"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS token, generate_subscripts(string_split_regex(text, '\s+'), 1) - 1 AS position FROM documents),
c AS (SELECT *, regexp_replace(token, '[^0-9]', '', 'g') AS d FROM w WHERE regexp_matches(token, '[0-9@]')),
k AS (SELECT doc_id, position::INT AS position, token, CASE
  WHEN regexp_matches(token, '(?i)^[a-z0-9.!#$%&''*+/=?^_`{{|}}~-]+@[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?)+$') THEN 'email'
  WHEN regexp_matches(token, '^(?:\d{{1,3}}\.){{3}}\d{{1,3}}$') AND len(list_filter(string_split(token, '.'), lambda x: x::INT > 255)) = 0 THEN 'ipv4'
  WHEN regexp_matches(token, '^[0-9 -]{{13,23}}$') AND len(d) BETWEEN 13 AND 19 AND {_LUHN} THEN 'payment_card'
  WHEN regexp_matches(token, '^\+?[0-9][0-9 ()-]{{7,19}}$') AND len(d) BETWEEN 8 AND 15 THEN 'phone' END AS kind FROM c)
"""


@query("pii_tokens", _PII + "SELECT doc_id, position, token, kind, CASE WHEN kind = 'phone' THEN 'medium' ELSE 'high' END AS confidence FROM k WHERE kind IS NOT NULL")
def pii_tokens(spark, d):
    return P.tokens(table(spark, d, "documents"), "text", ["doc_id"])


@query("pii_counts_by_kind", _PII + "SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY kind")
def pii_counts_by_kind(spark, d):
    return pii_tokens(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("pii_numeric_low_confidence", f"SELECT o_orderkey AS \"row\", 'card' AS \"column\", CASE WHEN {_LUHN} THEN 'payment_card' ELSE NULL END AS kind, 'low' AS confidence FROM (SELECT o_orderkey, (4111111111111111 + o_orderkey)::VARCHAR AS d FROM orders) WHERE {_LUHN}")
def pii_numeric_low_confidence(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.expr("4111111111111111 + o_orderkey AS card"))
    return P.cells(df, ["o_orderkey"]).where("column = 'card'").select(F.col("o_orderkey").alias("row"), "column", "kind", "confidence")


@query("pii_dates_as_phones", "SELECT 'phone' AS kind, 'medium' AS confidence, count(*) AS n FROM orders")
def pii_dates_as_phones(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return P.cells(df).groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


_CARDS = f"SELECT o_orderkey AS \"row\" FROM (SELECT o_orderkey, (4111111111111111 + o_orderkey)::VARCHAR AS d FROM orders) WHERE {_LUHN}"


@query("pii_report", f"SELECT (row_number() OVER (ORDER BY \"row\") - 1)::INT AS place, \"row\", 'card' AS \"column\", 'payment_card' AS kind, 'low' AS confidence, (SELECT count(*) FROM orders) AS scanned_rows, (SELECT count(*) FROM ({_CARDS})) AS finding_count, (SELECT count(*) FROM ({_CARDS})) AS payment_cards, true AS detected, true AS truncated FROM ({_CARDS}) QUALIFY place < 25")
def pii_report(spark, d):
    """The report's first 25 findings, which is the feature, and its counts; what was found is shown as a fingerprint only."""
    report = P.scan(table(spark, d, "orders").select(F.expr("4111111111111111 + o_orderkey AS card")), 25)
    rows = [(i, f["row"], f["column"], f["kind"], f["confidence"], report["scanned_rows"], report["finding_count"], report["counts_by_kind"]["payment_card"], report["detected"], report["truncated"]) for i, f in enumerate(report["findings"])]
    return spark.createDataFrame(rows, "place int, row long, column string, kind string, confidence string, scanned_rows long, finding_count long, payment_cards long, detected boolean, truncated boolean")


_SAMPLES = {"a@b.co": "email", " person@example.com ": "email", "1.2.3.4": "ipv4", "256.1.1.1": None, "GB82WEST12345698765432": "iban", "GB82 WEST 1234 5698 7654 32": "iban", "GB83WEST12345698765432": None, "4111 1111 1111 1111": "payment_card", "4111111111111112": None, "0000000000000": "payment_card", "+1 (555) 010-9999": "phone", "2024-01-31": "phone", "hello": None, "": None}


@query("pii_samples", " UNION ALL ".join("SELECT '{}' AS text, {} AS kind".format(t, f"'{k}'" if k else "NULL::VARCHAR") for t, k in _SAMPLES.items()))
def pii_samples(spark, d):
    df = spark.createDataFrame([(t,) for t in _SAMPLES], "text string")
    return df.select("text", classified(F.col("text"), F.lit(False)).getField("kind").alias("kind"))


# Fingerprints and receipts: no SQL; unit tests hold them against known values

for _name, _row in (("nation", None), ("orders", "o_orderkey"), ("customer", "c_custkey"), ("embeddings", None), ("events", "event_id")):
    query(f"fingerprint_{_name}")(lambda spark, d, n=_name, r=_row: fingerprint_table(table(spark, d, n), r))


@query("leakage_samples")
def leakage_samples(spark, d):
    train, test = _split(spark, d, "orders", "o_orderkey")
    return spark.createDataFrame([(x,) for x in L.samples(train, test, ["o_custkey"], 20)], "sample string")


@query("receipt_roundtrip", "SELECT true AS valid, true AS signature_valid, true AS report_hash_matches, true AS schema_supported")
def receipt_roundtrip(spark, d):
    from ..receipts import generate_keypair, sign_receipt, verify_receipt

    report = V.validate(table(spark, d, "orders"), CONTRACT, include_profile=False, row="o_orderkey")
    v = verify_receipt(sign_receipt(report, private_key=generate_keypair()["private_key"]))
    return spark.createDataFrame([(v["valid"], v["signature_valid"], v["report_hash_matches"], v["schema_supported"])], "valid boolean, signature_valid boolean, report_hash_matches boolean, schema_supported boolean")


@query("receipt_tampered", "SELECT 'report' AS tampered, false AS valid, false AS signature_valid, false AS report_hash_matches, true AS schema_supported UNION ALL SELECT 'issued_at_unix_ms', false, false, true, true UNION ALL SELECT 'schema', false, false, true, false UNION ALL SELECT 'public_key', false, false, true, true UNION ALL SELECT 'signature', false, false, true, true")
def receipt_tampered(spark, d):
    """A receipt with one field changed after it was signed."""
    from ..receipts import generate_keypair, sign_receipt, verify_receipt

    report = V.validate(table(spark, d, "orders"), CONTRACT, include_profile=False, row="o_orderkey")
    receipt = sign_receipt(report, private_key=generate_keypair()["private_key"])
    other = sign_receipt({"x": 1}, private_key=generate_keypair()["private_key"])
    changes = {"report": report | {"valid": True}, "issued_at_unix_ms": 1, "schema": "another", "public_key": other["public_key"], "signature": other["signature"]}
    seen = [(k, verify_receipt(receipt | {k: v})) for k, v in changes.items()]
    return spark.createDataFrame([(k, v["valid"], v["signature_valid"], v["report_hash_matches"], v["schema_supported"]) for k, v in seen], "tampered string, valid boolean, signature_valid boolean, report_hash_matches boolean, schema_supported boolean")


@query("fingerprint_of_order", "SELECT false AS equal_when_turned, true AS equal_when_sorted, false AS equal_when_filtered")
def fingerprint_of_order(spark, d):
    """Fingerprints are of the order given."""
    from ..operators.fingerprint import fingerprint

    c = table(spark, d, "customer")
    same = lambda df: fingerprint(df) == fingerprint(c)
    return spark.createDataFrame([(same(c.orderBy(F.desc("c_custkey"))), same(c.orderBy("c_custkey")), same(c.where("c_custkey > 0")))], "equal_when_turned boolean, equal_when_sorted boolean, equal_when_filtered boolean")


@query("stream_rule_counts", "SELECT 'o_orderstatus' AS \"column\", 'allowed' AS rule, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'o_totalprice', 'max', count(*) FROM orders WHERE o_totalprice > 450000 HAVING count(*) > 0")
def stream_rule_counts(spark, d):
    """Findings of a stream over the table's files, written as they arrive, then counted."""
    from ..cluster import new_path
    from ..streaming.rules import write_violations

    path = f"{d.rstrip('/')}/orders.parque[t]"  # a pattern, so that a single file will do
    stream = spark.readStream.schema(table(spark, d, "orders").schema).parquet(path)
    out = new_path(spark, "violations")
    write_violations(stream, {"columns": {"o_orderstatus": {"allowed": ["F", "O"]}, "o_totalprice": {"max": 450000}}}, "o_orderkey", out, new_path(spark, "violations-state")).awaitTermination()
    return spark.read.parquet(out).groupBy("column", "rule").agg(F.count(F.lit(1)).alias("n"))


