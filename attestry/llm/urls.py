"""URL filter by rules, and by a ratio of character language models where no rule fits (operator 2).

Two smoothed Markov models of variable order are counted over all URLs that the rules accept and all that they reject.
Counts are exact: they live in distributed tables that grow with the number of different n-grams. What each n-gram
adds to a log-likelihood difference is worked out once, by joins, and joined to the URLs' n-grams; only the steps of
the commonest n-grams, HEAD at most, are sent to all tasks. A URL's difference, divided by its length, is held against
a threshold calibrated on URLs left out of the counts (crc32(url) mod 5 is 0).

The models read the whole URL: scheme, host, path, query and fragment.

Defined results: a null url, or one without ``://``, has an empty host and path, and a null one counts as empty for the
models; URLs are read whole however long; of thresholds with equal error the middle one is taken; without accepted or
without rejected URLs the method allows; an empty table gives an empty result; repeated rows are judged each for
itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .exact_dedup import LOWER, UPPER

#: Fixed rules of the query: (verdict, host/path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
ORDER, SMOOTH = 5, 2.0
#: Of the tables on the driver: two characters. Of the fraction of a step.
BITS, FINE = 16, 36
#: What an n-gram is counted for, and how many n-grams' steps are sent to all tasks at most.
USES, HEAD = ("rejected", "accepted", "asked"), 1 << 16
BINS, SPAN = 4_000, 8.0


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: list[tuple[str, str]], what) -> Column:
    """The longest rule that fits, given to `what`; null if none."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(slash + p)
        out = F.when(fits, F.lit(what(verdict, rule))).otherwise(out)
    return out


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each order and character its n-gram and its context, as numbers made of their bytes; and whose it is.

    Neither padding nor end is a byte of UTF-8, so different n-grams of an order are different numbers.
    """
    joined = bytearray()
    lengths = []
    for u in urls:
        raw = u.encode("utf-8", "surrogatepass")
        joined += b"\xff" * ORDER + raw + b"\xfe"
        lengths.append(len(raw) + 1)
    b = np.frombuffer(bytes(joined), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(urls)), np.array(lengths, dtype=np.int64) + ORDER)
    at = np.flatnonzero(_scored(lengths))
    gram = np.empty((ORDER + 1, len(at)), np.int64)
    for k in range(ORDER + 1):
        gram[k] = b[at - k] << (8 * k) | (gram[k - 1] if k else 0)
    return gram, gram >> 8, owner[at]


def _scored(lengths: list[int]) -> np.ndarray:
    """False for the padding before each URL."""
    ends = np.cumsum(np.array(lengths) + ORDER)
    mask = np.ones(ends[-1] if len(ends) else 0, bool)
    for e, n in zip(ends, lengths, strict=True):
        mask[e - n - ORDER:e - n] = False
    return mask


def probabilities(table: np.ndarray, gram: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Of characters, from one side's counts [n-gram or context, order, number]; numbers beyond a table count 0."""

    def at(counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.where(keys < len(counts), counts[np.minimum(keys, len(counts) - 1)], 0)

    p = np.full(gram.shape[1], 1 / 256)
    for k in range(len(gram)):
        p = (at(table[0, k], gram[k]) + SMOOTH * p) / (at(table[1, k], context[k]) + SMOOTH)
    return p


def differences(tables: np.ndarray, urls: list[str]) -> np.ndarray:
    """Log-likelihood accepted minus rejected, for each character of the URL on average; of tables in memory."""
    if not urls:
        return np.zeros(0)
    gram, context, owner = grams(urls)
    each = np.log(probabilities(tables[1], gram, context)) - np.log(probabilities(tables[0], gram, context))
    return np.bincount(owner, each, len(urls)) / np.bincount(owner, minlength=len(urls))


def count(urls: DataFrame) -> DataFrame:
    """(gram, rejected, accepted, asked): how often each n-gram of the highest order is in all rows of (url, use), exactly.

    Counts of lower orders and of contexts are sums of these.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gram, _, owner = grams(list(batch["url"]))
            key, n = np.unique(gram[ORDER] * len(USES) + batch["use"].to_numpy(np.int64)[owner], return_counts=True)
            gram, use = np.divmod(key, len(USES))
            yield pd.DataFrame({"gram": gram} | {name: np.where(use == i, n, 0) for i, name in enumerate(USES)})

    rows = urls.mapInPandas(run, "gram long, " + ", ".join(f"{x} long" for x in USES))
    return common.written(_summed(rows, F.col("gram")), "url_grams")


def _summed(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("gram")).agg(*[F.sum(x).alias(x) for x in USES])


def _shorter(k: int) -> Column:
    """The n-gram of order k that a longer one ends with."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))


def steps(counts: DataFrame) -> DataFrame:
    """(gram, asked, step): what each n-gram asked for adds to a URL's difference, in 2**-FINE.

    Order by order, each from the probabilities of the one before. At most 256 n-grams of an order share a context or
    an ending, so no key of these windows and joins is hot. Two characters at most are 65,536 n-grams: those are summed
    on the driver.
    """
    rows = _summed(counts, _shorter(1)).collect()  # 65,536 at most
    gram = np.array([r["gram"] for r in rows], dtype=np.int64)
    low = []
    for use in USES[:2]:
        n = np.array([r[use] for r in rows], dtype=np.int64)
        t = np.zeros((2, 2, 1 << BITS), np.int64)
        np.add.at(t[0, 1], gram, n)
        np.add.at(t[1, 1], gram >> 8, n)
        np.add.at(t[0, 0], gram & 255, n)
        t[1, 0, 0] = n.sum()
        low.append(probabilities(t, np.stack([gram & 255, gram]), np.stack([gram * 0, gram >> 8])).tolist())
    known = [(r["gram"], p, q) for r, p, q in zip(rows, *low, strict=True) if r["asked"]]
    out = F.broadcast(counts.sparkSession.createDataFrame(known, "shorter long, p_rejected double, p_accepted double"))
    for k in range(2, ORDER + 1):
        level = _summed(counts, _shorter(k)) if k < ORDER else counts
        same = Window.partitionBy(F.shiftright("gram", 8))
        level = level.select("*", *[F.sum(x).over(same).alias(f"after_{x}") for x in USES[:2]]).where("asked > 0")
        level = level.withColumn("shorter", _shorter(k - 1)).join(out, "shorter")
        p = [((F.col(x) + SMOOTH * F.col(f"p_{x}")) / (F.col(f"after_{x}") + SMOOTH)).alias(f"p_{x}") for x in USES[:2]]
        out = level.select(F.col("gram").alias("shorter"), "asked", *p)
        if k < ORDER:
            out = out.drop("asked")
    step = F.round((F.log("p_accepted") - F.log("p_rejected")) * (1 << FINE)).cast("long")
    return common.written(out.select(F.col("shorter").alias("gram"), "asked", step.alias("step")), "url_steps")


def scored(rows: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """rows of (id, url, ...) with their score: the mean step of their characters. Steps are whole numbers, so their sum has no order.

    Steps of n-grams asked for `least` times or more go to all tasks, the others are joined.
    """
    head = known.where(F.col("asked") >= least).select("gram", "step").collect()  # HEAD at most, see judged
    head = np.array(sorted((r["gram"], r["step"]) for r in head), dtype=np.int64).reshape(-1, 2)

    @F.pandas_udf("common long, n long, rare array<long>")
    def run(u: pd.Series) -> pd.DataFrame:
        gram, _, owner = grams(list(u))
        at = np.minimum(np.searchsorted(head[:, 0], gram[ORDER]), max(0, len(head) - 1))
        found = head[at, 0] == gram[ORDER] if len(head) else np.zeros(len(owner), bool)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, owner[found], head[at[found], 1])
        ends = np.cumsum(np.bincount(owner[~found], minlength=len(u)))[:-1]
        return pd.DataFrame({"common": total, "n": np.bincount(owner, minlength=len(u)), "rare": np.split(gram[ORDER][~found], ends)})

    got = common.written(rows.withColumn("r", run.asNondeterministic()("url")).select(*rows.columns, "r.*"), "url_parts")
    rare = got.select("id", F.explode("rare").alias("gram")).join(known.select("gram", "step"), "gram").groupBy("id").agg(F.sum("step").alias("more"))
    total = F.col("common") + F.coalesce("more", F.lit(0))
    return got.join(rare, "id", "left").withColumn("score", total / F.col("n") / float(1 << FINE)).select(*rows.columns, "score")


def calibrate(rows: DataFrame) -> float:
    """The threshold with the least mean error rate on rows of (accepted, score) left out of the counts."""
    place = F.greatest(F.lit(0.0), F.least(F.lit(BINS - 1.0), (F.col("score") + SPAN) / (2 * SPAN) * BINS)).cast("int")
    rows = rows.groupBy("accepted", place.alias("bin")).count().collect()  # 2 * BINS at most
    h = np.zeros((2, BINS))
    for r in rows:
        h[int(r["accepted"]), r["bin"]] = r["count"]
    if not h[0].sum() or not h[1].sum():
        return 0.0
    below = np.concatenate([[[0.0], [0.0]], h.cumsum(axis=1) / h.sum(axis=1, keepdims=True)], axis=1)
    wrong = below[1] + 1 - below[0]  # accepted URLs under the threshold, rejected ones not under it
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(best[len(best) // 2] / BINS * 2 * SPAN - SPAN)


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, head: int = HEAD) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the method, where no rule fits)."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", ruled(rules, lambda v, r: r)).withColumn("accepted", ruled(rules, lambda v, r: v) == "allow")
    left_out = F.crc32(F.col("url").cast("binary")) % 5 == 0
    use = F.when(F.col("accepted").isNull() | left_out, USES.index("asked")).otherwise(F.col("accepted").cast("int"))
    rows = common.written(rows.withColumn("use", use).withColumn("id", F.monotonically_increasing_id()), "url_rows")

    counts = count(rows.select("url", "use"))
    seen = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in USES]).first()
    asked = rows.where(F.col("use") == USES.index("asked"))
    if seen["rejected"] and seen["accepted"]:
        # no more than `head` n-grams can be asked for so often
        asked = common.written(scored(asked, steps(counts), seen["asked"] / head), "url_scores")
        threshold = calibrate(asked.where("accepted IS NOT NULL"))
    else:
        asked, threshold = asked.withColumn("score", F.lit(0.0)), 0.0

    def verdict(accepted: Column) -> Column:
        return F.when(accepted, "allow").otherwise("block").alias("verdict")

    base = rows.where("accepted IS NOT NULL").select("page_id", "host", "path", "rule", verdict(F.col("accepted")), F.lit(None).cast("double").alias("score"))
    rest = asked.where("accepted IS NULL").select("page_id", "host", "path", "rule", verdict(F.col("score") >= threshold), "score")
    return base.unionByName(rest)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    found = judged(common.table(spark, sf_dir, "pages"))
    common.restore(spark)
    return found.drop("score")


def ruled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone decide, for every page: page_id, host, path, rule, verdict (null where no rule fits)."""
    found = op2(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


_RULED = """
WITH p AS (SELECT row_number() OVER () AS id, page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
f AS (SELECT id, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict FROM p, (SELECT *, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS s FROM r) WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY id),
u AS (SELECT id, page_id, url, host, path, rule, verdict FROM p LEFT JOIN f USING (id))"""
RULES_SQL = _RULED + " SELECT page_id, host, path, rule, verdict FROM u"


def _chance(side: str) -> str:
    """A character's probability, from counts of its n-grams (g0, g1, ...) and their contexts (c0, c1, ...)."""
    out = "1.0 / 256"
    for k in range(ORDER + 1):
        out = f"(coalesce(g{k}.{side}, 0) + {SMOOTH} * {out}) / (coalesce(c{k}.{side}, 0) + {SMOOTH})"
        out = f"({out})"
    return out


#: The same models, their counts by the hexadecimal text of n-grams; crc32 bit by bit.
SQL = f"""{_RULED},
crcs AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END)) AS tab),
v AS (SELECT id, verdict, '{'ff' * ORDER}' || lower(hex(encode(url))) || 'fe' AS x, octet_length(encode(url)) + 1 AS n,
  xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(url))), lambda i: ('0x' || substr(hex(encode(url)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 5 = 0 AS held FROM u, crcs),
s AS (SELECT id, CASE WHEN verdict IS NULL OR held THEN 'asked' ELSE verdict END AS use, substr(x, 2 * i + 1, {2 * ORDER + 2}) AS g FROM v, unnest(range(n)) AS t(i)),
g AS (SELECT k, right(g, 2 * k + 2) AS g, count(*) FILTER (use = 'allow') AS a, count(*) FILTER (use = 'block') AS r FROM s, unnest(range({ORDER + 1})) AS t(k) WHERE use <> 'asked' GROUP BY ALL),
c AS (SELECT k, left(g, 2 * k) AS c, sum(a) AS a, sum(r) AS r FROM g GROUP BY ALL),
q AS (SELECT q.g, round((ln({_chance('a')}) - ln({_chance('r')})) * {1 << FINE}) AS step FROM (SELECT DISTINCT g FROM s WHERE use = 'asked') AS q
  {' '.join(f"LEFT JOIN g AS g{k} ON g{k}.k = {k} AND g{k}.g = right(q.g, {2 * k + 2}) LEFT JOIN c AS c{k} ON c{k}.k = {k} AND c{k}.c = left(right(q.g, {2 * k + 2}), {2 * k})" for k in range(ORDER + 1))}),
z AS (SELECT s.id, sum(step) / count(*) / {1 << FINE} AS score FROM s JOIN q USING (g) WHERE use = 'asked' GROUP BY s.id),
h AS (SELECT verdict, floor(greatest(0, least({BINS} - 1, (score + {SPAN}) / {2 * SPAN} * {BINS}))) AS bin FROM z JOIN v USING (id) WHERE verdict IS NOT NULL),
w AS (SELECT t, (SELECT avg((bin < t)::INT) FROM h WHERE verdict = 'allow') + 1 - (SELECT avg((bin < t)::INT) FROM h WHERE verdict = 'block') AS wrong FROM unnest(range({BINS} + 1)) AS r(t)),
b AS (SELECT list(t ORDER BY t) AS best FROM w WHERE wrong <= (SELECT min(wrong) FROM w) + 1e-12),
l AS (SELECT coalesce(best[len(best) // 2 + 1] / {BINS} * {2 * SPAN} - {SPAN}, 0.0) AS least, (SELECT count(DISTINCT use) FROM s WHERE use <> 'asked') = 2 AS learned FROM b)
SELECT page_id, host, path, rule, coalesce(u.verdict, CASE WHEN NOT learned OR score >= least THEN 'allow' ELSE 'block' END) AS verdict FROM u LEFT JOIN z USING (id), l
"""
