"""Near-duplicates by ProbMinHash over weighted word shingles, banding and verification (operator 7).

A text's words are its runs of letters and digits, lower-cased; five of them make a shingle, weighted by how often it
occurs. A signature has a register for each of several exponential races: shingle arrivals come as Poisson processes
of the shingle's weight, the first in each register wins, and a shingle stops once its next arrival is later than all
registers. Two signatures agree in a register with the probability Jaccard similarity of their texts.

1. Texts with the same words collapse to one class, so groups of copies cost one signature each.
2. Classes that agree in a band of registers are candidates. In each bucket every class meets a pivot, another one in
   each band; pairs whose signatures come near enough are verified exactly on their shingles, and links are joined to
   components. Large groups of near copies are all but joined by that, at a cost linear in their size.
3. Buckets that still hold several components: classes outside the bucket's largest component meet the others, so no
   link between different texts is lost. In large buckets they do so in tiles of bounded size that carry the shingles
   themselves: pairs are verified where they meet, and only links that join two components become rows.

Defined results: similarity is the exact probability Jaccard, LEAST or more; a text of fewer than five words has one
shingle; a text without words is alone in its class, as is a null one; rows repeated with one doc_id and text are of
one class; texts are read whole, however long; an empty table gives an empty result; other columns are ignored (the
stage keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import Words, chunks, forget, mixed, slices, sums

SHINGLE, LEAST = 5, 0.8
#: Registers, and registers in a band: texts of similarity 0.8 share a band with probability 0.998.
REGISTERS, BAND = 80, 5
#: Registers that must agree before a pair is verified: four standard deviations below what 0.8 gives. With 0 every pair
#: that shares a band is verified.
AGREE = 50
#: Classes of a bucket that meet in a plain join; sides of a tile in larger ones, in classes and in bytes of their sets.
SMALL, TILE, TILE_BYTES = 32, (256, 1024), (2 << 20, 8 << 20)
_words = re.compile(r"[^\W_]+").findall
_GOLD = 0x9E3779B97F4A7C15


def canonical(text: str | None) -> bytes:
    return " ".join(_words(text.lower())).encode("utf-8", "surrogatepass") if text else b""


def weighted(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and weight of each distinct shingle, by document."""
    sizes = np.diff(words.first)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(sizes)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = words.first[doc] + within
    h = sums(words.hashes, begin, np.minimum(begin + n, words.first[doc + 1]), 0xC2B2AE3D27D4EB4F)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, h: np.ndarray, w: np.ndarray, docs: int, k: int = REGISTERS) -> np.ndarray:
    """The winner's hash (32 bits) in each of k registers of each document; 0 where a document has no shingle."""
    register, winner = np.full(docs * k, np.inf), np.zeros(docs * k, np.uint32)
    limit = np.full(docs, np.inf)
    t, seed, turn = np.zeros(len(h)), h.copy(), 0
    low = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    while len(doc):
        turn += 1
        u = mixed(seed + np.uint64(turn * _GOLD % 2**64))
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        slot = doc * k + (mixed(u) % np.uint64(k)).astype(np.int64)
        on = t < limit[doc]
        if not on.all():
            doc, seed, t, w, low, slot = doc[on], seed[on], t[on], w[on], low[on], slot[on]
        np.minimum.at(register, slot, t)
        won = register[slot] == t
        winner[slot[won]] = low[won]
        own = np.unique(doc)
        limit[own] = register.reshape(docs, k)[own].max(axis=1)
    return winner.reshape(docs, k)


def bands(sig: np.ndarray, each: int = BAND) -> np.ndarray:
    """A hash for each band of each signature."""
    out = []
    for i in range(0, sig.shape[1], each):
        h = np.full(len(sig), i + 1, np.uint64)
        for j in range(i, min(i + each, sig.shape[1])):
            h = mixed(h * np.uint64(_GOLD) + sig[:, j].astype(np.uint64))
        out.append(h)
    return np.stack(out, axis=1).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets: sum over common i of 1 / sum over j of max(a_j/a_i, b_j/b_i)."""
    common_hashes, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common_hashes):
        return 0.0
    x, y = a[1].astype(float), b[1].astype(float)
    p, q = x[i], y[j]
    only_a, only_b = x.sum() - p.sum(), y.sum() - q.sum()
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    # max(p_j / p_i, q_j / q_i) is the first where p_j / q_j is the larger, i.e. for j from i on
    from_i, before = np.cumsum(p[::-1])[::-1], np.concatenate([[0.0], np.cumsum(q)[:-1]])
    return float((1 / ((from_i + only_a) / p + (before + only_b) / q)).sum())


def signed(docs: DataFrame) -> DataFrame:
    """uid, doc_id, th, key (of the words; null without any), bands, sig: one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [canonical(t) for t in batch.column(3).to_pylist()]
            keys = [hashlib.blake2b(t, digest_size=16).digest() if t else None for t in texts]
            for a, b in chunks(texts):
                sig = signatures(*weighted(Words(texts[a:b])), b - a)
                flat = pa.array(bands(sig).ravel())
                n = len(flat) // (b - a)
                yield pa.record_batch({
                    "uid": batch.column(0)[a:b], "doc_id": batch.column(1)[a:b], "th": batch.column(2)[a:b], "key": pa.array(keys[a:b], pa.binary()),
                    "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), flat),
                    "sig": pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, sig.shape[1]), pa.int32()), pa.array(sig.ravel().view(np.int32))),
                })
        forget()
        common.release()

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return common.written(rows.mapInArrow(run, "uid long, doc_id long, th long, key binary, bands array<long>, sig array<int>"), "signatures")


def _agree(a: str, b: str, least: int) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) >= least


def _near(pairs: DataFrame, sigs: DataFrame, agree: int) -> DataFrame:
    """Distinct pairs (a, b) whose signatures agree in enough registers."""
    return (
        pairs.distinct()
        .join(sigs.select(F.col("uid").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sigs.select(F.col("uid").alias("b"), F.col("sig").alias("sb")), "b")
        .where(_agree("sa", "sb", agree))
        .select("a", "b")
    )


def _sets(ids: DataFrame, reps: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """uid, set (hashes and weights of the shingles) of the classes in ids; only texts that may be theirs are shuffled."""
    wanted = common.written(reps.join(ids.distinct(), "uid").select("uid", F.coalesce("doc_id", F.lit(-1)).alias("_key"), "th"), "wanted", n)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_key"), F.xxhash64("text").alias("th"), "text")
    near, _ = common.parts(rows, "_key", wanted)
    texts = near.join(wanted, ["_key", "th"]).select("uid", "text").dropDuplicates(["uid"])

    @F.pandas_udf("binary")
    def shingled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            out = []
            canon = [canonical(t) for t in text]
            for a, b in chunks(canon):
                doc, h, w = weighted(Words(canon[a:b]))
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                out += [h[x:y].tobytes() + w[x:y].astype(np.uint32).tobytes() for x, y in zip(cut, cut[1:], strict=False)]
            yield pd.Series(out, dtype=object)
        forget()
        common.release()

    return common.written(texts.select("uid", shingled.asNondeterministic()("text").alias("set")), "sets", 10 * n)  # long rows


def _unpacked(s: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(s) // 12
    return np.frombuffer(s, np.uint64, n), np.frombuffer(s, np.uint32, n, n * 8)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose exact similarity is `least` or more."""
    sets = _sets(pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))), reps, docs, n)

    @F.pandas_udf("double")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([similarity(_unpacked(x), _unpacked(y)) for x, y in zip(a, b, strict=True)], dtype=float)
        common.release()

    both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("uid").alias("b"), F.col("set").alias("y")), "b")
    return common.written(both.select("a", "b", alike.asNondeterministic()("x", "y").alias("s")).where(F.col("s") >= least - 1e-9).select("a", "b"), "links", pairs.count())


def _tiles(crowded: DataFrame, sets: DataFrame, least: float, agree: int) -> DataFrame:
    """Links (a, b) between components, of classes outside their bucket's largest component with all others of it.

    Both sides of a tile are bounded, in classes and in bytes, and a tile gives fewer links than it holds components.
    """
    stray, size = F.col("root") != F.col("large"), F.octet_length("set").cast("long")
    sized = crowded.join(sets.select("uid", size.alias("size")), "uid").groupBy("band", "bucket").agg(F.count_if(stray).alias("strays"), F.count(F.lit(1)).alias("n"), F.sum(F.when(stray, F.col("size"))).alias("stray_bytes"), F.sum("size").alias("bytes"))
    sides = [F.ceil(F.greatest(F.col(k) / TILE[i], F.col(b) / TILE_BYTES[i])).cast("int").alias(c) for i, (k, b, c) in enumerate((("strays", "stray_bytes", "down"), ("n", "bytes", "across")))]
    rows = crowded.join(common.written(sized.select("band", "bucket", *sides), "tiled"), ["band", "bucket"]).join(sets, "uid")
    down, across = F.col("down"), F.col("across")
    part = lambda n, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), n).cast("int")
    cols, key = ["uid", "root", "sig", "set", "band", "bucket", "i", "j"], ["band", "bucket", "i", "j"]
    left = rows.where("root <> large").withColumn("i", part(down, 1)).withColumn("j", F.explode(F.sequence(F.lit(0), across - 1))).select(cols)
    right = rows.withColumn("j", part(across, 2)).withColumn("i", F.explode(F.sequence(F.lit(0), down - 1)))
    right = right.select([F.col(c).alias(f"{c}_") for c in cols])  # other names: both sides come from one table

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(x) and len(y):
            mine, theirs = [_unpacked(s) for s in x["set"]], [_unpacked(s) for s in y["set_"]]
            out = joined_by(np.stack(x["sig"].to_list()), np.stack(y["sig_"].to_list()), mine, theirs, *(c.to_numpy() for c in (x["uid"], y["uid_"], x["root"], y["root_"])), least, agree)
        return pd.DataFrame(out, columns=["a", "b"])

    return left.groupBy(key).cogroup(right.groupBy([f"{c}_" for c in key])).applyInPandas(run, "a long, b long")


def joined_by(sa, sb, mine: list, theirs: list, ua, ub, ra, rb, least: float, agree: int = 0) -> list[tuple[int, int]]:
    """Pairs (of ua, of ub) that are similar and join two of the components ra, rb, as few as will do."""
    hashes = np.concatenate([h for h, _ in [*mine, *theirs]])
    ids = np.unique(hashes, return_inverse=True)[1]
    sizes_a, sizes_b = (np.array([len(h) for h, _ in sets]) for sets in (mine, theirs))
    at_a = np.concatenate([[0], np.cumsum(sizes_a)])
    ids_a, ids_b = ids[:at_a[-1]], ids[at_a[-1]:]
    at_b = np.concatenate([[0], np.cumsum(sizes_b)[:-1]])
    plain_a, plain_b = (np.array([bool((w == 1).all()) for _, w in sets]) for sets in (mine, theirs))
    mark = np.zeros(ids.max() + 1, np.int32)
    parent: dict[int, int] = {}

    def find(r: int) -> int:
        while parent.setdefault(r, r) != r:
            r = parent[r]
        return r

    out = []
    for k in range(len(sa)):
        near = ((sb == sa[k]).sum(axis=1) >= agree) & (rb != ra[k])
        if not near.any():
            continue
        own = ids_a[at_a[k]:at_a[k + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids_b], at_b)
        mark[own] = 0
        if plain_a[k]:
            good = near & plain_b & (shared >= (least - 1e-9) * (sizes_a[k] + sizes_b - shared))
            rest = near & ~plain_b
        else:
            good, rest = np.zeros(len(near), bool), near.copy()
        for j in np.flatnonzero(rest & (shared > 0)).tolist():
            good[j] = find(int(rb[j])) != find(int(ra[k])) and similarity(mine[k], theirs[j]) >= least - 1e-9
        roots, first = np.unique(rb[good], return_index=True)
        places = np.flatnonzero(good)[first]
        for r, j in zip(roots.tolist(), places.tolist(), strict=True):
            x, y = find(int(ra[k])), find(r)
            if x != y:
                parent[x] = y
                out.append((int(ua[k]), int(ub[j])))
    return out


def classes(docs: DataFrame, least: float = LEAST, agree: int = AGREE) -> DataFrame:
    """uid, doc_id, th, class (a number), class_id (the least doc_id of the class), class_size, keep_uid.

    agree: registers in which signatures must agree before a pair is verified; 0 verifies every pair that shares a band.
    """
    rows = signed(docs)
    n = rows.count()
    per = REGISTERS // BAND * n  # rows of bands, at most
    groups = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("uid").alias("rep"))
    groups = common.written(groups, "groups", n)
    reps = rows.join(groups.select(F.col("rep").alias("uid")), "uid", "left_semi")
    members = common.written(reps.select("uid", F.posexplode("bands").alias("band", "bucket")), "bands", per)
    pivot = F.min(F.struct(F.xxhash64("uid", "band").alias("h"), "uid")).alias("pivot")
    buckets = members.groupBy("band", "bucket").agg(pivot, F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "bucket", F.col("pivot.uid").alias("lead"), "n")
    shared = common.written(members.join(buckets, ["band", "bucket"]).select("uid", "lead", "band", "bucket", "n"), "shared", per)
    sigs = reps.select("uid", "sig")
    stars = shared.where("uid <> lead").select(F.least("lead", "uid").alias("a"), F.greatest("lead", "uid").alias("b"))
    links = _verified(common.written(_near(stars, sigs, agree), "stars", per), reps, docs, n, least)
    roots = common.written(components(links, per), "roots", n)
    # with two classes in a bucket its one pair has been seen
    placed = shared.where("n > 2").join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "band", "bucket", "n", F.coalesce("root", "uid").alias("root"))
    each = placed.groupBy("band", "bucket", "root").agg(F.count(F.lit(1)).alias("m"))
    open_ = each.groupBy("band", "bucket").agg(F.max_by("root", "m").alias("large"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "bucket", "large")
    still = common.written(placed.join(open_, ["band", "bucket"]).join(sigs, "uid").select("uid", "root", "sig", "band", "bucket", "large", "n"), "open", per)
    few, crowded = still.where(F.col("n") <= SMALL), still.where(F.col("n") > SMALL).drop("n")
    left, right = (few.select(F.col("uid").alias(s), F.col("root").alias(f"r{s}"), F.col("sig").alias(f"s{s}"), "band", "bucket") for s in "ab")
    pairs = left.join(right, ["band", "bucket"]).where((F.col("ra") < F.col("rb")) & _agree("sa", "sb", agree)).select("a", "b")
    more = [_verified(common.written(pairs.distinct(), "pairs", SMALL * per), reps, docs, n, least)]
    if not crowded.isEmpty():
        more.append(common.written(_tiles(crowded, _sets(crowded.select("uid"), reps, docs, n), least, agree), "tiles"))
    more = reduce(DataFrame.unionByName, more)
    if not more.isEmpty():
        roots = components(links.unionByName(more), (SMALL + 1) * per)
    # written, so that Spark may split a hot key or class in the joins with them
    at = common.written(groups.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("class")), "at", n)
    placed = rows.select("uid", "doc_id", "th", "key").join(at, "key", "left").select("uid", "doc_id", "th", F.coalesce("class", "uid").alias("class"))
    placed = common.written(placed, "placed", n)
    sizes = placed.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("k"), F.count(F.lit(1)).alias("class_size"))
    sizes = common.written(sizes, "sizes", n)
    return placed.join(sizes, "class").select("uid", "doc_id", "th", "class", F.col("k.doc_id").alias("class_id"), F.col("class_size"), F.col("k.uid").alias("keep_uid"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    found = classes(common.table(spark, sf_dir, "documents"))
    common.restore(spark)
    return found.select("doc_id", "class_id", "class_size", (F.col("uid") == F.col("keep_uid")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the least doc_id stays, with all its columns.

    Only rows that may have to go are read into a shuffle.
    """
    common.prepare(spark)
    found = classes(docs)
    common.restore(spark)
    found = found.select(F.coalesce("doc_id", F.lit(-1)).alias("_key"), "th", (F.col("uid") == F.col("keep_uid")).alias("kept"))
    n = docs.count()
    found = common.written(found, "kept", n)
    gone = found.where("NOT kept").select("_key", "th").distinct()
    stays = found.where("kept").join(gone, ["_key", "th"]).select("_key", "th")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_key"), F.xxhash64("text").alias("th"))
    near, far = common.parts(row, "_key", gone.select("_key"))
    free = near.join(gone, ["_key", "th"], "left_anti")
    once = near.join(stays, ["_key", "th"], "left_semi").dropDuplicates(["_key", "th"])
    return far.select("row").unionByName(common.gathered(free.select("row").unionByName(once.select("row")), n)).select("row.*")


#: All pairs, exactly. What the signatures miss (see BAND) would differ; on the test tables they miss nothing.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
c AS (SELECT w, row_number() OVER () AS c FROM (SELECT DISTINCT w FROM d WHERE len(w) > 0)),
g AS (SELECT c, array_to_string(list_slice(w, i, i + 4), ' ') AS g, count(*)::DOUBLE AS n FROM c, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) GROUP BY ALL),
t AS (SELECT c, sum(n) AS n FROM g GROUP BY c),
m AS (SELECT a.c AS x, b.c AS y, a.g, a.n AS nx, b.n AS ny FROM g a JOIN g b ON a.g = b.g AND a.c < b.c),
p AS (SELECT x, y FROM m JOIN t tx ON tx.c = x JOIN t ty ON ty.c = y GROUP BY x, y HAVING sum(least(nx / tx.n, ny / ty.n)) >= 0.8 - 1e-9),
u AS (SELECT x, y, g, max(nx) AS nx, max(ny) AS ny FROM (SELECT x, y, g, n AS nx, 0 AS ny FROM p JOIN g ON g.c = x UNION ALL SELECT x, y, g, 0, n FROM p JOIN g ON g.c = y) GROUP BY x, y, g),
j AS (SELECT i.x, i.y, i.g, sum(greatest(o.nx / i.nx, o.ny / i.ny)) AS s FROM u i JOIN u o ON i.x = o.x AND i.y = o.y WHERE i.nx > 0 AND i.ny > 0 GROUP BY ALL),
l AS (SELECT x, y FROM j GROUP BY x, y HAVING sum(1 / s) >= 0.8 - 1e-9),
e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
r AS (SELECT c AS node, c AS seen FROM c UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node),
k AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN (SELECT min(seen) FROM r WHERE r.node = c.c) ELSE -doc_id - 1 END AS class FROM d LEFT JOIN c USING (w)),
z AS (SELECT class, min(doc_id) AS class_id, count(*) AS class_size FROM k GROUP BY class)
SELECT doc_id, class_id, class_size, doc_id = class_id AS kept FROM k JOIN z USING (class)
"""
