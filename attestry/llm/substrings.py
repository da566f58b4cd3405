"""Removal of repeated passages by super-k-mer partitioning (operator 6).

A window is 50 consecutive words. Its minimiser is the least hash of the 8-word runs in it; consecutive windows with
one minimiser make a super-k-mer, which travels as one packed string to the bucket of its minimiser, where sorting
brings equal windows together.

1. Minimisers of all documents are aggregated: one that a single document has can't bring windows of two documents
   together, and its super-k-mers stay at home. The others are kept in a bitmap of fixed size, so some that needn't
   may travel too. Minimisers that a large part of the documents has are listed (a bounded list): their windows take
   the least of the rarer 8-word runs instead, so that a common line doesn't draw a third of the corpus to one bucket.
2. Super-k-mers that travel are packed once for each distinct string and task, with the smallest and largest doc_id.
3. Buckets sort the windows of their strings, and find for each distinct string which of its windows a smaller document
   has. A minimiser with more strings than a bucket should hold has no bucket: the windows of its strings travel each
   for itself and are aggregated by Spark, so no minimiser is a task's fate.
4. Occurrences are joined to that by the string's digest (a skewed join that Spark may split), gathered for each
   document, and applied to its words.

In a bucket windows are equal if all their words are. Strings, and windows that travel alone, are told apart by keyed
BLAKE2b digests of 128 bits: two different ones of n are taken for equal with a probability of n**2 / 2**129.

Defined results: a null text has no words; rows without doc_id neither lend nor lose windows; rows repeated with one
doc_id don't remove each other's words; texts are read whole, however long; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import Words, chunks, forget, mixed, slices, sums

WINDOW, MINIMISER = 50, 8
#: Positions of the bitmap of shared minimisers (16 MB).
BITS = 27
#: A minimiser with more than one in HOT of all super-k-mers is hot: at most HOT of them.
HOT, HOT_LEAST = 2_000, 100
#: Rows of a bucket, about, and rows that a minimiser may always have there; strings that a task holds back to pack equal ones once.
BUCKET, FEW, HELD = 20_000, 128, 40_000


def canonical(text: str | None) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").split()) if text else b""


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        a = np.minimum(a[:len(a) - width], a[width:])
        width *= 2
    return np.minimum(a[:len(a) - (n - width)], a[n - width:]) if n > width else a


def minimisers(words: Words, hot: np.ndarray | None = None, window: int = WINDOW, size: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window that lies in one text: its first word, its minimiser, and the one it travels by."""
    empty = np.zeros(0, np.int64)
    if len(words.starts) < window:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64)
    grams = words.grams(size)
    plain = sliding_min(grams, window - size + 1)
    at = np.flatnonzero(words.doc[:len(plain)] == words.doc[window - 1:window - 1 + len(plain)])
    travel = plain
    if hot is not None and len(hot):
        i = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        rare = np.where(hot[i] == grams, np.uint64(2**64 - 1), grams)
        second = sliding_min(rare, window - size + 1)
        i = np.minimum(np.searchsorted(hot, plain), len(hot) - 1)
        travel = np.where((hot[i] == plain) & (second != np.uint64(2**64 - 1)), second, plain)
    return at, plain[at], travel[at]


def runs(words: Words, at: np.ndarray, plain: np.ndarray, travel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end, in the windows given, of each super-k-mer."""
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (travel[1:] != travel[:-1]) | (plain[1:] != plain[:-1]) | (at[1:] != at[:-1] + 1) | (words.doc[at[1:]] != words.doc[at[:-1]])
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], len(at))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, list]]:
    for batch in slices(batches):
        ids, hashes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        texts = [canonical(t) for t in batch.column(2).to_pylist()]
        for a, b in chunks(texts):
            yield Words(texts[a:b]), ids[a:b], hashes[a:b]


def _shared(rows: DataFrame, window: int, size: int) -> tuple[DataFrame, int]:
    """(minimiser, n) of minimisers that two documents have; and the number of (minimiser, document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ids, _ in _batches(batches):
            at, plain, _t = minimisers(words, None, window, size)
            begin, _e = runs(words, at, plain, plain)
            v, d = plain[begin].view(np.int64), ids[words.doc[at[begin]]]
            yield pa.record_batch({"v": pa.array(v), "doc_id": pa.array(d, pa.int64())})
        forget()
        common.release()

    seen = rows.mapInArrow(run, "v long, doc_id long").groupBy("v").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    table = common.written(seen.groupBy((F.col("lo") < F.col("hi")).alias("shared"), F.when(F.col("lo") < F.col("hi"), F.col("v")).alias("v")).agg(F.sum("n").alias("n")), "minimisers")
    total = table.agg(F.sum("n")).first()[0] or 0
    return table.where("shared").select("v", "n"), total


def _bitmap(shared: DataFrame, bits: int) -> np.ndarray:
    """One bit for each position, set if a shared minimiser falls on it: 2**bits / 8 bytes at the driver."""
    low = F.col("v").bitwiseAND(F.lit((1 << bits) - 1))
    rows = shared.select(F.shiftright(low, 15).alias("b"), low.bitwiseAND(F.lit(32767)).cast("int").alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).toLocalIterator()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["b"] * 4096:r["b"] * 4096 + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def _pack(rows: DataFrame, bitmap, hot, bits: int, window: int, size: int) -> DataFrame:
    """Occurrences (digest, doc_id, th, start, n) and packed strings (v, digest, lo, hi, words) in one table."""
    schema = pa.schema([("v", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("hi", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])

    def packed(held: dict) -> pa.RecordBatch:
        n = len(held)
        rows = list(held.values())
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array(held, pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array([r[3] for r in rows], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_set, rare = bitmap.value, hot.value
        held: dict[bytes, list] = {}
        for words, ids, hashes in _batches(batches):
            at, plain, travel = minimisers(words, rare, window, size)
            begin, end = runs(words, at, plain, travel)
            low = (plain[begin] & np.uint64((1 << bits) - 1)).astype(np.int64)
            go = (bits_set[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0
            begin, end = begin[go], end[go]
            first, count = at[begin], end - begin
            doc = words.doc[first]
            a, b = words.starts[first].tolist(), words.ends[first + count + window - 2].tolist()
            v, d = travel[begin].view(np.int64).tolist(), ids[doc].tolist()
            digests = []
            for i in range(len(a)):
                s = words.buffer[a[i]:b[i]]
                h = hashlib.blake2b(s, digest_size=16, key=v[i].to_bytes(8, "little", signed=True)).digest()
                digests.append(h)
                old = held.get(h)
                if old is None:
                    held[h] = [v[i], d[i], d[i], s]
                else:
                    old[1], old[2] = min(old[1], d[i]), max(old[2], d[i])
            n = len(digests)
            th = [hashes[x] for x in doc.tolist()]
            yield pa.record_batch([pa.nulls(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(d, pa.int64()), pa.nulls(n, pa.int64()), pa.array(th, pa.int64()), pa.array(first - words.first[doc], pa.int32()), pa.array(count, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
            if len(held) >= HELD:
                yield packed(held)
                held = {}
        if held:
            yield packed(held)
        del held
        forget()
        common.release()

    return common.written(rows.mapInArrow(run, "v long, digest binary, doc_id long, hi long, th long, start int, n int, words binary"), "superkmers")


def ranks(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A number for each window ids[at:at + window], equal for equal windows only, by sorting them.

    They are sorted by a hash, and neighbours of one hash compared word by word; should two differ, windows are ranked
    by sorting ever longer runs of words instead.
    """
    values = mixed(ids.astype(np.uint64) + np.uint64(1))
    h = sums(values, at, at + window, 0xA24BAED4963EE407)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    same, places = np.flatnonzero(~new), np.arange(window)
    for i in range(0, len(same), 1 << 14):
        k = same[i:i + (1 << 14)]
        if (ids[at[order[k]][:, None] + places] != ids[at[order[k - 1]][:, None] + places]).any():
            return _ranks_by_doubling(ids, window)[at]
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _ranks_by_doubling(ids: np.ndarray, window: int) -> np.ndarray:
    rank, width = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while width < window:
        step = min(width, window - width)
        rank = np.unique(rank[:len(rank) - step] * (rank.max() + 1) + rank[step:], return_inverse=True)[1].astype(np.int64)
        width += step
    return rank


def earlier(strings: list[bytes], lo: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each string (words joined by one space) and each of its windows, whether one with a smaller lo has it."""
    words = pc.split_pattern(pa.array(strings, pa.large_binary()), b" ")
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    n = np.maximum(0, counts - window + 1)
    owner, ends = np.repeat(np.arange(len(strings)), n), np.cumsum(n)
    at = np.arange(len(owner)) - np.repeat(ends - n, n) + np.repeat(np.cumsum(counts) - counts, n)
    if not len(at):
        return [np.zeros(0, bool) for _ in strings]
    rank = ranks(ids, at, window)
    least = np.full(rank.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, lo[owner])
    return np.split(least[rank] < lo[owner], ends[:-1])


def _bucket(window: int):
    """For each distinct string that needs it: the smallest doc_id, and which windows a still smaller document has."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.groupby("digest", sort=False).agg(lo=("doc_id", "min"), hi=("hi", "max"), words=("words", "first"))
        masks = earlier([bytes(x) for x in rows["words"]], rows["lo"].to_numpy(np.int64), window)
        out = []
        for h, lo, hi, mask in zip(rows.index, rows["lo"], rows["hi"], masks, strict=True):
            if mask.any():
                out.append((h, lo, np.packbits(mask, bitorder="little").tobytes()))
            elif lo < hi:
                out.append((h, lo, None))
        return pd.DataFrame(out, columns=["digest", "lo", "mask"])

    return run


def _crowded(strings: DataFrame, window: int) -> DataFrame:
    """The same as buckets find, for strings whose windows travel each for itself."""
    strings = common.written(strings.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("hi").alias("hi"), F.first("words").alias("words")), "crowded")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, los, at, windows = [], [], [], []
            for h, lo, s in zip(*(batch.column(c).to_pylist() for c in ("digest", "lo", "words")), strict=True):
                words = s.split(b" ")
                for i in range(len(words) - window + 1):
                    windows.append(hashlib.blake2b(b" ".join(words[i:i + window]), digest_size=16).digest())
                    digests.append(h)
                    los.append(lo)
                    at.append(i)
            yield pa.record_batch({"digest": pa.array(digests, pa.binary()), "lo": pa.array(los, pa.int64()), "i": pa.array(at, pa.int32()), "w": pa.array(windows, pa.binary())})

    windows = common.written(strings.select("digest", "lo", "words").mapInArrow(cut, "digest binary, lo long, i int, w binary"), "windows")
    least = windows.groupBy("w").agg(F.min("lo").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "least")
    found = windows.join(common.written(least, "least"), "w").where("least < lo").groupBy("digest").agg(F.collect_list("i").alias("at"))

    @F.pandas_udf("binary")
    def mask(at: pd.Series) -> pd.Series:
        out = []
        for x in at:
            bits = np.zeros(max(x) + 1, bool)
            bits[np.asarray(x)] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return pd.Series(out, dtype=object)

    masks = found.select("digest", mask.asNondeterministic()("at").alias("mask"))
    return strings.join(masks, "digest", "left").where("mask IS NOT NULL OR lo < hi").select("digest", "lo", "mask")


def covered(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER, bits: int = BITS, hot_share: int = HOT, hot_least: int = HOT_LEAST, bucket: int = BUCKET, few: int = FEW) -> DataFrame:
    """doc_id, th, found: windows to remove, as a list of (start, n, mask), for each document that loses words."""
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    shared, total = _shared(rows, window, size)
    hot = np.array([r["v"] for r in shared.where(F.col("n") >= max(hot_least, total // hot_share)).select("v").collect()], dtype=np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(_bitmap(shared, bits)), spark.sparkContext.broadcast(np.sort(hot))
    table = _pack(rows, *sent, bits, window, size)
    strings = table.where("words IS NOT NULL")
    strings = strings.select("v", "digest", "doc_id", "hi", "words")
    n = strings.count()
    buckets = max(common.partitions(spark), n // bucket)
    crowds = common.written(strings.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(few, n // buckets)).select("v"), "crowds")
    calm = strings.join(crowds, "v", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(buckets)))
    found = calm.groupBy("bucket").applyInPandas(_bucket(window), "digest binary, lo long, mask binary")
    if not crowds.isEmpty():
        found = found.unionByName(_crowded(strings.join(crowds, "v", "left_semi"), window))
    seen = table.where("words IS NULL").select("digest", "doc_id", "th", "start", "n")
    hits = seen.join(found, "digest").where("doc_id > lo OR mask IS NOT NULL")
    hits = hits.select("doc_id", "th", F.struct("start", "n", F.when(F.col("doc_id") == F.col("lo"), F.col("mask")).alias("mask")).alias("hit"))
    return common.written(hits.groupBy("doc_id", "th").agg(F.collect_list("hit").alias("found")), "covered")


def removed_words(n: int, found, window: int = WINDOW) -> np.ndarray:
    """True for each of n words that is covered."""
    change = np.zeros(n + 1, np.int64)
    for x in found if found is not None else ():
        start, count, mask = x["start"], x["n"], x["mask"]
        if mask is None:
            change[start] += 1
            change[start + count + window - 1] -= 1
        else:
            at = start + np.flatnonzero(np.unpackbits(np.frombuffer(bytes(mask), np.uint8), bitorder="little")[:count])
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
    return np.cumsum(change[:n]) > 0


def kept_words(text: str | None, found, window: int = WINDOW) -> tuple[int, int, bytes]:
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if found is None or not len(found):
        return len(words), 0, b" ".join(words)
    gone = removed_words(len(words), found, window)
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def cleaned(docs: DataFrame, window: int = WINDOW, texts: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with `texts` also the kept text."""
    fields = "n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts

    @F.pandas_udf(fields)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, found in batches:
            rows = []
            for t, f in zip(text, found, strict=True):
                n, gone, kept = kept_words(t, f, window)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] * texts)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in fields.split(", ")])
        common.release()

    spans = covered(docs, window, **options)
    mine = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    near, far = common.parts(mine.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))), "_key", spans.select(F.col("doc_id").alias("_key")))
    near = near.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "found")
    far = far.select("doc_id", "text", F.lit(None).cast(spans.schema["found"].dataType).alias("found"))
    return near.unionByName(far).select("doc_id", run.asNondeterministic()("text", "found").alias("r")).select("doc_id", "r.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return cleaned(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS win FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
f AS (SELECT win, min(doc_id) AS lo FROM k GROUP BY win),
g AS (SELECT doc_id, i, 1 AS gone FROM k JOIN f USING (win) WHERE lo < doc_id),
s AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
c AS (SELECT doc_id, i, word, coalesce(max(gone) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING), 0) AS gone FROM s LEFT JOIN g USING (doc_id, i)),
a AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
