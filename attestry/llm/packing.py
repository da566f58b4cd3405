"""Best-fit packing by large-item matching (operator 9).

A document longer than a sequence is cut into full sequences and a first piece that may be shorter. Only these first
pieces compete for room, and only their lengths matter, so the plan is made from a histogram: at most ``capacity``
counts, whatever the number of documents. Pieces above a third of the capacity pair at most twice in a bin, the
longest with the longest that still fits; shorter ones go, longest first, to the bin they fill best. A plan is a list
of runs (length, ranks, bins, offset); each piece finds its place by its rank among pieces of its length. Ranks are
counted within salted groups, so no length is gathered in one task.

Defined results: a null text counts as empty (its only id is 0); repeated rows are packed each for itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import PLAIN, Memory, byte_letters, plain_classes

CAPACITY = 2048
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same for plain ASCII, where it is read twice as fast; texts of Latin letters have one of their own.
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class ByteCodec:
    """Ids of byte-level pieces by the tokenizers library, each distinct piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        self.tok = tok
        self.special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        letters, numbers, space = plain_classes()
        self.wide, self.ascii, self.plain = regex.compile(PATTERN).findall, re.compile(ASCII).findall, re.compile(f"[{PLAIN}]*").fullmatch
        self.latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        model = tok.model
        self.tokenize = model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.memory = Memory(self._piece)

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def pieces(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.latin(text) if self.plain(text) else self.wide(text)

    def encode(self, text: str) -> bytes:
        memory = self.memory
        if "<|" not in text:
            return b"".join([memory[p] for p in self.pieces(text)])
        out = []
        for k, part in enumerate(self.split(text)):
            out += [self.special[part].to_bytes(4, "little")] if k % 2 else [memory[p] for p in self.pieces(part)]
        return b"".join(out)


_codecs: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    if path not in _codecs:
        _codecs[path] = ByteCodec(path)
    return _codecs[path]


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, n (ids with the closing 0), crcs (of each piece's ids)."""

    @F.pandas_udf("n long, crcs array<long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for texts in parts:
            rows = []
            for t in texts:
                ids = c.encode(t or "") + b"\0\0\0\0"
                cut = (len(ids) // 4 - 1) % capacity + 1
                rows.append((len(ids) // 4, [zlib.crc32(ids[:cut * 4]), *(zlib.crc32(ids[k:k + capacity * 4]) for k in range(cut * 4, len(ids), capacity * 4))]))
            yield pd.DataFrame(rows, columns=["n", "crcs"])
        c.memory.forget()
        common.release()

    return docs.select("doc_id", run.asNondeterministic()(F.col("text")).alias("_r")).select("doc_id", "_r.n", "_r.crcs")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first bin, pieces in a bin, offset) and the number of bins.

    The size of the work is bounded by the number of different lengths.
    """
    left, runs, bins = Counter({k: v for k, v in counts.items() if v}), [], 0
    used: Counter = Counter()
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: groups (first bin, number of bins)

    def put(length: int, count: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], count, first, each, offset))
        used[length] += count

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] - (x == a) > 0), None)
            if b is None:
                m = left[a]
                put(a, m, bins, 1, 0)
                gaps.setdefault(capacity - a, []).append((bins, m))
                left[a] = 0
            elif a == b:
                m = left[a] // 2
                put(a, 2 * m, bins, 2, 0)
                gaps.setdefault(capacity - 2 * a, []).append((bins, m))
                left[a] -= 2 * m
            else:
                m = min(left[a], left[b])
                put(a, m, bins, 1, 0)
                put(b, m, bins, 1, a)
                gaps.setdefault(capacity - a - b, []).append((bins, m))
                left[a] -= m
                left[b] -= m
            bins += m
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        need = left[a]
        while need:
            gap = min((g for g, x in gaps.items() if g >= a and x), default=None)
            if gap is None:
                m = -(-need // (capacity // a))
                gaps.setdefault(capacity, []).append((bins, m))
                bins += m
                continue
            first, m = gaps[gap].pop()
            each = gap // a
            full = min(m, need // each)
            if full:
                put(a, full * each, first, each, capacity - gap)
                gaps.setdefault(gap - each * a, []).append((first, full))
                need -= full * each
            if full < m:
                first, m = first + full, m - full
                if need and need < each:
                    put(a, need, first, need, capacity - gap)
                    gaps.setdefault(gap - need * a, []).append((first, 1))
                    first, m, need = first + 1, m - 1, 0
                if m:
                    gaps.setdefault(gap, []).append((first, m))
            gaps = {g: x for g, x in gaps.items() if x}
    return runs, bins


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """RESULT's columns, one row for each piece."""
    spark = docs.sparkSession
    path = path or common.tokenizer_path("byte_bpe_50k.json")
    rows = common.written(tokenised(docs, path, capacity).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    rows = rows.withColumn("first", ((F.col("n") - 1) % capacity + 1).cast("int"))
    salts = max(16, common.partitions(spark))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    by = rows.groupBy("first", "salt").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("most"))
    by = common.written(by, "lengths", capacity * salts)
    sums = by.groupBy("first").agg(F.sum("c").alias("c"), F.max("most").alias("most")).collect()  # at most `capacity` rows
    if not sums:
        return spark.createDataFrame([], RESULT)
    runs, bins = plan({r["first"]: r["c"] for r in sums}, capacity)
    pieces = max(r["most"] for r in sums) // capacity + 1
    before = by.withColumn("base", F.sum("c").over(Window.partitionBy("first").orderBy("salt")) - F.col("c")).select("first", "salt", "base")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("first", "salt").orderBy("uid")) - 1)
    ranked = ranked.join(before, ["first", "salt"]).withColumn("rank", F.col("_r") + F.col("base"))
    length_base, at = {}, 0
    for r in sorted(sums, key=lambda r: r["first"]):
        length_base[r["first"]], at = at, at + r["c"]
    book: dict[int, np.ndarray] = {}
    for length in length_base:
        book[length] = np.array(sorted(r[1:] for r in runs if r[0] == length), dtype=np.int64)
    sent = spark.sparkContext.broadcast((book, length_base, bins, pieces))  # bounded by the capacity

    @F.pandas_udf("sequence_id long, offset long, own long")
    def place(first: pd.Series, rank: pd.Series) -> pd.DataFrame:
        book, base, bins, pieces = sent.value
        seq, off, own = np.empty(len(first), np.int64), np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        f, r = first.to_numpy(), rank.to_numpy().astype(np.int64)
        for length in np.unique(f):
            m = np.flatnonzero(f == length)
            x = book[int(length)]
            run = x[np.searchsorted(x[:, 0], r[m], side="right") - 1]
            k = r[m] - run[:, 0]
            seq[m] = run[:, 2] + k // run[:, 3]
            off[m] = run[:, 4] + k % run[:, 3] * int(length)
            own[m] = bins + (base[int(length)] + r[m]) * pieces
        return pd.DataFrame({"sequence_id": seq, "offset": off, "own": own})

    placed = ranked.withColumn("_p", place.asNondeterministic()("first", "rank"))
    each = placed.select("doc_id", "first", "_p", F.posexplode("crcs").alias("piece", "ids_crc32"))
    head = F.col("piece") == 0
    return each.select(
        "doc_id",
        "piece",
        F.when(head, 0).otherwise(F.col("first") + (F.col("piece") - 1) * capacity).cast("long").alias("start"),
        F.when(head, F.col("first")).otherwise(capacity).cast("long").alias("length"),
        "ids_crc32",
        F.when(head, F.col("_p.sequence_id")).otherwise(F.col("_p.own") + F.col("piece")).alias("sequence_id"),
        F.when(head, F.col("_p.offset")).otherwise(0).cast("long").alias("offset"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return packed(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where each piece of each document goes."""
    common.prepare(spark)
    return packed(docs)
