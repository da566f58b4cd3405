"""Toxicity by a weighted lexicon (operator 1).

Text is folded (compatibility forms, look-alike letters, digits standing for letters) and matched by an Aho-Corasick
automaton. Entries are beginnings of words, so inflected forms match too. The weights of matches outside exception
phrases are summed, set against the number of words, and turned into a score by a logistic curve. Lexicon, exceptions
and curve are learned from a bounded sample of labelled rows; rows whose crc32(doc_id) mod 5 is 0 are held out.

An entry's support is the number of different words before its first place in a text, so copies count once.

Defined results: null and empty texts score as texts without matches; texts are read whole, in time that grows little
faster than their length; without labels the seed lexicon and a fixed curve hold; labels repeated for a doc_id count as
toxic if one says so; rows repeated with one doc_id are scored each for itself; a score of exactly 0.5 is toxic; an
empty table gives an empty result; other columns are ignored (the stage keeps them).
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a model is learned from, about (chosen by hash of doc_id).
SAMPLE = 12_000
#: Different words before it that an entry needs in toxic rows, the least log odds, and the least support times odds.
SUPPORT, LEAST, EVIDENCE = 4, 2.0, 24.0
#: Letters of an entry: longer words are found by their first LONG letters.
SHORT, LONG = 3, 12
#: Most entries and phrases; none: all that the sample gives evidence for.
LEXICON, EXCEPTIONS = None, None
#: Of the bitmap of words that are sought in clean rows.
PLACES = 24
#: Used where there are no labels.
SEED = {w: 4.0 for w in ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting")}
SEED_CURVE = (-3.0, 2.0, 1.0)

#: Letters taken for Latin ones.
ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i",
}
#: Digits taken for letters; l, i, 1 and | fold together, as any of them may stand for another.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "l": "i", "|": "i"}
SIGNS = {"$": "s", "@": "a", "!": "i"}
_inside = re.compile(r"[$@!](?=[^\W_])")
_hidden = re.compile("[­​-‏⁠﻿]")
_ascii = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord(k): v for k, v in DIGITS.items()}
_wide: dict[int, str] = dict(_ascii)
for _c, _l in ALIKE.items():
    _wide[ord(_c)] = "".join(DIGITS.get(x, x) for x in _l)


class _Wide(dict):
    """Letters and digits stay, marks that compose with no letter go, anything else is a space."""

    def __missing__(self, c):
        s = chr(c)
        got = s if s.isalnum() else "" if unicodedata.combining(s) else " "
        self[c] = got
        return got


_table = _Wide(_wide)


def fold(text: str) -> str:
    """Folded words, a space around each."""
    if not text:
        return " "
    if text.isascii():
        text = text.lower()
        if "$" in text or "@" in text or "!" in text:
            text = _inside.sub(lambda m: SIGNS[m[0]], text)
        return f" {' '.join(text.translate(_ascii).split())} "
    text = unicodedata.normalize("NFKC", _hidden.sub("", text)).lower()
    if "$" in text or "@" in text or "!" in text:
        text = _inside.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(_table).split())} "


@dataclass
class Model:
    lexicon: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = SEED_CURVE

    def automaton(self):
        a = ahocorasick.Automaton()
        for w, weight in self.lexicon.items():
            a.add_word(f" {w}", (len(w), weight))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 1, 0.0))
        a.make_automaton()
        return a


def measure(automaton, text: str) -> tuple[float, int]:
    """Summed weights outside exception phrases, and the number of words."""
    folded = fold(text)
    words = max(0, folded.count(" ") - 1)
    if not len(automaton) or not words:
        return 0.0, words
    found = [(end - n, end, w) for end, (n, w) in automaton.iter(folded)]
    if not found:
        return 0.0, words
    safe = sorted((a, b) for a, b, w in found if not w)
    begins, reach = [a for a, _ in safe], list(accumulate((b for _, b in safe), max))  # the farthest end of those that begin so far
    return sum(w for a, b, w in found if w and not ((i := bisect_right(begins, a)) and reach[i - 1] >= b)), words


def features(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(100 * weight / max(1, words)), math.log1p(weight)


def score(curve: tuple[float, float, float], weight: float, words: int) -> float:
    a, b = features(weight, words)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, curve[0] + curve[1] * a + curve[2] * b))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(toxic, text) of about `sample` labelled rows that aren't held out. The ids sent to all tasks are bounded by it."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    got = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))
    return common.written(got, "labelled")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = labelled(docs, labels, sample)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model(dict(_folded_seed()))
    return _curve(rows, _exceptions(rows, Model(_lexicon(rows, bad, good))))


def _folded_seed() -> dict[str, float]:
    return {fold(w).strip(): v for w, v in SEED.items()}


def _lexicon(rows: DataFrame, bad: int, good: int) -> dict[str, float]:
    def begun(wanted: np.ndarray | None):
        @F.pandas_udf("array<string>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                out = []
                for t in texts:
                    words, got = fold(t).split(), {}
                    for p, w in zip(["", *words], words, strict=False):
                        if w in got:
                            continue
                        got[w] = p
                    seen = {}
                    for w, p in got.items():
                        for n in range(SHORT, min(LONG, len(w)) + 1):
                            seen.setdefault(w[:n], p)
                    out.append([f"{w} {p}" for w, p in seen.items() if wanted is None or wanted[(at := zlib.crc32(w.encode("utf-8", "surrogatepass")) & (1 << PLACES) - 1) >> 3] >> (at & 7) & 1])
                yield pd.Series(out)
            common.release()

        return run

    def support(part: DataFrame, wanted: np.ndarray | None, name: str) -> DataFrame:
        pairs = part.select(F.explode(begun(wanted)("text")).alias("pair")).distinct()
        return pairs.groupBy(F.substring_index("pair", " ", 1).alias("word")).agg(F.count(F.lit(1)).alias(name))

    def odds(n, clean, log):
        return log((n + 0.5) / (bad + 1)) - log((clean + 0.5) / (good + 1))

    def enough(clean: Column) -> Column:
        x = odds(F.col("n"), clean, F.log)
        return (x >= LEAST) & (F.col("n") * x >= EVIDENCE)

    # what would have too little evidence even if no clean row had it needn't be sought there
    top = common.written(support(rows.where("toxic = 1"), None, "n").where(F.col("n") >= SUPPORT).where(enough(F.lit(0))), "beginnings")
    clean = support(rows.where("toxic = 0"), _places(top), "clean")
    strong = top.join(clean, "word", "left").fillna(0, ["clean"]).where(enough(F.col("clean")))
    strong = strong.orderBy(F.desc(F.col("n") * odds(F.col("n"), F.col("clean"), F.log)), F.desc(F.length("word")), "word")
    chosen: dict[str, float] = {}
    taken: set[str] = set()  # beginnings of chosen entries
    for r in strong.toLocalIterator():  # no more of it on the driver than a partition
        w = r["word"]
        if w not in taken and not any(w[:n] in chosen for n in range(SHORT, len(w) + 1)):
            chosen[w] = odds(r["n"], r["clean"], math.log)
            taken |= {w[:n] for n in range(SHORT, len(w) + 1)}
            if len(chosen) == LEXICON:
                break
    return chosen or _folded_seed()


def _places(words: DataFrame) -> np.ndarray:
    """A bitmap of the words' crc32: 2**PLACES bits whatever their number. What it lets through too much is dropped by a join."""
    at = F.crc32(F.col("word").cast("binary")).bitwiseAND(F.lit((1 << PLACES) - 1))
    out = np.zeros(1 << PLACES - 3, np.uint8)
    bits = words.groupBy(F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767)).cast("int")).alias("bits"))
    for r in bits.collect():  # 2**PLACES bits in all at most
        out[r["bucket"] * 4096:(r["bucket"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _exceptions(rows: DataFrame, model: Model) -> Model:
    """Two-word phrases around a lexicon word that clean rows have at least three times, and nine times as often."""
    lexicon = set(model.lexicon)

    @F.pandas_udf("array<string>")
    def phrases(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                words, got = fold(t).split(), set()
                for i, w in enumerate(words):
                    if any(w[:n] in lexicon for n in range(SHORT, min(LONG, len(w)) + 1)):
                        got |= {" ".join(words[i - 1:i + 1])} if i else set()
                        got |= {" ".join(words[i:i + 2])} if i + 1 < len(words) else set()
                out.append(list(got))
            yield pd.Series(out)
        common.release()

    seen = rows.select("toxic", F.explode(phrases("text")).alias("phrase")).groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    often = seen.where("good >= 3 AND good >= 9 * bad").orderBy(F.desc("good"), "phrase")
    model.exceptions = [r["phrase"] for r in (often.limit(EXCEPTIONS) if EXCEPTIONS else often).toLocalIterator()]
    return model


def _curve(rows: DataFrame, model: Model) -> Model:
    @F.pandas_udf("weight double, words long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for texts in batches:
            yield pd.DataFrame([measure(automaton, t) for t in texts], columns=["weight", "words"])
        del automaton
        common.release()

    got = rows.select("toxic", run.asNondeterministic()("text").alias("r")).select("toxic", "r.*").collect()  # about SAMPLE rows at most
    x = np.array([[1.0, *features(r["weight"], r["words"])] for r in got])
    y = np.array([r["toxic"] for r in got], dtype=float)
    theta = np.zeros(3)
    ridge = np.diag([1e-6, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ theta)
        theta += step
        if np.abs(step).max() < 1e-8:
            break
    model.curve = tuple(float(v) for v in theta)
    return model


def scorer(model: Model):
    """Column function: the score of each text."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.automaton()
        for texts in batches:
            yield pd.Series([score(model.curve, *measure(automaton, t or "")) for t in texts], dtype=float)
        del automaton
        common.release()

    return run.asNondeterministic()


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score 0.5 or more go."""
    common.prepare(spark)
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    keep = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), scorer(model)("text").alias("s"))
    return keep.where("s < 0.5").select("row.*")
