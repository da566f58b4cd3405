"""Secret scan by patterns and a battery of randomness tests (operator 4).

Fixed patterns give the base spans. Besides them, long runs of key characters are candidates: their encoding is
inferred from the characters used; a chi-squared statistic of uniformity over that alphabet is held against what
ordinary language of that length would show, and the shares of capitals, small letters and digits, the runs and the
serial correlation must not contradict randomness. The resulting p-values of all candidates of the corpus, weighted by length, go through the
Benjamini-Hochberg procedure: only a histogram of them, of fixed size, is gathered.

Defined results: a null text counts as empty and has no spans; texts are scanned whole, however long; offsets are code
points; of p-values on the threshold all are discoveries; repeated rows are scanned each for itself, and count each among
the candidates; an empty table gives an empty result; other columns are ignored (the stage keeps them).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed patterns of the query.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: the same as runs of any length with the short ones dropped
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Discovery rate; least p-value of the runs and correlation tests.
RATE, CONTRADICTS = 0.01, 0.001
#: Chance that two letters of ordinary text are equal, and that two of its hexadecimal letters are.
LANGUAGE, LANGUAGE_HEX = 0.0667, 0.12
BINS, STEP, LENGTHS = 400, 0.1, 32

_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of what is secret), sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding(token: str) -> tuple[str, str]:
    """The inferred encoding's name, and the token in its alphabet."""
    core = token.rstrip("=").replace("-", "+").replace("_", "/")
    if re.fullmatch(r"[0-9a-f]*|[0-9A-F]*", core):
        return "hex", core.lower()
    if re.fullmatch(r"[A-Z2-7]*", core):
        return "base32", core
    if re.fullmatch(r"[0-9a-z]*|[0-9A-Z]*", core):
        return "alnum", core.lower()
    return "base64", core


def normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def battery(token: str) -> float:
    """A p-value against 'ordinary language'; 1 if the other tests contradict randomness."""
    name, core = encoding(token)
    alphabet = _ALPHABETS[name]
    k, n = len(alphabet), len(core)
    if n < 16:
        return 1.0
    v = [alphabet.find(c) for c in core]
    if min(v) < 0:
        return 1.0
    if shares(core, name) < CONTRADICTS:
        return 1.0
    counts = np.bincount(v, minlength=k)
    chi = float((counts * counts).sum()) * k / n - n
    excess = n * (k * (LANGUAGE_HEX if name == "hex" else LANGUAGE) - 1)
    p = normal_below((chi - (k - 1 + excess)) / math.sqrt(2 * (k - 1 + 2 * excess)))
    # runs of the alphabet's upper and lower half
    up = [x >= k // 2 for x in v]
    a = sum(up)
    b = n - a
    if not a or not b:
        return 1.0
    runs = 1 + sum(x != y for x, y in zip(up, up[1:], strict=False))
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    if var <= 0 or 2 * normal_below(-abs((runs - mean) / math.sqrt(var))) < CONTRADICTS:
        return 1.0
    x = np.array(v, float) - sum(v) / n
    spread = float((x * x).sum())
    if not spread or 2 * normal_below(-abs(float((x[:-1] * x[1:]).sum()) / spread * math.sqrt(n))) < CONTRADICTS:
        return 1.0
    return max(p, 1e-39)


def shares(core: str, name: str) -> float:
    """p-value of the kinds of characters being there in proportion to their number in the alphabet."""
    digits = sum(c.isdigit() for c in core)
    if name == "base64":
        upper = sum(c.isupper() for c in core)
        seen, size = (upper, sum(c.islower() for c in core), digits), (26, 26, 10)
    else:
        few = {"hex": 10, "base32": 6, "alnum": 10}[name]
        seen, size = (len(core) - digits, digits), (len(_ALPHABETS[name]) - few, few)
    n = sum(seen)
    if not n:
        return 0.0
    x = sum((s - n * k / sum(size)) ** 2 / (n * k / sum(size)) for s, k in zip(seen, size, strict=True))
    return math.exp(-x / 2) if len(seen) == 3 else math.erfc(math.sqrt(x / 2))


def weight(length: int) -> float:
    """Longer tokens can show more, and get a larger share of the false discoveries."""
    return min(3.0, length / 32)


def candidates(text: str) -> list[tuple[int, int, float]]:
    """(start, end, p / weight); an assignment's name and sign are no part of a candidate."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        cut = text.find("=", a, b)
        if 0 < cut - a < b - a - 20 and text[cut + 1] != "=":
            a = cut + 1
        out.append((a, b, battery(text[a:b]) / weight(b - a)))
    return out


def threshold(docs: DataFrame) -> float:
    """The largest weighted p-value that is a discovery, over all candidates of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, w = np.zeros(BINS, np.int64), 0.0
        for batch in batches:
            for t in batch["text"]:
                for a, b, p in candidates(t or ""):
                    h[min(BINS - 1, int(max(0.0, -math.log10(p)) / STEP))] += 1
                    w += weight(b - a)
        at = np.flatnonzero(h)
        common.release()
        yield pd.DataFrame({"bin": [*at, -1], "n": [*h[at], int(w * 1000)]})

    rows = docs.select("text").mapInPandas(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS + 1 rows at most
    h = {r["bin"]: r["n"] for r in rows}
    total = h.pop(-1, 0) / 1000  # the weights' sum stands for the number of candidates
    seen, best = 0, 0.0
    for b in sorted(h, reverse=True):
        seen += h[b]
        bound = 10 ** (-b * STEP)  # the largest p-value of the bin
        if b and bound * total <= RATE * seen:
            best = bound
    return best


def all_spans(text: str, limit: float) -> list[tuple[int, int, int, int]]:
    """Base spans, and those that the method adds beside them."""
    base = base_spans(text)
    extra = [(a, 3, b, a) for a, b, p in candidates(text) if p <= limit and not any(x < b and a < y for x, _, y, _ in base)]
    return sorted(base + extra)


def joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def scanned(docs: DataFrame) -> DataFrame:
    limit = threshold(docs)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                spans = all_spans(t or "", limit)
                base = [x for x in spans if x[1] < 3]
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        common.release()

    return docs.select("doc_id", run.asNondeterministic()("text").alias("r")).select("doc_id", "r.*")


def redacted(text: str, limit: float, mark: str = "[SECRET]") -> str:
    """The text with the secret part of each span replaced; spans that touch are replaced together."""
    out, at = [], 0
    for a, _, b, secret in all_spans(text, limit):
        if b <= at:
            continue
        out += [text[at:max(at, secret)], mark] if secret >= at else []
        at = b
    return "".join(out) + text[at:] if out else text


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return scanned(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets replaced by a mark; n_chars follows the new text."""
    common.prepare(spark)
    limit = threshold(docs)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([t if t is None else redacted(t, limit) for t in texts], dtype=object)
        common.release()

    changed = docs.withColumn("text", clean.asNondeterministic()("text"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns)


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the base spans of each kind: doc_id, n_assign, n_access, n_hex."""
    return op4(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: len(x) >= 24))::BIGINT AS n_hex
FROM d
"""
