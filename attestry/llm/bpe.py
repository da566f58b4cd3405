"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked symbol list (operator 8).

Pieces of text come from the vocabulary file's own rules: the tokenizers library normalises and splits, so letters are
what that library takes for letters; texts of Latin letters and usual punctuation only, which composition leaves as they
are, are split by a pattern of the same meaning (tests hold it against the library on every code point). Each
distinct piece is merged here, once, and then remembered by its worker, in a memory of bounded size. Decoding
concatenates the vocabulary's strings.

Defined results: a null text counts as empty and gives no ids; texts are read whole, however long; special tokens'
strings in a text become those tokens, as the tokenizers library has it; rows repeated with one doc_id are encoded each
for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The characters of plain texts, besides ASCII: Latin letters and signs up to U+024F, dashes, quotation marks, the euro.
PLAIN = r"\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac"
#: Distinct pieces that a worker remembers, in two generations of this size.
REMEMBERED = 250_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def plain_classes() -> tuple[str, str, str]:
    """Letters, numbers and white space of plain texts, as the insides of character classes."""
    seen = sorted({x for c in map(chr, range(0x250)) for x in c + c.lower()})  # some have small letters beyond
    kind = lambda k: "".join(re.escape(c) for c in seen if unicodedata.category(c)[0] == k)
    return kind("L"), kind("N"), r"\t-\r \x85\xa0"


class Merger:
    """Merges one piece of text at a time."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"].get("end_of_word_suffix") or ""
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.specials).items()}
        self.letters = byte_letters()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.first = {x: self.vocab[x] for x in self.letters}
        self.last = {x: self.vocab[x + self.suffix] for x in self.letters}

    def merge(self, letters: str) -> list[int]:
        """The ids of a piece, given as the letters that stand for its bytes."""
        if not letters:
            return []
        first, merges = self.first, self.merges
        ids = [first[x] for x in letters]
        ids[-1] = self.last[letters[-1]]
        n = len(ids)
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, a, b, new = pop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: a neighbour has been merged since
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, ids[k]))
                if found:
                    push(queue, (found[0], i, new, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], new))
                if found:
                    push(queue, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]


class Memory(dict):
    """Results by piece in two generations; the older one goes when the newer is full."""

    def __init__(self, make, size: int = REMEMBERED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, piece):
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.old = {}


class WordCodec:
    """Lower-cased words with word ends, white space dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.normalize, self.split = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.merger = Merger(path)
        self.letters = dict(enumerate(self.merger.letters))
        letters, numbers, space = plain_classes()
        self.plain = re.compile(f"[{PLAIN}]*").fullmatch
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+").findall
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\t-\r A-Za-z0-9]+").findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.merger.specials, key=len, reverse=True))) + ")")
        self.memory, self.mapped = Memory(self._piece), Memory(self._merged)

    def found(self, text: str) -> list[tuple[bytes, str]]:
        """The ids and the decoded text of each piece of a text without special tokens."""
        if text.isascii():
            return [self.memory[p] for p in self.ascii(text.lower())]
        if self.plain(text):
            return [self.memory[p] for p in self.pattern(text.lower())]
        return [self.mapped[p] for p, _ in self.split(self.normalize(text))]

    def _piece(self, piece: str) -> tuple[bytes, str]:
        return self._merged(piece.encode().decode("latin-1").translate(self.letters))

    def _merged(self, letters: str) -> tuple[bytes, str]:
        ids = self.merger.merge(letters)
        return array("I", ids).tobytes(), self.decode(ids)

    def forget(self) -> None:
        self.memory.forget()
        self.mapped.forget()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings; this vocabulary file names no decoder, so a space stands between two of them."""
        return " ".join(map(self.merger.strings.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and the text decoded from them."""
        ids, strings = [], []
        for k, part in enumerate(self.special.split(text) if "<|" in text else [text]):
            if k % 2:
                ids.append(self.merger.specials[part].to_bytes(4, "little"))
                strings.append(part)
                continue
            found = self.found(part)
            ids += [x[0] for x in found]
            strings += [x[1] for x in found]
        return b"".join(ids), " ".join(strings)


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids and decoded themselves."""
    path = path or common.tokenizer_path("word_bpe_49k.json")
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids

    @F.pandas_udf(fields)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c, sha = codec(path), hashlib.sha256
        for texts in parts:
            rows = []
            for t in texts:
                ids, back = c.encode(t or "")
                row = (len(ids) // 4, sha(ids).hexdigest(), sha(back.encode()).hexdigest())
                rows.append((*row, ids, back) if keep_ids else row)
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])
        c.forget()
        common.release()

    return docs.select("doc_id", run.asNondeterministic()(F.col("text")).alias("_r")).select("doc_id", "_r.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return encoded(common.table(spark, sf_dir, "documents"))
