import hashlib
import random
import struct
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestry.llm import bpe, common, packing

ODD = ["", " ", "<|endoftext|> a<|startoftext|>B  c\n\n  d", "ΑΣ ΣΑΣ don't I'LL x́ é é ١٢٣ ½ \x1c\x1d a\x85b c 漢字 😀😀'ſ İ'S", "a  b   \n c\t\t", "___--- foo_bar\xa0baz", "y" * 5_000, "ab " * 40_000]


def library(name):
    t = Tokenizer.from_file(common.tokenizer_path(name))
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def texts(sample):
    return ODD + [r[0] for r in duckdb.sql(f"SELECT text FROM '{sample}/documents.parquet'").fetchall()]


def test_word_codec_is_the_library(texts):
    lib, own = library("word_bpe_49k.json"), bpe.codec(common.tokenizer_path("word_bpe_49k.json"))
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        got, back = own.encode(t)
        assert got == struct.pack(f"<{len(ids)}I", *ids)
        assert back == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_codecs_on_any_text(t):
    for name, codec in (("word_bpe_49k.json", bpe.codec), ("byte_bpe_50k.json", packing.codec)):
        ids = library_of(name).encode(t, add_special_tokens=False).ids
        got = codec(common.tokenizer_path(name)).encode(t)
        assert (got[0] if isinstance(got, tuple) else got) == struct.pack(f"<{len(ids)}I", *ids), t


@pytest.mark.parametrize("name, codec", [("word_bpe_49k.json", bpe.codec), ("byte_bpe_50k.json", packing.codec)])
def test_codecs_on_every_code_point(name, codec):
    """Alone, beside letters, digits and itself; a difference is looked for in lines of many, then named."""
    lib, own = library(name), codec(common.tokenizer_path(name))

    def same(t):
        ids, got = lib.encode(t, add_special_tokens=False).ids, own.encode(t)
        return (got[0] if isinstance(got, tuple) else got) == struct.pack(f"<{len(ids)}I", *ids)

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    probe = lambda c: f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}' "
    bad = [hex(c) for i in range(0, len(points), 64) if not same("x ".join(map(probe, points[i:i + 64]))) for c in points[i:i + 64] if not same(probe(c))]
    assert bad == []


_libraries = {}


def library_of(name):
    return _libraries.setdefault(name, library(name))


def test_batches_are_bounded_by_bytes_until_restored(spark, sample):
    from attestry.llm import neighbours

    before = spark.conf.get(common.BATCH_SETTING)
    common.restore(spark)
    given = spark.conf.get(common.BATCH_SETTING)
    try:
        common.prepare(spark)
        common.prepare(spark)
        assert spark.conf.get(common.BATCH_SETTING) == str(common.BATCH)
        common.restore(spark)
        assert spark.conf.get(common.BATCH_SETTING) == given
        spark.conf.set(common.BATCH_SETTING, "1000")  # a smaller one of the caller's stays
        common.prepare(spark)
        assert spark.conf.get(common.BATCH_SETTING) == "1000"
        common.restore(spark)
        spark.conf.set(common.BATCH_SETTING, given)
        neighbours.op5(spark, sample)
        assert spark.conf.get(common.BATCH_SETTING) == given
    finally:
        spark.conf.set(common.BATCH_SETTING, before)


def test_memory_is_bounded():
    m = bpe.Memory(str.upper, 10)
    assert [m[f"k{i}"] for i in range(100)] == [f"K{i}" for i in range(100)]
    assert len(m) <= 10 and len(m.old) <= 10


def test_encoded(docs):
    found = {r["doc_id"]: r for r in bpe.encoded(docs([(1, None), (2, "the cat"), (2, "the cat"), (None, "x")]), keep_ids=True).collect()}
    assert found[1]["n_tokens"] == 0 and found[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and found[1]["decoded"] == ""
    assert found[2]["decoded"] == "the</w> cat</w>" and found[2]["n_tokens"] == 2
    assert bpe.encoded(docs([])).collect() == []


def check_packing(rows, ids_of, docs, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for i, t in docs:
        ids = ids_of(t)
        own = sorted((r for r in by_doc[i]), key=lambda r: r["piece"])
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, a, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packed(docs, texts, capacity):
    given_docs = list(enumerate([None, *texts]))
    lib = library("byte_bpe_50k.json")
    ids_of = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 0]
    check_packing(packing.packed(docs(given_docs), capacity=capacity).collect(), ids_of, given_docs, capacity)


def test_packing_of_nothing_and_of_repeated_rows(docs):
    assert packing.packed(docs([])).collect() == []
    rows = packing.packed(docs([(1, "a b c")] * 5)).collect()
    assert len(rows) == 5 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 5 and len({r["sequence_id"] for r in rows}) == 1


def simple_plan(lengths, capacity):
    """Best-fit decreasing, one item at a time."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= x]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


def test_plan_is_sound_and_tight():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([10, 100, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
        runs, bins = packing.plan(counts, capacity)
        used, ranks = {}, {}
        for length, rank, count, first, each, offset in runs:
            assert rank == ranks.get(length, 0)
            ranks[length] = rank + count
            for k in range(count):
                used.setdefault(first + k // each, []).append((offset + k % each * length, length))
        assert ranks == counts and set(used) == set(range(bins))
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity and sum(3 * x > capacity for _, x in places) <= 2
        assert bins <= simple_plan([k for k, v in counts.items() for _ in range(v)], capacity) + 1
