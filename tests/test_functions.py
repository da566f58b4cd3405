import math
import random
import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.errors import InvalidPattern
from attestry.functions import blake3 as b3
from attestry.functions.canonical import encoded_rows, header
from attestry.functions.identity import idkey
from attestry.functions.patterns import checked, java_pattern
from attestry.functions.pii import classified
from attestry.operators.profile import distinct_counts

from .plain_canonical import value_bytes

VECTORS = {  # public test vectors: input bytes 0, 1, ... 250, 0, ...
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


@pytest.mark.parametrize("n", VECTORS)
def test_blake3(n):
    assert b3.blake3(bytes(i % 251 for i in range(n))).hex() == VECTORS[n]


@pytest.mark.parametrize("lanes", [1, 8, b3.LANES])
@pytest.mark.parametrize("prefix", [b"", b"prefix"])
def test_digests_of_many_messages(monkeypatch, lanes, prefix):
    import numpy as np

    monkeypatch.setattr(b3, "LANES", lanes)
    r = random.Random(lanes)
    messages = [r.randbytes(n) for n in (0, 1, 57, 58, 59, 64, 0, 1018, 1019, 1024, 1025, 2048, 2049, 3073, 5000, 7168, 7169, 10_000, 3)]
    ends = np.cumsum([len(m) for m in messages])
    assert b3.digests(prefix, np.frombuffer(b"".join(messages), np.uint8), ends) == [b3.blake3(prefix + m) for m in messages]
    assert b3.digests(prefix, np.zeros(0, np.uint8), np.zeros(0, np.int64)) == []


def test_digests_are_made_together(monkeypatch):
    import numpy as np

    calls, compress = [], b3.compress
    monkeypatch.setattr(b3, "compress", lambda *a: calls.append(1) or compress(*a))
    assert len(set(b3.digests(b"x", np.arange(3000 * 8, dtype="<u8").view(np.uint8), np.arange(1, 3001) * 64))) == 3000
    assert len(calls) == 2  # two blocks each


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 12_000), st.lists(st.integers(0, 12_000), max_size=4))
def test_parts_of_a_stream_join_to_its_hash(n, cuts):
    import numpy as np

    from attestry.operators.fingerprint import _emit, _joined

    data = bytes(random.Random(n).randbytes(n))
    tree, rest = b3.Tree(), b""
    edges = sorted({0, n, *(c for c in cuts if c < n)})
    for a, b in zip(edges, edges[1:], strict=False):
        out: list = []
        at, left = _emit(out, a, np.frombuffer(data[a:b], np.uint8), b - a)
        out.append((at, -1, left.tobytes()))
        for _, level, value in out:
            tree, rest = _joined(tree, rest, level, value)
    while len(rest) > 1024:
        tree.add(0, b3.chunk_values(rest[:1024], tree.chunks)[0])
        rest = rest[1024:]
    assert tree.finish(rest) == b3.blake3(data)


def test_encoded_rows_equal_the_plain_encoding():
    t = pa.table({
        "i": pa.array([1, None, -3], pa.int64()), "s": pa.array(["a", None, "çé"]), "b": pa.array([True, False, None]), "f": pa.array([-0.0, math.nan, None], pa.float64()),
        "d": pa.array([0, 1, None], pa.date32()), "l": pa.array([[1, None], None, []], pa.list_(pa.int32())), "x": pa.array([b"\0\1", b"", None], pa.binary()),
    }).slice(0)
    types = [T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.DateType(), T.ArrayType(T.IntegerType()), T.BinaryType()]
    for part in (t, t.slice(1)):
        batch = part.combine_chunks().to_batches()[0]
        data, ends = encoded_rows(batch, types)
        want = b""
        for k, row in enumerate(batch.to_pylist()):
            for j, (v, kind) in enumerate(zip(row.values(), types, strict=True)):
                raw = value_bytes(v, kind)
                want += b"pf-cell-v1\0" + struct.pack("<QQ", j, len(raw)) + raw
            assert ends[k] == len(want)
        assert data.tobytes() == want


def test_header():
    assert header([("id", "Int64", False)]) == b"pf-fp-v1\0pf-schema-field-v1\0" + struct.pack("<Q", 2) + b"id" + struct.pack("<Q", 5) + b"Int64\0" + b"pf-fp-body-v1\0"


def test_identity_is_by_bits(spark):
    a, b = struct.unpack("<dd", struct.pack("<QQ", 0x7FF8000000000001, 0x7FF8000000000002))
    t = pa.table({"v": pa.array([-0.0, 0.0, a, b, a, None], pa.float64()), "l": pa.array([[-0.0], [0.0], [a], [b], [a], None], pa.list_(pa.float64()))})
    df = spark.createDataFrame(t)
    assert {r["column"]: r["distinct_count"] for r in distinct_counts(df).collect()} == {"v": 4, "l": 4}
    k = df.select(idkey(F.col("v"), T.DoubleType()).alias("k"))
    assert k.alias("x").join(k.alias("y"), F.col("x.k").eqNullSafe(F.col("y.k"))).count() == 1 + 1 + 4 + 1 + 1
    maps = spark.sql("SELECT explode(array(map('a', 0.0D), map('a', -0.0D), map('a', 0.0D))) AS m")
    assert distinct_counts(maps).first()["distinct_count"] == 2


@pytest.mark.parametrize("pattern, text, hit", [
    ("^abc$", "abc\n", False), ("(?m)^abc$", "abc\nx", True), (r"^\d+$", "١٢٣", True), ("(?i)^[a-z]$", "ſ", True), ("b", "abc", True), (r"\$", "a$", True), ("[$]$", "a$", True), ("^(?P<x>a)+$", "aa", True), (r"\bé", "é", True), ("(?i:A)b", "ab", True),
])
def test_patterns(spark, pattern, text, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").rlike(checked(spark, pattern))).first()[0] is hit


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", "[a", "a++", "(", "(?<n", "\\"])
def test_refused_patterns(spark, pattern):
    with pytest.raises(InvalidPattern):
        checked(spark, pattern)
    assert issubclass(InvalidPattern, ValueError)


def test_plain_patterns_stay():
    assert java_pattern("a[b-d]{2,3}|e.*") == "(?U)a[b-d]{2,3}|e.*"


@pytest.mark.parametrize("text, numeric, want", [
    (" person@example.com ", False, ("email", "high")), ("PERSON@EXAMPLE.COM", False, ("email", "high")), ("a@b", False, None), ("01.02.003.255", False, ("ipv4", "high")), ("1.2.3.256", False, None),
    ("gb82 west 1234 5698 7654 32", False, ("iban", "high")), ("DE89370400440532013000", False, ("iban", "high")), ("DE89370400440532013001", False, None),
    ("4111-1111-1111-1111", False, ("payment_card", "high")), ("4111111111111111", True, ("payment_card", "low")), ("-4111111111111111", True, ("payment_card", "high")), ("0000000000000", False, ("payment_card", "high")),
    ("2024-01-31", False, ("phone", "medium")), ("12345678", True, ("phone", "low")), ("1234567", True, None), ("4111111111111", False, ("phone", "medium")), ("", False, None),
])
def test_classes_of_personal_data(spark, text, numeric, want):
    hit = spark.createDataFrame([(text,)], "t string").select(classified(F.col("t"), F.lit(numeric)).alias("h")).first()["h"]
    assert (tuple(hit) if hit else None) == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ABCDEFXYZabc", min_size=1, max_size=40), min_size=20, max_size=40))
def test_letters_are_no_cards(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(classified(F.col("t"), F.lit(False)).isNotNull()).count() == 0
