import collections
import hashlib
import random
import re

import numpy as np
import pytest

from attestry.llm import near_dedup as D
from attestry.llm import substrings as S
from attestry.llm.components import components
from attestry.llm.shingles import Words

WORDS = [f"{a}{b}" for a in "bcdfgkmnprst" for b in ("a", "e", "i", "ou")]


def plain_removal(rows, window):
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    common, line = text(70), text(9)
    rows = []
    for i in range(n):
        t = text(rng.randint(0, 120))
        if i % 3 == 0:
            t += "  " + common + "\t" + text(rng.randint(0, 30))
        if i % 2 == 0:
            t += "\n" + line + "\n" + text(40)
        if i % 7 == 0 and rows:
            t = rng.choice(rows)[1][:300] + " " + t
        rows.append((i * 3, t))
    return rows + [(500, rows[4][1]), (501, rows[4][1]), (501, rows[4][1]), (501, text(200)), (None, rows[4][1]), (600, None), (601, ""), (602, " \x0b\x0c"), (603, "é\xa0x " * 60), (2, "é\xa0x " * 70), (700, "same " * 300), (1, "same " * 200)]


@pytest.mark.parametrize("options", [{"window": 12, "size": 4}, {"window": 50}, {"window": 12, "size": 4, "bits": 15, "hot_share": 5, "hot_least": 2}, {"window": 12, "size": 4, "bucket": 1, "few": 0}, {"window": 50, "bucket": 1, "few": 0}])
def test_removal_is_exact(docs, options):
    rows = passages(1)
    got = S.cleaned(docs(rows), texts=True, **options).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == plain_removal(rows, options["window"])
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_removal_in_an_empty_table_and_a_very_long_text(docs):
    assert S.cleaned(docs([])).collect() == []
    rng = random.Random(4)
    long = " ".join(rng.choices(WORDS, k=60_000))
    rows = [(1, long[1000:200_000]), (2, long)]
    got = S.cleaned(docs(rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == plain_removal(rows, 50)


def test_windows_are_ranked_by_their_words(monkeypatch):
    rng = np.random.default_rng(3)
    for window in (2, 3, 12, 50):
        ids = rng.integers(0, 3, 400).astype(np.int32)
        ids[200:300] = ids[50:150]
        at = np.flatnonzero(rng.random(400 - window) < 0.7)
        plain = [tuple(ids[a:a + window].tolist()) for a in at]
        for hashed in (S.sums, lambda values, a, b, base: a * 0):  # also when all hashes are equal
            monkeypatch.setattr(S, "sums", hashed)
            got = S.ranks(ids, at, window).tolist()
            assert len(set(zip(got, plain, strict=True))) == len(set(got)) == len(set(plain))
        monkeypatch.undo()


def test_sql_is_the_plain_removal():
    import duckdb

    rows = [(i, t) for i, t in passages(1) if i not in (None, 501, 603)] + [(801, "a\u00a0b " * 120), (802, "x a\u00a0b " * 120)]
    documents = __import__("pandas").DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    assert sorted(duckdb.sql(S.SQL).project("doc_id, n_words, n_removed, kept_sha256").fetchall(), key=repr) == plain_removal(rows, 50)


def test_windows_and_minimisers():
    a = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for n in range(1, 8):
        assert S.sliding_min(a, n).tolist() == [min(a[i:i + n]) for i in range(len(a) - n + 1)]
    w = Words([b"a b c d", b"", b"b c"])
    assert [w.buffer[s:e] for s, e in zip(w.starts, w.ends, strict=True)] == [b"a", b"b", b"c", b"d", b"b", b"c"]
    assert w.doc.tolist() == [0, 0, 0, 0, 2, 2] and w.first.tolist() == [0, 4, 4, 6]
    g = w.grams(2)
    assert g[1] == g[4] and len(set(g.tolist())) == 4


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def near_copies(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgkmnprst" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 150, 400]))
        for _ in range(rng.choice([1, 2, 5, 40])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), (", ".join(w)).capitalize() if rng.random() < 0.3 else " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "--- !!"), (903, "one"), (904, "One!"), (905, rows[0][1]), (905, rows[0][1]), (None, rows[0][1]), (906, "la la la " * 3000)]


def test_similarity_is_exact():
    rng = random.Random(6)
    for _ in range(200):
        x, y = ({k: rng.randint(1, 5) for k in rng.sample(range(12), rng.randint(1, 9))} for _ in "ab")
        a, b = ((np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for d in (x, y))
        assert abs(D.similarity(a, b) - jaccard(collections.Counter(x), collections.Counter(y))) < 1e-9


def test_signatures_estimate_similarity():
    rng = random.Random(8)
    x = {rng.getrandbits(64): rng.randint(1, 4) for _ in range(300)}
    y = dict(list(x.items())[:240]) | {rng.getrandbits(64): rng.randint(1, 4) for _ in range(60)}
    doc = np.repeat([0, 1], [len(x), len(y)])
    h, w = np.array([*x, *y], np.uint64), np.array([*x.values(), *y.values()])
    sig = D.signatures(doc, h, w, 3, 2_000)
    assert abs((sig[0] == sig[1]).mean() - jaccard(collections.Counter(x), collections.Counter(y))) < 0.05 and not sig[2].any()


def check_classes(rows, got):
    """No pair of similar texts in two classes, and no class that links don't hold together."""
    sets = [(r["doc_id"], r["class"]) for r in got]
    texts = dict(rows)
    counted = {i: shingles(t) for i, t in texts.items()}
    cls = dict(sets)
    ids = [i for i in counted if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if counted[a] and counted[b] and len(counted[a].keys() & counted[b].keys()) * 2 > min(len(counted[a]), len(counted[b])) and jaccard(counted[a], counted[b]) >= 0.8:
                parent[find(a)] = find(b)
                assert cls[a] == cls[b], (a, b)
    assert len({cls[i] for i in ids}) == len({find(i) for i in ids})


def test_classes(docs):
    rows = near_copies()
    got = D.classes(docs(rows)).collect()
    assert len(got) == len(rows)
    check_classes(rows, got)
    of = {r["doc_id"]: r for r in got}
    assert of[903]["class"] == of[904]["class"] and len({of[i]["class"] for i in (900, 901, 902)}) == 3
    assert of[905]["class_id"] == of[0]["class_id"] == 0
    sizes = collections.Counter(r["class"] for r in got)
    assert all(r["class_size"] == sizes[r["class"]] for r in got) and sum(r["uid"] == r["keep_uid"] for r in got) == len(sizes)


def test_crowded_buckets_are_resolved_in_tiles(docs, monkeypatch):
    monkeypatch.setattr(D, "SMALL", 2)
    monkeypatch.setattr(D, "TILE", (3, 5))
    rows = near_copies(5)
    check_classes(rows, D.classes(docs(rows)).collect())


def test_tiles_are_bounded_by_bytes(docs, monkeypatch):
    monkeypatch.setattr(D, "SMALL", 2)
    monkeypatch.setattr(D, "TILE_BYTES", (3_000, 9_000))
    rows = near_copies(6)
    check_classes(rows, D.classes(docs(rows)).collect())


def test_links_near_the_threshold(docs):
    """Pairs of similarity 0.8 and little more: a miss has a probability of 0.002 at 0.8, and less above."""
    rng = random.Random(17)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgkmnprst" for b in "aeiou" for c in "lmnrst"]
    rows, links = [], 0
    for i in range(150):
        base = rng.choices(vocabulary, k=300)
        other = list(base)
        while jaccard(shingles(" ".join(base)), shingles(" ".join(other))) >= 0.84:
            other[rng.randrange(300)] = rng.choice(vocabulary)
        alike = jaccard(shingles(" ".join(base)), shingles(" ".join(other)))
        links += alike >= 0.8
        rows += [(2 * i, " ".join(base), alike), (2 * i + 1, " ".join(other), alike)]
    for agree in (D.AGREE, 0):
        of = {r["doc_id"]: r["class"] for r in D.classes(docs([r[:2] for r in rows]), agree=agree).collect()}
        found = sum(of[i] == of[i + 1] for i, _, alike in rows[::2] if alike >= 0.8)
        assert links > 100 and found >= 0.98 * links
        assert not any(of[i] == of[i + 1] for i, _, alike in rows[::2] if alike < 0.8 - 1e-9)


def test_stage_and_empty_tables(docs, spark):
    assert D.classes(docs([])).collect() == [] and D.stage(spark, docs([]), "").collect() == []
    rows = near_copies()
    df = docs(rows)
    out = D.stage(spark, df, "")
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    want = {r["keep_uid"]: r["class_id"] for r in D.classes(df).collect()}
    assert sorted(map(repr, kept)) == sorted(map(repr, want.values()))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sql_of_classes_agrees(spark, sample):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sample}/documents.parquet'")
    got = sorted(tuple(r[c] for c in ("doc_id", "class_id", "class_size", "kept")) for r in D.op7(spark, sample).collect())
    assert got == sorted(con.sql(D.SQL).project("doc_id, class_id, class_size, kept").fetchall())
    rows = [r for r in near_copies() if r[0] not in (None, 905)]
    documents = __import__("pandas").DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    sql = [dict(zip(("doc_id", "class"), r, strict=True)) for r in duckdb.sql(D.SQL).project("doc_id, class_id").fetchall()]
    check_classes(rows, sql)
