import random

import pytest

from attestry.llm import toxicity as X

WORDS = [f"w{a}{b}" for a in "bcdfgkmnprstvz" for b in ("an", "el", "ir", "ot", "um")]
BAD = ("vorklum", "drasp")


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(20, 120))
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(("", "s", "ing"))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def learned(docs, spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    return rows, dict(labels), docs(rows), X.learn(docs(rows), table)


def test_lexicon_is_found_and_scores_what_it_hasnt_seen(learned):
    rows, labels, df, model = learned
    folded = {X.fold(w).strip() for w in BAD}
    assert all(any(w.startswith(e) or e.startswith(w) for e in model.lexicon) for w in folded)
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", X.scorer(model)("text").alias("s")).collect()}
    assert sum((got[i] >= 0.5) == bool(labels[i]) for i, _ in rows) / len(rows) > 0.99


@pytest.mark.parametrize("text", ["vorklum", "VORKLUM!", "v0rk1um", "vоrklum", "vor​klum", "ｖｏｒｋｌｕｍ", "vorklumish"])
def test_disguises(learned, text):
    model = learned[3]
    a = model.automaton()
    assert X.measure(a, f"wban {text} wbel")[0] > 0
    assert X.measure(a, f"wban x{text} wbel")[0] == 0


def test_exceptions_and_length():
    model = X.Model({"drasp": 3.0}, [X.fold("harmless drasp").strip()])
    a = model.automaton()
    assert X.measure(a, "a harmless drasp b") == (0.0, 4)
    assert X.measure(a, "a harmless drasp drasp b") == (3.0, 5)
    long, short = (X.score(model.curve, *X.measure(a, "drasp " + "b " * n)) for n in (2_000, 5))
    assert 0 <= long < short <= 1


def plain_measure(model, text):
    """Every place against every entry, every match against every phrase."""
    folded = X.fold(text)
    at = lambda s: [i for i in range(len(folded)) if folded.startswith(s, i)]
    safe = [(i, i + len(p) + 1) for p in model.exceptions for i in at(f" {p} ")]
    hits = [(i, i + len(e), w) for e, w in model.lexicon.items() for i in at(f" {e}")]
    return sum(w for i, j, w in hits if not any(x <= i and j <= y for x, y in safe)), len(folded.split())


def test_measure_is_that_of_a_plain_matcher(learned):
    rng = random.Random(8)
    made = X.Model({"ab": 1.0, "abc": 2.0, "b": 0.5, "cab": 4.0}, ["a abc", "b ab", "ab b"])
    for model, words in ((made, ["a", "ab", "abc", "abcd", "b", "ba", "cab", "c"]), (learned[3], [*WORDS, *BAD, "drasps"])):
        automaton = model.automaton()
        for _ in range(400):
            text = " ".join(rng.choices(words, k=rng.randint(0, 25)))
            got, want = X.measure(automaton, text), plain_measure(model, text)
            assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-9, text


def test_measure_of_a_very_long_text_is_quick():
    import time

    automaton = X.Model({"drasp": 3.0}, [X.fold("harmless drasp").strip()]).automaton()
    began = time.perf_counter()
    assert X.measure(automaton, "harmless drasp drasp " * 100_000) == (300_000.0, 300_000)
    assert time.perf_counter() - began < 5


def test_held_out_accuracy(spark, docs):
    """Learned from rows that aren't held out, measured on those that are; the labels of the latter are never seen."""
    import zlib

    rows, labels = corpus(1_500, 11)
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    model = X.learn(docs(rows), spark.createDataFrame([x for x in labels if x[0] not in out], "doc_id long, toxic int"))
    automaton = model.automaton()
    right = [(X.score(model.curve, *X.measure(automaton, t)) >= 0.5) == bool(dict(labels)[i]) for i, t in rows if i in out]
    assert len(right) > 250 and sum(right) / len(right) > 0.98


def test_held_out_accuracy_on_the_sample(spark):
    """The tables at sf0.01: rows with a label whose remainder is 0."""
    import duckdb

    at = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{at}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    got = [r for r in X.op1(spark, at).collect() if r["held_out"] and r["doc_id"] in truth]
    right = [r["predicted"] == truth[r["doc_id"]] for r in got]
    assert len(right) > 30 and sum(right) / len(right) > 0.95


def test_stage_keeps_clean_rows_as_they_are(spark, docs, tmp_path):
    df = docs([(1, None), (2, ""), (3, "an idiot"), (3, "an idiot"), (4, "fine"), (4, "fine"), (None, "good day"), (5, "good " * 50_000)])
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = X.stage(spark, df, str(tmp_path))
    assert out.schema == df.schema and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2, 4, 4, 5]
    assert X.stage(spark, docs([]), str(tmp_path)).collect() == []


def test_empty_texts_no_labels_and_held_out_rows(docs, spark):
    df = docs([(1, None), (2, ""), (3, "\n"), (4, "an idiot"), (5, "a " * 100_000), (None, "x")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.learn(df, none)
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", X.scorer(model)("text").alias("s")).collect()}
    assert got[1] == got[2] == got[3] < 0.5 <= got[4] and all(0 <= s <= 1 for s in got.values())
    held = {r["doc_id"]: r["h"] for r in df.select("doc_id", X.held_out(df.doc_id).alias("h")).collect()}
    import zlib

    assert all(held[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in (1, 2, 3, 4, 5)) and held[None] is False
    assert docs([]).select(X.scorer(model)("text")).collect() == []


def test_held_out_labels_arent_learned_from(docs, spark):
    rows, labels = corpus()
    import zlib

    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    flipped = [(i, 1 - t if i in set(out) else t) for i, t in labels]
    a, b = (X.learn(docs(rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a == b


def test_query(spark, sample):
    got = X.op1(spark, sample)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 200
    assert got.where("predicted <> cast(score >= 0.5 AS int) OR score < 0 OR score > 1").count() == 0


def test_rare_toxic_words_arent_cut_for_common_ones(docs, spark, monkeypatch):
    """Ordinary words have far more beginnings of more support than 20 times the lexicon."""
    monkeypatch.setattr(X, "LEXICON", 2)
    rng = random.Random(5)
    labels = [(i, int(i % 5 == 1)) for i in range(600)]
    rows = [(i, " ".join([*rng.choices(WORDS, k=40), *(["vorklum"] if toxic and i % 4 == 0 else [])])) for i, toxic in labels]
    model = X.learn(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(X.fold("vorklum").strip().startswith(e) for e in model.lexicon)
