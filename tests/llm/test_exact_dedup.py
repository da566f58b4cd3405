from pyspark.sql import functions as F

from attestry.llm import exact_dedup

CASES = [(1, "Same Ä"), (2, "same Ä"), (3, "same ä"), (4, None), (5, ""), (6, " "), (None, "same Ä"), (None, "alone"), (7, "x" * 200_000), (8, "X" * 200_000), (9, "twice"), (9, "twice"), (10, "İI"), (11, "İi")]


def groups(docs):
    low = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
    by = {}
    for i, t in docs:
        by.setdefault((t or "").translate(low), []).append(i)
    key = lambda i: (i is not None, i or 0)
    return by, key


def check(found, docs):
    by, key = groups(docs)
    want = sorted((repr(i), repr(max(ids, key=key)), len(ids)) for ids in by.values() for i in ids)
    assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(by)


def test_groups(docs):
    check(exact_dedup.decide(docs(CASES)).collect(), CASES)


def test_colliding_digests_are_told_apart_by_their_bytes(docs):
    collide = lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0"))
    check(exact_dedup.decide(docs(CASES), collide).collect(), CASES)


def test_empty_table(docs, spark):
    assert exact_dedup.decide(docs([])).collect() == []
    assert exact_dedup.stage(spark, docs([]), "").collect() == []


def test_stage_keeps_one_row_of_each_group_and_all_columns(docs, spark):
    df = docs(CASES)
    out = exact_dedup.stage(spark, df, "")
    assert out.columns == df.columns
    by, key = groups(CASES)
    assert sorted(repr(r["doc_id"]) for r in out.collect()) == sorted(repr(max(ids, key=key)) for ids in by.values())


def test_main_path_has_no_python(spark, sample):
    df = exact_dedup.op10(spark, sample)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_state_goes_on(spark, docs):
    """A second run over the same folder knows the rows of the first."""
    from attestry.llm import common

    at = common.new_path(spark, "t")
    for i in range(0, len(CASES), 5):
        check(exact_dedup.decide(docs(CASES[i:i + 5]), at=at).collect(), CASES[:i + 5])


def test_places_lead_to_the_content(docs):
    made, content = exact_dedup.decided(docs(CASES))
    places = {r["place"]: r["row"] for r in content.collect()}
    assert len(places) == len(CASES) and all(places[r["place"]]["doc_id"] == r["doc_id"] for r in made.collect())


def test_aggregates_are_hashed(docs, spark, sample):
    """Numbers in every buffer: no aggregation sorts its rows."""
    content = exact_dedup.taken_in(docs(CASES), exact_dedup.common.new_path(spark, "t"))
    for keys in (["digest"], ["digest", "id"]):
        assert "SortAggregate" not in content.groupBy(*keys).agg(*exact_dedup._kept())._jdf.queryExecution().toString()
