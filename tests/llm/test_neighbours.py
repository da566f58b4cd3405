import numpy as np
import pytest

from attestry.llm import neighbours as N


def plain(rows, k=10, every=100):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, x in good:
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))
            out |= {(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(near[:k])}
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS rank", "3 AS qb")
    got = N.nearest(df.where("vec_id % 100 = 0"), df, **options).collect()
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got}, len(got)


@pytest.mark.parametrize("blocks", [(3, 19), None])
def test_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # many equal vectors
    rows += [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [float("nan")] + [1.0] * 7), (2400, [None] + [1.0] * 7), (2500, [float("inf")] * 8), (None, [1.0] * 8), (2600, [2.0**100] * 8), (2601, [2.0**-100] * 8), (2700, [1.0, 2.0]), (2701, [1.5, 2.0])]
    got, n = run(spark, rows, blocks=blocks)
    assert got == plain(rows) and n == len(got)


def test_few_and_none(spark):
    assert run(spark, [])[1] == 0
    assert run(spark, [(0, [1.0])])[1] == 0
    assert run(spark, [(0, [1.0]), (1, [3.0]), (2, [-1.0])])[0] == {(0, 1, 1, 2.0), (0, 2, 2, 2.0)}


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 16)) * rng.choice([1e-6, 1, 1e6], size=(50, 1))
    codes, scale, lost = N.quantised(x)
    assert np.allclose(np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)), lost) and np.abs(codes).max() == 127


def test_sql_agrees(spark, sample):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sample}/embeddings.parquet'")
    want = {(q, r, v, round(s, 9)) for q, r, v, s in con.sql(N.SQL).fetchall()}
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in N.op5(spark, sample).collect()} == want


def test_clustered_vectors_travel_little(spark):
    """Cells beyond a query's bound aren't visited, and nothing is lost by that."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 6)) * 100
    rows = [(i, (centres[i % 30] + rng.normal(size=6)).astype(np.float32).tolist()) for i in range(3_000)]
    got, n = run(spark, rows, blocks=(2, 60))
    assert got == plain(rows) and n == len(got)
    cells = N.Cells([v for _, v in rows[:60]])
    x = __import__("pandas").Series([np.array(v, float) for _, v in rows])
    own, far = cells.placed(x)
    radius = {int(c): float(far[own == c].max()) for c in np.unique(own)}
    i, _ = cells.reached(x, own, np.full(len(x), 8.0), radius)
    assert len(i) < 4 * len(x)


def test_repeated_ids_take_part_each_for_itself(spark):
    import duckdb

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)]
    rows += [(100, rows[7][1]), (100, rows[100][1]), (5, rows[8][1]), (5, rows[5][1]), (9, rows[8][1])]
    embeddings = __import__("pandas").DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841
    want = sorted((q, r, round(s, 6)) for q, r, _, s in duckdb.sql(N.SQL).fetchall())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for blocks in (None, (2, 11)):
        got = N.nearest(df.where("vec_id % 100 = 0"), df, blocks=blocks).collect()
        assert sorted((r["query_id"], r["rank"], round(r["score"], 6)) for r in got) == want
