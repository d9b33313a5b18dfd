"""The inverted file against brute force: exact with one cell, recall with many, copies, nulls, ties and empty tables."""

import numpy as np
import pytest

from askwright.operators import joins as J
from askwright.operators import neighbours as N


def brute(rows, k, max_sim, wide, asks=None):
    """(key, rank, other, sim) by the definition."""
    out = []
    for i, v in asks if asks is not None else rows:
        sims = sorted((-round(float(np.dot(v, w)), 6), j) for j, w in rows)[: wide * k]
        kept = [(j, -s) for s, j in sims if j != i and -s < max_sim][:k]
        out += [(i, n + 1, j, s) for n, (j, s) in enumerate(kept)]
    return sorted(out)


def told(df):
    return sorted((r.vec_id, r.rank, r.other, round(r.sim, 6)) for r in df.collect())


def unit(rng, n, d=16):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "clash") for i, v in rows], "vec_id long, embedding array<double>, cell string")


@pytest.mark.parametrize("block", [4096, 16])
def test_exact_with_one_cell_copies_and_nulls(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(5)
    vectors = unit(rng, 60)
    rows = [(i, vectors[i % 60]) for i in range(90)] + [(1000 + i, vectors[7]) for i in range(70)]
    df = frame(spark, [*rows, (5000, None), rows[3]]).repartition(5)
    assert told(N.similar(df, k=3, max_sim=0.9)) == brute(rows, 3, 0.9, 3)
    some = [(i, v) for i, v in rows if i % 10 == 0]
    assert told(N.similar(df, k=4, max_sim=2.0, wide=2, asks=frame(spark, some))) == brute(rows, 4, 2.0, 2, some)
    assert N.similar(df.limit(0)).count() == 0
    assert N.similar(df.where("vec_id = 5000")).count() == 0


def test_exact_way_agrees(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, list(enumerate(unit(rng, 120))))
    assert told(N.similar(df, k=3, max_sim=0.8)) == told(J.nearest(df, k=3, max_sim=0.8))


def test_recall_on_the_given_vectors(spark):
    """Cells of 100 of 2,000 vectors; these have little structure, so most cells are looked at."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    exact = {(r.vec_id, r.other) for r in J.nearest(df, k=5, max_sim=2.0).collect()}
    found = {(r.vec_id, r.other) for r in N.similar(df, k=5, max_sim=2.0, cell=100).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_clusters_take_few_cells():
    rng = np.random.default_rng(7)
    middle = unit(rng, 64, 32)
    v = middle[rng.integers(0, 64, 8000)] + 0.05 * rng.normal(size=(8000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cells = N.centroids(v, 64)
    assert N.probes_for(v, cells, 15, 0.95) <= 4
    assert N.probes_for(v, cells[:1], 15, 0.95) == 1


def test_recall_with_clusters_and_a_crowded_one(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 128)
    rng = np.random.default_rng(8)
    middle = unit(rng, 20)
    own = np.where(rng.random(1500) < 0.4, 0, rng.integers(0, 20, 1500))
    v = middle[own] + 0.1 * rng.normal(size=(1500, 16))
    rows = [(i, x / np.linalg.norm(x)) for i, x in enumerate(v)]
    exact = {(a, b) for a, _, b, _ in brute(rows, 5, 2.0, 2)}
    found = {(a, b) for a, _, b, _ in told(N.similar(frame(spark, rows), k=5, max_sim=2.0, wide=2, cell=75))}
    assert len(exact & found) >= 0.9 * len(exact)


def test_other_texts_only(spark):
    rows = [("a", [1.0, 0.0], "One cat"), ("b", [0.99, 0.1], "one CAT"), ("c", [0.9, 0.3], "a dog"), ("d", [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, caption string")
    got = {(r.id, r.other) for r in N.similar(df, k=1, max_sim=2.0, key="id", text="caption").collect()}
    assert ("a", "c") in got and ("b", "c") in got and ("c", "b") in got or ("c", "a") in got
    assert all(a != b for a, b in got)


@pytest.mark.parametrize("query", ["knn_hard_negatives", "vector_search"])
def test_queries_equal_their_sql_beyond_a_cell(spark, duck, tmp_path, monkeypatch, query):
    """Many more vectors than a cell holds, in all directions alike: an index misses some."""
    from askwright.plans import registry

    plain = N.similar
    monkeypatch.setattr(N, "similar", lambda *a, **kw: plain(*a, cell=50, **kw))
    rows = list(enumerate(unit(np.random.default_rng(11), 1500, 64)))
    df = frame(spark, rows).selectExpr("vec_id", "cast(embedding as array<float>) AS embedding").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = told(registry.queries()[query](spark, str(tmp_path)))
    sql = duck.sql(f"WITH embeddings AS (FROM '{tmp_path}/embeddings.parquet/*.parquet') SELECT vec_id, rank, other, sim FROM ({registry.oracle_sql()[query]})")
    assert got == sorted((a, b, c, round(d, 6)) for a, b, c, d in sql.fetchall())


def test_exact_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = list(enumerate(unit(np.random.default_rng(12), 150)))
    assert told(N.similar(frame(spark, rows), k=3, max_sim=0.9, recall=1.0, cell=20)) == brute(rows, 3, 0.9, 3)
