"""The inverted-file index against brute force: exact route whole, probed route with its recall."""

import numpy as np
import pytest

from graphloom.operators import vector_index as V


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 24))
    m = centres[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 24))
    m[7] = 0
    m[20:30] = m[19]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(m)] + [(19, m[19].tolist()), (9999, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>").selectExpr("*", "'x' AS cell", "1 AS angle")
    index = V.build_index(vectors, str(tmp_path_factory.mktemp("ivf") / "index"), 16, sample=800)
    asked = spark.createDataFrame([(q, (m[q] + 0.1 * rng.normal(size=24)).tolist()) for q in range(0, 3000, 50)] + [(-1, None)], "query_id long, v array<double>")
    return m, rows, index, asked


def brute(rows, asked, threshold, k=None):
    out = set()
    kept = [(i, np.array(v)) for i, v in rows if v is not None]
    u = np.array([v / (np.linalg.norm(v) or 1) for _, v in kept])
    for r in asked.collect():
        if r["v"] is not None:
            q = np.array(r["v"])
            s = np.round(u @ (q / np.linalg.norm(q)), 6)
            hits = sorted(((-x, i) for x, (i, _) in zip(s, kept, strict=True) if x >= threshold))[:k]
            out |= {(r["query_id"], i, -x, n) for n, (x, i) in enumerate(hits, 1)}
    return out


@pytest.mark.parametrize("threshold, k", [(0.8, None), (0.3, None), (-1.0, 7), (0.9, 3)])
def test_exact_route_misses_nothing(spark, made, threshold, k):
    _, rows, index, asked = made
    got = {tuple(r) for r in V.search(spark, index, asked, threshold=threshold, k=k).select("query_id", "vec_id", "score", "rank").collect()}
    plain = lambda found: {(q, i, round(s * 1e6), n) for q, i, s, n in found}
    assert plain(got) == plain(brute(rows, asked, threshold, k))


def test_probes_read_fewer_cells_with_recall(spark, made):
    _, rows, index, asked = made
    want = {r[:2] for r in brute(rows, asked, -1.0, 10)}
    got = {tuple(r) for r in V.search(spark, index, asked, k=10, probes=4).select("query_id", "vec_id").collect()}
    assert len(got & want) / len(want) >= 0.9
    asked_for = V.asked_cells(index, np.array([r["v"] for r in asked.collect() if r["v"]]), 0.8, 4)
    assert (asked_for.sum(axis=1) == 4).all() and len(index.cells) >= 12


def test_opened_again_and_pruned(spark, made):
    _, rows, index, asked = made
    again = V.open_index(spark, index.path)
    assert np.array_equal(again.centroids, index.centroids) and np.array_equal(again.reach, index.reach)
    one = asked.where("query_id = 0")
    plan = V.search(spark, again, one, k=3, probes=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_nothing_to_search(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    index = V.build_index(none, f"{tmp_path}/index", 4)
    assert V.search(spark, index, spark.createDataFrame([(1, [1.0])], "query_id long, v array<double>")).collect() == []
