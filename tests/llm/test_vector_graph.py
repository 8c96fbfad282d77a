"""The graph search against inner products with every vector."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import vector_graph as V

ROWS = "vec_id long, embedding array<float>"


def plain_nearest(rows, k, every=20):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % every == 0:
            ranked = sorted((-float((v * q).sum()), j) for j, v in rows if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in ranked[:k]]
    return out


def searched(spark, rows, k=20, every=20):
    found = {}
    result = V.nearest(spark.createDataFrame(rows, ROWS).repartition(3), k=k, every=every).orderBy("query_id", "rank")
    assert result.columns == ["query_id", "rank", "vec_id", "score"]
    for r in result.collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def invented(n, dim, seed, lengths=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + rng.normal(size=(8, dim))[rng.integers(0, 8, n)]
    return x * rng.uniform(0.2, 3, (n, 1)) if lengths else x / np.linalg.norm(x, axis=1)[:, None]


def recall(found, want):
    return np.mean([len({j for j, _ in found[q]} & {j for j, _ in best}) / max(1, len(best)) for q, best in want.items()])


@pytest.mark.parametrize("lengths", [True, False])
def test_recall_over_several_shards(spark, monkeypatch, lengths):
    monkeypatch.setattr(V, "FEWEST", 700)
    monkeypatch.setattr(V, "ROOT", 1)
    rows = list(enumerate(invented(2500, 24, 1, lengths).tolist()))
    found, want = searched(spark, rows), plain_nearest(rows, 20)
    assert found.keys() == want.keys() and all(len(f) == 20 for f in found.values())
    assert recall(found, want) >= 0.95
    scores = {(q, j): s for q, best in plain_nearest(rows, len(rows)).items() for j, s in best}
    assert all(math.isclose(s, scores[q, j], rel_tol=1e-12) for q, best in found.items() for j, s in best)
    assert all(best == sorted(best, key=lambda x: (-x[1], x[0])) for best in found.values())


def test_copies_and_ties(spark):
    """A vector that a third of all rows hold, among others: exact where everything is within reach."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 6).tolist()) for i in range(200)] + [(i, [1, 2, 0, 0, 0, 1]) for i in range(1000, 1100)]
    rows = [(i, [float(x) for x in v]) for i, v in rows if any(v)]
    found, want = searched(spark, rows), plain_nearest(rows, 20)
    assert found.keys() == want.keys()
    assert all([s for _, s in found[q]] == [s for _, s in want[q]] for q in want)
    # of equal scores, smaller ids come first
    assert all(found[q] == want[q] for q in want if q >= 1000)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-1.0, 0.0]), (4, None), (40, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0])]
    rows += [(9, []), (None, [1.0, 1.0]), (60, [1.0, 2.0, 3.0]), (11, [1.0, 0.0, 0.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (80, [1.0])]
    assert searched(spark, rows) == {0: [(20, 0.5), (3, -1.0)], 20: [(0, 0.5), (3, -0.5)], 60: [(11, 1.0)]}


def test_shared_ids_keep_the_least_vector(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [2.0, 5.0]), (2, [1.0, 0.0])]
    assert searched(spark, rows, every=2) == {0: [(1, 2.0), (2, 1.0)], 2: [(1, 2.0), (0, 1.0)]}


def test_empty_tables_and_clashing_columns(spark):
    assert searched(spark, []) == {} and searched(spark, [(1, [1.0])]) == {}
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], ROWS)
    extra = frame.withColumns({c: F.lit("x") for c in ("node", "ids", "vector", "shard", "rank", "score", "query_id", "place")})
    assert [tuple(r) for r in V.nearest(extra).collect()] == [(0, 1, 1, 2.0)]


def test_queries_of_their_own(spark):
    rows = list(enumerate(invented(300, 8, 3).tolist()))
    asked = spark.createDataFrame([(7, rows[7][1]), (1000, rows[8][1])], ROWS)
    got = V.nearest(spark.createDataFrame(rows, ROWS), asked, k=5).collect()
    assert {r.query_id for r in got} == {7, 1000} and len(got) == 10
    for query, like in ((7, 7), (1000, 8)):
        scores = sorted(((-sum(a * b for a, b in zip(np.float32(v).astype(float), np.float32(rows[like][1]).astype(float))), i) for i, v in rows if i != query))
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == query] == [i for _, i in scores[:5]]


def test_very_long_and_very_large_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (1e30 * rng.normal(size=5000)).tolist()) for i in range(30)]
    found, want = searched(spark, rows, k=3), plain_nearest(rows, 3)
    assert {q: [j for j, _ in f] for q, f in found.items()} == {q: [j for j, _ in f] for q, f in want.items()}


def test_pruning_keeps_diverse_neighbours():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 3], [5, 0], [12, 0]], np.float32)
    kept = V.pruned(points, np.array([0]), np.array([[1, 2, 3, 4, 5, 0, -1, 1]]))
    # 2 and 4 lie behind 1; 5 does so by less than the factor that pruning is relaxed by
    assert kept[0][kept[0] >= 0].tolist() == [1, 3, 5]


def test_degrees_are_bounded_and_all_is_reached():
    points = V.lifted(invented(900, 10, 5))
    links = V.built(points)
    assert links.shape == (900, V.DEGREE) and not (links == np.arange(900)[:, None]).any()
    met, reached = [V.middle_node(points)], {V.middle_node(points)}
    while met:
        fresh = {x for x in links[met.pop()].tolist() if x >= 0} - reached
        reached |= fresh
        met += fresh
    assert len(reached) >= 899
