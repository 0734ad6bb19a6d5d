import math
import random

import pytest
from pyspark.sql import functions as F

from paywire.llm import knn_join


def brute(rows, k, scale=1024):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(float(x) * scale) for x in v):
            return None
        return [math.floor(float(x) * scale) for x in v]

    sound = [(i, whole(v)) for i, v in rows if whole(v) is not None]
    out = []
    for a, (q, v) in enumerate(sound):
        if q is not None and q % 10 == 0:
            clip = lambda s: max(min(s, 2**63 - 1), -(2**63))
            scored = [(-clip(sum(x * y for x, y in zip(v, w, strict=False))), i is None, i or 0) for b, (i, w) in enumerate(sound) if b != a]
            scored.sort()
            out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k], 1)]
    return sorted(map(str, out))


def found(spark, rows, k=10, kind="float", **how):
    table = spark.createDataFrame([(i, v, i, "x") for i, v in rows], f"vec_id long, v array<{kind}>, score long, tag string").repartition(4)
    got = knn_join.top_k(table, F.col("vec_id") % 10 == 0, k, "vec_id", "v", **how)
    return sorted(str(tuple(r)) for r in got.select("query_id", "rank", "id", "score").collect())


def clustered(n, seed, width=6, centres=12):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, [x + rnd.gauss(0, 0.05) for x in rnd.choice(middle)]) for i in range(n)]


def as_float(rows):
    import numpy as np

    return [(i, [float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("how", [{}, {"chunk_rows": 7, "group_queries": 3}, {"max_pivots": 1}])
def test_against_brute_force(spark, how):
    rows = as_float(clustered(700, 1))
    assert found(spark, rows, **how) == brute(rows, 10)


def test_odd_rows(spark):
    """NULL and non-finite components, shorter vectors, equal vectors and ids, NULL ids, empty vectors."""
    rows = as_float(clustered(60, 2, width=3)) + [(70, None), (80, [1.0, None, 2.0]), (90, [float("nan"), 0.0, 0.0]), (91, [float("inf"), 0.0, 0.0]), (10, [9.0]), (100, []), (None, [1.0, 1.0, 1.0]), (None, [9.0, 9.0, 9.0])]
    rows += [(7, [0.5, 0.5, 0.5])] * 15 + [(20, [0.5, 0.5, 0.5])] * 3
    assert found(spark, rows) == brute(rows, 10)
    assert found(spark, rows, chunk_rows=4, group_queries=1) == brute(rows, 10)


def test_few_rows_and_empty_tables(spark):
    rows = [(10, [1.0, 2.0]), (11, [0.0, -1.0])]
    assert found(spark, rows) == brute(rows, 10) and found(spark, rows[1:]) == [] and found(spark, rows[:1]) == []
    table = spark.createDataFrame([], "vec_id long, v array<float>")
    assert knn_join.top_k(table, F.col("vec_id") % 10 == 0, 10, "vec_id", "v").count() == 0


def test_one_vector_in_a_third_of_the_rows(spark):
    rows = as_float(clustered(200, 3)) + [(1000 + i, [0.25] * 6) for i in range(100)]
    assert found(spark, rows, chunk_rows=16) == brute(rows, 10)


def test_numbers_beyond_53_bits(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([1.0, -1.0]) * rnd.randrange(10**12) for _ in range(3)]) for i in range(40)] + [(50, [1e300, 2.0, 3.0]), (51, [1e305, 1e306, 1.0]), (60, [0.5, 0.25, 3e5])]
    assert found(spark, rows, kind="double", chunk_rows=8) == brute(rows, 10)


def test_cells_that_cannot_matter_are_not_visited(spark):
    """Tight clusters: a query group goes to few other cells, and only scores that reach its floor leave a task."""
    rows = as_float(clustered(2000, 5, width=8, centres=40))
    table = spark.createDataFrame(rows, "vec_id long, v array<float>")
    seen, solve = [], knn_join._solved

    def counted(chunks, pairs, k, width):
        seen.append((chunks.count(), pairs.count(), solve(chunks, pairs, k, width)))
        return seen[-1][2]

    knn_join._solved = counted
    try:
        got = knn_join.top_k(table, F.col("vec_id") % 10 == 0, 10, "vec_id", "v", chunk_rows=64)
    finally:
        knn_join._solved = solve
    assert got.count() == 2000
    (n_chunks, _, _), (_, away, found_away) = seen
    n_groups = 12
    assert away < n_chunks * n_groups / 2 and found_away.count() < 10 * 200


def test_bounds_hold():
    import numpy as np

    rnd = np.random.default_rng(6)
    x = np.floor(rnd.normal(0, 300, (500, 5)))
    pivots = knn_join.fit_pivots(x, 9)
    cell = np.argmin((pivots**2).sum(1) - 2 * x @ pivots.T, 1)
    distance = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
    cells = knn_join.Cells(pivots, np.bincount(cell, minlength=len(pivots)).astype(float), np.array([distance[cell == c].max(initial=0) for c in range(len(pivots))]))
    q = x[::7]
    low, high = cells.bounds(q)
    score = q @ x.T
    for c in range(len(pivots)):
        assert (score[:, cell == c] >= low[:, [c]]).all() and (score[:, cell == c] <= high[:, [c]]).all()
    assert (np.sort(score, 1)[:, -4] >= cells.floors(low, 3)).all()
