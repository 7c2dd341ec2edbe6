"""Nearest neighbours against brute force: exact with all lists and no tests, and with a recall of 0.9 as they are."""

import numpy as np
import pytest

from quillon.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, v string, id int"
QUERY = "id % 5 = 0"


def brute(rows, k=5):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max({len(v) for _, v in rows}, key=lambda n: (sum(len(v) == n for _, v in rows), -n))
    rows = sorted({i: v for i, v in rows if len(v) == size}.items())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    length = np.sqrt((x * x).sum(1))
    out = set()
    for at in range(len(x)):
        if ids[at] % 5 == 0:
            score = (x * x[at]).sum(1) / (length * length[at])
            order = [j for j in np.lexsort((ids, -score)) if j != at][:k]
            out |= {(int(ids[at]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    centres = r.standard_normal((12, 24))
    x = (centres[r.integers(0, 12, 600)] + 0.7 * r.standard_normal((600, 24))).astype(np.float32)
    x[100:300] = x[100]  # a hot vector
    x[300:320] = 2 * x[320:340]
    return [(i, v.tolist()) for i, v in enumerate(x)]


def as_set(found):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()}


def test_exact_without_tests(spark, rows):
    own = neighbours.nearest(table(spark, rows), QUERY, probes=99, epsilon=np.inf, block=50)
    assert as_set(own) == brute(rows)


def test_recall(spark, rows):
    want = brute(rows)
    found = as_set(neighbours.nearest(table(spark, rows), QUERY))
    assert len(found) == len(want)
    pairs = lambda x: {(q, i) for q, _, i, _ in x}
    assert len(pairs(found) & pairs(want)) >= 0.9 * len(want)
    scores = {(q, i): s for q, _, i, s in want}
    assert all(s == scores[q, i] for q, _, i, s in found if (q, i) in scores)


def test_odd_tables(spark):
    odd = [(0, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (10, [1.0, None]), (15, [float("nan"), 1.0]), (20, [float("inf"), 1.0]), (None, [1.0, 1.0]), (25, [1.0, 2.0, 3.0]), (7, [1.0, 1.0]), (30, [])]
    found = as_set(neighbours.nearest(table(spark, odd), QUERY))
    assert found == brute(odd) and {q for q, *_ in found} == {0, 5}
    assert neighbours.nearest(table(spark, []), QUERY).collect() == []
    assert neighbours.nearest(table(spark, [(5, [1.0, 2.0])]), QUERY).collect() == []
    assert neighbours.nearest(table(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0])]), QUERY).collect() == []


def test_survivors_are_the_near_ones():
    r = np.random.default_rng(2)
    x, q = (neighbours.unit(r.standard_normal((n, 64))) for n in (3000, 20))
    q = neighbours.unit(x[:20] + 0.3 * q)
    turn = neighbours.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    far = 2 - 2 * q @ x.T
    limit = np.sort(far, axis=1)[:, 5]
    near = set(zip(*np.nonzero(far <= limit[:, None])))
    found = set(zip(*neighbours.survivors(x @ turn, q @ turn, limit, 16, neighbours.EPSILON)))
    assert found <= set(zip(*np.nonzero(far <= limit[:, None] + 1e-4)))
    assert len(near & found) >= 0.98 * len(near)
