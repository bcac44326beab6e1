import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitorlens.llm import exact_topk as ek

SCHEMA = "vec_id long, embedding array<float>, query_id string, score string, v string"


def plain(rows, k=10, every=100):
    """Every query row against every other row, in whole numbers of any size."""
    good = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]))
    out = []
    for at, (i, q) in enumerate(good):
        if i % every == 0:
            found = [(-max(min(sum(a * b for a, b in zip(q, v)), 2**63 - 1), -(2**63)), j) for n, (j, v) in enumerate(good) if n != at and len(v) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def found(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in ek.top_k(df, df.filter(F.col("vec_id") % 100 == 0), **settings).collect())


def vectors(n, d, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"block_values": 20, "slices": 3}, {"slices": 1}, {"k": 3}])
def test_equals_brute_force(spark, settings):
    rows = vectors(620, 7)
    assert found(spark, rows, **settings) == plain(rows, settings.get("k", 10))


def test_ties_and_a_vector_that_very_many_share(spark):
    rows = [(i, v if i % 3 else [0.5, 0.25, -1.0, 2.0, 0.0]) for i, v in vectors(900, 5)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [inf, 0.0]), (4, [0.0, nan]), (5, [-inf, 1.0]), (None, [9.0, 9.0]),
        (6, [3.0]), (7, []), (100, []), (200, [4.0]), (8, [-1.0, 0.5]), (8, [-1.0, 0.5]), (300, [2.0, 2.0]), (300, [2.0, 2.0]),
        (400, [1.0, -1.0]), (400, [5.0, -1.0]), (-100, [0.1, 0.1]),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == [] and found(spark, [(100, [1.0])]) == []


def test_large_components(spark):
    rows = [(i, [x * 1e7 for x in v]) for i, v in vectors(130, 4)]
    rows += [(1000 + i, [x * 2e5 for x in v]) for i, v in vectors(130, 4, 2)]
    rows += [(2000, [3e38, 3e38, 0.0, 1.0]), (2001, [-3e38, -3e38, 0.0, 1.0]), (2002, [1e30, 0.0, 0.0, 0.0])]
    assert found(spark, rows) == plain(rows)


def test_the_cutoff_is_safe_and_leaves_few_entries(spark):
    rows = [(i, [int(x * 1024) for x in v]) for i, v in vectors(5000, 16)]
    block = spark.sparkContext.broadcast(([i for i, _ in rows[::100]], [list(map(float, v)) for _, v in rows[::100]]))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in rows], "id long, v array<double>").repartition(8)
    heads = df.mapInArrow(ek.list_heads(block, 10, 4), "query int, score long").collect()
    by = {}
    for r in heads:
        by.setdefault(r.query, []).append(r.score)
    matrix = np.array([v for _, v in rows])
    for n, (i, v) in enumerate(rows[::100]):
        best = -np.sort(-np.delete(matrix @ np.array(v), i))
        cutoff = sorted(by[n])[-10]
        assert cutoff <= best[9] and (best >= cutoff).sum() < 600
