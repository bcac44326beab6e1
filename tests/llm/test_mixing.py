import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from visitorlens.llm import mixing as mx


def plain_exponent(counts, max_repeats, entropy, budget=None):
    """Plain bisection with one exponent at a time."""
    shares = [c / sum(counts) for c in counts if c]

    def meets(a):
        total = sum(p**a for p in shares)
        weights = [p**a / total for p in shares]
        h = -sum(w * math.log(w) for w in weights)
        if entropy is not None and len(shares) > 1 and h > entropy * math.log(len(shares)) + 1e-12:
            return False
        dealt = budget or max(p / w for p, w in zip(shares, weights))
        return max_repeats is None or max(dealt * w / p for p, w in zip(shares, weights)) <= max_repeats * (1 + 1e-12)

    if not shares or not meets(1.0):
        return 1.0
    if meets(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (low, mid) if meets(mid) else (mid, high)
    return high


@pytest.mark.parametrize(
    "counts, repeats, entropy, budget",
    [([700, 100, 100, 50], 2.0, 0.95, None), ([700, 100, 3], None, 0.9, None), ([700, 100, 3], 4.0, None, 2.0), ([5], 2.0, 0.95, None),
     ([10, 10, 10], 2.0, None, None), ([10, 10, 10], 2.0, 0.5, None), ([1000, 1], 1.01, None, None), ([9, 1], 1.5, None, 3.0), ([], 2.0, 0.9, None)],
)
def test_exponent_as_plain_bisection(spark, counts, repeats, entropy, budget):
    rows = [(c / sum(counts),) for c in counts]
    got = mx.solve_exponent(spark.createDataFrame(rows, "share double"), budget, repeats, entropy)
    assert math.isclose(got, plain_exponent(counts, repeats, entropy, budget), abs_tol=1e-8)


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["hot"] * 6 + ["a", "b", "c", None])) for i in range(3000)]
    rows += [(5000, None, "hot"), (None, "x y", "a"), (None, "x y", "a"), (5001, "", "empty"), (5002, "w " * 3000, "b")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"max_repeats": 3.5, "entropy": None}, {"budget_tokens": 20_000}, {"budget_tokens": 150_000, "max_repeats": 9.0}])
def test_budgets_are_kept(spark, settings):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, epoch int")
    digests = mx._digests(docs, "doc_id", "text", "source")
    weighed = {r.source: r for r in mx.weigh_sources(digests, **settings).collect()}
    assert math.isclose(sum(r.weight for r in weighed.values()), 1)
    words = {r[0:1] + r[2:]: len((r[1] or "").split()) for r in rows}
    total = Counter()
    for r in rows:
        total[r[2]] += len((r[1] or "").split())
    assert {s: r.tokens for s, r in weighed.items()} == total
    got = mx.mix_sources(docs, **settings)
    assert set(got.columns) == {"doc_id", "text", "source", "epoch", "position"}
    got = got.collect()
    largest = Counter()
    for p in digests.groupBy("source", "block", "part").agg(F.sum("tokens").alias("t")).collect():
        largest[p.source] = max(largest[p.source], p.t)
    taken, by_epoch = Counter(), Counter()
    for r in got:
        taken[r.source] += len((r.text or "").split())
        by_epoch[r.source, r.epoch] += 1
        assert 0 <= r.position <= 1
    rows_of = Counter(r[2] for r in rows)
    for s, w in weighed.items():
        if w.tokens:
            assert w.budget - largest[s] - 1 < taken[s] <= w.budget + 1e-3, s
        for e in range(w.passes):
            assert by_epoch[s, e] == rows_of[s]
        assert not any(by_epoch[s, e] for e in range(w.passes + 1, 20))
    if "budget_tokens" not in settings:
        assert all(w.passes >= 1 for w in weighed.values())
        assert {r.doc_id for r in got} == {r[0] for r in rows}
    # No row twice in a pass.
    assert max(Counter((r.doc_id, r.epoch) for r in got if r.doc_id is not None).values()) == 1
    again = mx.mix_sources(docs.repartition(7), **settings).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_passes_have_orders_of_their_own(spark):
    docs = spark.createDataFrame(corpus(2), "doc_id long, text string, source string")
    got = mx.mix_sources(docs, entropy=None, max_repeats=3.0).filter("source = 'c'").collect()
    orders = [[r.doc_id for r in sorted(got, key=lambda r: (r.position, r.doc_id)) if r.epoch == e] for e in (0, 1)]
    assert orders[0] != orders[1] and set(orders[1]) <= set(orders[0])


def test_columns_of_any_name_pass_through(spark):
    names = ["_plan_source", "_plan_block", "_plan_part", "tokens", "block", "start"]
    rows = [(i, "a few words of text", "st"[i % 2], *names) for i in range(20)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    got = mx.mix_sources(docs)
    assert got.columns == [*docs.columns, "epoch", "position"]
    assert {tuple(r)[:-2] for r in got.collect()} == set(rows)


def test_empty_and_native(spark):
    docs = spark.createDataFrame(corpus()[:50], "doc_id long, text string, source string")
    assert mx.mix_sources(docs.limit(0)).count() == 0
    plan = mx.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
