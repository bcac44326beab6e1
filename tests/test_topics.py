import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitorlens.operators import topics as tp
from visitorlens.plans import queries

RNG = np.random.default_rng(7)
ITEMS = [(f"i{i}", [float(x) for x in RNG.normal(size=8)], i / 40) for i in range(40)]
ITEMS += [("zero", [0.0] * 8, 0.0)]
SEEDS = [("ab"[i % 2], [float(x) for x in RNG.normal(size=8)]) for i in range(9)]


def frames(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, embedding array<float>, freq double")
    return items, spark.createDataFrame(SEEDS, "topic string, embedding array<double>")


def expected():
    out = {}
    for name, v, _ in ITEMS:
        v = np.array(v, dtype="float32").astype("float64")
        for topic in "ab":
            sims = [
                v @ np.array(s) / (np.linalg.norm(v) * np.linalg.norm(s)) if v.any() else 0.0
                for t, s in SEEDS
                if t == topic
            ]
            out[name, topic] = max(sims)
    return out


@pytest.mark.parametrize("block", [2_000, 4, 1])
def test_similarity_equals_numpy_in_any_blocks(spark, block):
    items, seeds = frames(spark)
    rows = tp.seed_similarity(items, seeds, block=block).collect()
    got = {(r.item_id, r.topic): r.similarity for r in rows}
    assert len(rows) == len(got) == 82
    assert got == pytest.approx(expected(), abs=1e-6)


@pytest.mark.parametrize("weights", [0.7, {"a": 0.2, "b": 0.9}])
def test_assignment_in_the_row_equals_the_two_steps(spark, weights):
    items, seeds = frames(spark)
    items = items.withColumn("freq", F.when(F.length("item_id") % 2 == 0, 0.4))
    want = tp.topic_items(tp.seed_similarity(items, seeds), ["b", "a"], semantic_weight=weights)
    got = tp.assign_topics(items, seeds, ["b", "a"], semantic_weight=weights)
    key = lambda df: sorted((r.item_id, r.topic, round(r.score, 9)) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) > 3
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert tp.assign_topics(items, seeds.limit(0), ["a"]).count() == 0


def test_null_vector_and_no_seeds(spark):
    items, seeds = frames(spark)
    null = items.limit(1).withColumn("embedding", F.lit(None).cast("array<float>"))
    for block in (2_000, 1):
        twice = tp.seed_similarity(null.unionAll(null), seeds, block=block).collect()
        assert {r.similarity for r in twice} == {0.0} and len(twice) == 4
    assert tp.seed_similarity(items, seeds.limit(0)).count() == 0


def test_assignment_threshold_and_ties(spark):
    rows = [
        ("tie", "ux", 0.5, 0.0), ("tie", "arch", 0.5, 0.0),
        ("arch", "ux", 0.4, 0.9), ("arch", "arch", 0.6, 0.9),
        ("edge", "ux", 0.5, 0.0), ("edge", "arch", 0.1, 0.0),
        ("low", "ux", 0.49, 0.0), ("low", "arch", 0.1, 0.0),
        ("nofreq", "ux", 0.6, None), ("nofreq", "arch", 0.1, None),
    ]
    df = spark.createDataFrame(rows, "item_id string, topic string, similarity double, freq double")
    got = {r.item_id: (r.topic, round(r.score, 6)) for r in tp.topic_items(df, ["ux", "arch"]).collect()}
    assert got == {
        "tie": ("ux", 0.35), "arch": ("arch", 0.69), "edge": ("ux", 0.35), "nofreq": ("ux", 0.42),
    }
    weights = tp.topic_items(df, ["ux", "arch"], semantic_weight={"ux": 1.0, "arch": 0.0})
    assert {r.item_id for r in weights.collect() if r.topic == "ux"} >= {"tie", "low"}


def test_top_items_rank(spark):
    df = spark.createDataFrame(
        [("a", "t", 0.5, 1.0), ("b", "t", 0.5, 2.0), ("c", "t", 0.9, 0.0), ("d", "u", 0.4, 0.0)],
        "item_id string, topic string, score double, rake double",
    )
    got = tp.topic_top_items(df, 2, [F.desc("rake")]).orderBy("topic", "rank").collect()
    assert [(r.topic, r.rank, r.item_id) for r in got] == [("t", 1, "c"), ("t", 2, "b"), ("u", 1, "d")]


def test_hashed_embedding_prefers_shared_spelling(spark):
    phrases = spark.createDataFrame(
        [("parking garage", 1, 1.0, 1.0), ("seating layout", 1, 1.0, 1.0), ("zzqx", 1, 1.0, 0.1)],
        "phrase string, n long, rake double, freq double",
    )
    got = {r.phrase: r.topic for r in tp.phrase_topics(phrases, tp.embed_hashed).collect()}
    assert got == {"parking garage": "ux", "seating layout": "architecture"}


def test_phrase_topics_read_the_texts_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    texts = [(f"the parking garage {i % 7} and seating layout and the staff of it",) for i in range(40)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(texts, 2).map(seen), "review_text string")
    monkeypatch.setattr(queries.fx, "texts", lambda spark, sf: df)
    assert queries.QUERIES["phrase_topic_hashed"](spark, "").collect()
    assert read.value == len(texts)


def test_hashed_trigrams_equal_brute_force(spark):
    texts = ["", None, "a", "Ab", "é😀 x", "aaaaaaa", "red chair", "\n", "seating layout"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for dimensions in (512, 40):
        for r in tp.embed_hashed(df, "t", dimensions).collect():
            padded, want = f" {(r.t or '').lower()} ", [0] * dimensions
            codes = [*map(ord, padded), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:] if len(padded) > 2 else [0], strict=False):
                if len(padded) == 2 or c:
                    want[(a * 961 + b * 31 + c) % dimensions] += 1
            norm = math.sqrt(sum(n * n for n in want))
            assert r.embedding == [n / norm for n in want]
