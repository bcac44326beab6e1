from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_quality_rules import plain as plain_counts
from tests.llm.test_simhash import plain_components, plain_fingerprint
from visitorlens.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the results of all stages, each written and read again."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "shard", "slot"]


def test_quality(stages):
    # There are too few labels here to certify a cutoff: the base rules alone decide.
    want = [r for r in rows(stages[0]) if not plain_counts(r[1])[-1]]
    assert Counter(rows(stages[1])) == Counter(want)
    assert 0 < len(want) < stages[0].count()


def test_near_dedup(stages):
    given = rows(stages[1])
    fps = {d: plain_fingerprint(t) for d, t in given}
    of = plain_components([(d, f) for d, f in fps.items()])
    assert Counter(rows(stages[2])) == Counter((d, t) for d, t in given if of[fps[d]] == d)
    assert stages[2].count() < stages[1].count()


def test_decontamination(spark, stages):
    items = [dc.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    runs = {t[i : i + 20] for t in items for i in range(len(t) - 19)}
    kept = set(rows(stages[3]))
    held = 0
    for row in rows(stages[2]):
        text = dc.normalised(row[1])
        if any(t in text for t in items):
            held += 1
            assert row not in kept
        elif runs.isdisjoint(text[i : i + 20] for i in range(len(text) - 19)):
            assert row in kept
    assert held > 0 and kept <= set(rows(stages[2]))


def test_mixing_keeps_every_document(stages):
    copies = Counter(rows(stages[4]))
    assert set(copies) == set(rows(stages[3])) and max(copies.values()) <= 3


def test_sharding(stages):
    placed = stages[5].collect()
    assert Counter((r.doc_id, r.text) for r in placed) == Counter(rows(stages[4]))
    sizes = Counter(r.shard for r in placed)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == cp.N_SHARDS
    assert all({r.slot for r in placed if r.shard == s} == set(range(n)) for s, n in sizes.items())


def test_run_equals_the_stages(spark, stages):
    assert Counter(map(tuple, cp.run(spark, SF).collect())) == Counter(map(tuple, stages[5].collect()))


def test_odd_rows_pass_through(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    text = " ".join(f"word{i}" for i in range(80))
    data = [(None, None, None, "s", 0, "x"), (1, text, None, None, 0, "x"), (1, text, None, None, 0, "x"), (None, text[::-1], "en", "s", 0, None), (2, "", "en", "s", 0, "x"), (3, " ".join(f"long{i}" for i in range(30_000)), "en", "t", 0, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    got = docs.groupBy("doc_id").agg(F.count_distinct("text").alias("n")).collect()
    assert {(r.doc_id, r.n) for r in got} == {(1, 1), (None, 1), (3, 1)}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0 and labels.count() > 0
