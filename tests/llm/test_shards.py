import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from visitorlens.llm import shards as sh


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 16, 17, 50, 1000, 10_007])
def test_permutation(spark, n):
    got = [r.x for r in sh.permute(spark.range(n).withColumnRenamed("id", "x"), "x", n).collect()]
    assert sorted(got) == list(range(n))
    if n >= 50:
        assert sum(a == b for a, b in enumerate(got)) < n // 5
        assert got != [r.x for r in sh.permute(spark.range(n).withColumnRenamed("id", "x"), "x", n, seed=1).collect()]


def check_law(rows, shards):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_rows_law_on_odd_rows(spark):
    data = [(None, None, "k"), (1, "", "k"), (1, "", "k"), (1, "é" * 100_000, None)] + [(2, "same", "k")] * 40
    data += [(i, f"t{i}", "k") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, shard string")
    rows = sh.shard_report(docs).collect()
    check_law(rows, 16)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_very_many_equal_rows(spark):
    data = [(None, None)] * 700 + [(1, "same")] * 3001 + [(2, "other")] * 100 + [(i, f"t{i}") for i in range(500)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for settings in ({"crowded": 100}, {"crowded": 100, "buckets": 3}, {}):
        rows = sh.shard_rows(docs, 7, **settings).collect()
        check_law(rows, 7)
        assert Counter((r.doc_id, r.text) for r in rows) == Counter(data)
    # No task gets all copies: they are dealt in pieces.
    numbered, n = sh.number_rows(docs, "place", crowded=100)
    assert n == len(data) and sorted(r.place for r in numbered.collect()) == list(range(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = numbered.filter("doc_id = 1").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in parts) < 3001


def test_places_do_not_depend_on_order_or_partitions(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.create_map("id", F.lit(1)).alias("m"), F.lit("z").alias("slot"), F.lit(0).alias("_key"))
    one = {r.doc_id: (r.shard, r.slot) for r in sh.shard_rows(docs.coalesce(1), 7).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in sh.shard_rows(docs.repartition(9).orderBy(F.desc("doc_id")), 7).collect()}
    assert one == two
    check_law(sh.shard_rows(docs, 7).collect(), 7)
    assert sh.shard_rows(docs, 7).columns == ["doc_id", "text", "m", "_key", "shard", "slot"]
    assert sh.shard_rows(docs.limit(0), 7).count() == 0


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = sh.shard_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
