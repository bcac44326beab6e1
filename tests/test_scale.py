from pyspark.sql import functions as F

from visitorlens.operators import scale


def skewed(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(300)]
    return spark.createDataFrame(rows, "k string, i long")


def test_salted_join_keeps_every_row(spark):
    big = skewed(spark)
    side = big.select("k").distinct().withColumn("v", F.length("k"))
    got = scale.salted_join(big, side, ["k"])
    assert got.count() == 300
    assert got.filter(F.length("k") != F.col("v")).count() == 0


def test_copies_of_one_row_are_spread(spark):
    copies = spark.range(0, 400, 1, 8).select(F.lit("hot").alias("k"))
    slices = copies.select(scale._slice_of(copies, 16).alias("s")).groupBy("s").count().collect()
    assert len(slices) == 8


def test_hot_key_join_equals_plain_join(spark):
    big = skewed(spark)
    stats = big.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("i").alias("top"))
    want = sorted(map(tuple, big.join(stats, "k").collect()))
    for hot_keys in (1, 2, 50, 10_000):
        got = scale.hot_key_join(big, stats, "k", "w", hot_keys)
        assert sorted(map(tuple, got.select("k", "i", "w", "top").collect())) == want


def test_top_per_group_in_slices(spark):
    df = skewed(spark)
    want = sorted(map(tuple, scale.top_per_group(df, ["k"], [F.desc("i")], 5, "rank").collect()))
    got = scale.top_per_group(df, ["k"], [F.desc("i")], 5, "rank", salts=7)
    assert sorted(map(tuple, got.collect())) == want
    assert [r[2] for r in want if r[0] == "hot"] == [5, 4, 3, 2, 1]


def test_is_small(spark):
    assert scale.is_small(spark.range(5), 5)
    assert not scale.is_small(spark.range(6), 5)
    wide = spark.range(3).selectExpr("repeat('x', 1000) AS t", "array(binary('y')) AS b")
    assert scale.is_small(wide, 5, 5000) and not scale.is_small(wide, 5, 3000)
    assert scale.is_small(spark.range(0)) and scale.is_small(spark.range(5).select())
