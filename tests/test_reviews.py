import datetime

import pytest
from pyspark.sql import functions as F

from visitorlens.operators import reviews as rv
from visitorlens.schema import MissingColumnsError, REVIEW_COLUMNS, check_columns

RAW = (
    "ingest_seq long, venue string, id string, author string, rating string, date string, "
    "text string, is_local_guide boolean, reviewer_total_reviews string"
)


def day(iso):
    return F.lit(iso).cast("date")


def raw_rows(spark, rows):
    full = [
        (i, r.get("venue", "v"), r.get("id"), r.get("author"), r.get("rating", "5 stars"),
         r.get("date", "today"), r.get("text"), r.get("guide"), r.get("total"))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, RAW)


def normalized(spark, rows):
    return rv.normalize_reviews(raw_rows(spark, rows), day("2024-06-15"))


def test_normalize(spark):
    row = normalized(
        spark,
        [{"id": " r1 ", "author": " Â Ann ", "text": " fineâ€¦ ", "date": "a year ago",
          "guide": None, "total": "1,204"}],
    ).first()
    assert (row.review_id, row.reviewer_name, row.review_text) == ("r1", " Ann", "fine…")
    assert (row.review_date, row.review_dt) == ("2023-06-15", datetime.date(2023, 6, 15))
    assert (row.is_local_guide, row.reviewer_total_reviews) == (False, 1204)
    assert row.review_key == "id:r1"
    empty = normalized(spark, [{"id": "", "author": " ", "date": "", "text": None, "total": "x"}]).first()
    assert [empty[c] for c in REVIEW_COLUMNS] == [None, None, None, False, "5 stars", None, None]


def test_fallback_key_is_collision_free_and_uses_80_characters(spark):
    rows = [
        {"author": "ab", "rating": "c", "text": "x" * 80 + "1"},
        {"author": "ab", "rating": "c", "text": "x" * 80 + "2"},
        {"author": "a", "rating": "bc", "text": "x" * 80},
        {"author": "ab", "rating": "c", "text": "x" * 79},
    ]
    keys = [r.review_key for r in normalized(spark, rows).orderBy("ingest_seq").collect()]
    assert keys[0] == keys[1]
    assert len(set(keys)) == 3


def test_first_seen_and_longest(spark):
    df = normalized(
        spark,
        [{"id": "a", "text": "cut…"}, {"id": "a", "text": "the whole text"}, {"id": "b", "text": "t"}],
    )
    first = {r.review_key: r.review_text for r in rv.first_seen(df).collect()}
    assert first == {"id:a": "cut…", "id:b": "t"}
    longest = {r.review_key: r.review_text for r in rv.first_seen(df, prefer="longest").collect()}
    assert longest == {"id:a": "the whole text", "id:b": "t"}
    again = rv.first_seen(rv.first_seen(df))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(
        map(tuple, rv.first_seen(df).collect()), key=str
    )
    with pytest.raises(ValueError):
        rv.first_seen(df, prefer="last")


def test_first_seen_merges_a_hot_key_before_the_shuffle(spark):
    df = normalized(spark, [{"id": "hot", "text": "t"}] * 3 + [{"id": "b", "text": "t"}])
    plan = rv.first_seen(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "partial_min_by" in plan


def test_new_reviews_filters_before_choosing(spark):
    incoming = normalized(
        spark,
        [
            {"id": "old", "text": "t", "date": "Jan 2020"},
            {"id": "old", "text": "later copy in range"},
            {"id": "known", "text": "t"},
            {"text": "", "author": ""},
            {"id": "odd", "text": "t", "date": "2 hours ago"},
        ],
    )
    stored = normalized(spark, [{"id": "known", "text": "x"}])
    got = rv.new_reviews(incoming, stored, day("2022-01-01")).orderBy("ingest_seq").collect()
    assert [(r.review_id, r.ingest_seq) for r in got] == [("old", 1), ("odd", 4)]


def test_cap_is_exact_and_respects_stored_rows(spark):
    rows = [{"venue": "hot", "id": f"h{i}", "text": "t"} for i in range(40)]
    rows += [{"venue": "small", "id": f"s{i}", "text": "t"} for i in range(3)]
    df = normalized(spark, rows).repartition(7)
    held = spark.createDataFrame([("hot", 4), ("full", 9)], "venue string, n_stored long")
    got = rv.cap_per_venue(df, 9, held).orderBy("venue", "ingest_seq").collect()
    assert [(r.venue, r.ingest_seq) for r in got] == [
        *(("hot", i) for i in range(5)),
        *(("small", i) for i in range(40, 43)),
    ]


def test_sample_gate_fails_only_full_and_empty_samples(spark):
    rows = [{"venue": "bad", "id": f"{i}", "text": "t" if i < 2 else " "} for i in range(25)]
    rows += [{"venue": "short", "id": f"s{i}"} for i in range(19)]
    rows += [{"venue": "good", "id": f"g{i}", "text": "t" if i < 3 else None} for i in range(20)]
    got = {r.venue: (r.n_sample, r.n_nonempty, r.passed) for r in rv.sample_gate(normalized(spark, rows)).collect()}
    assert got == {"bad": (20, 2, False), "short": (19, 0, True), "good": (20, 3, True)}


def test_check_columns(spark):
    df = spark.createDataFrame([("x",) * 8], [*REVIEW_COLUMNS, "extra"])
    assert check_columns(df) is df
    with pytest.raises(MissingColumnsError, match="rating"):
        check_columns(df.drop("rating", "review_id"))
