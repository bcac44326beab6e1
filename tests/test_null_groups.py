"""A null group is a group like any other."""

import pytest

from visitorlens.operators import keywords, phrases, progress, reviews, scale, terms

ROWS = [(v, "seat seat hall", "5 stars", i) for i, v in enumerate([None, None, "v", "v", "v"])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "venue string, review_text string, rating string, ingest_seq int")


def test_pivot(df):
    got = keywords.keyword_by_rating(df, ["seat"], by=["venue"]).collect()
    assert {r.venue: r["5 stars"] for r in got} == {None: 2, "v": 3}


@pytest.mark.parametrize("broadcast_rows", [2_000, 0])
def test_tfidf(df, monkeypatch, broadcast_rows):
    monkeypatch.setattr(terms, "BROADCAST_ROWS", broadcast_rows)
    got = terms.tfidf_top_terms(df, by=["venue"]).collect()
    assert {r.venue for r in got} == {None, "v"}


def test_phrase_frequency(spark):
    found = spark.createDataFrame([(None, "a b", 2), (None, "c d", 1), ("v", "a b", 4)], "venue string, phrase string, n long")
    got = phrases.phrase_frequency(found, by=["venue"]).collect()
    assert {(r.venue, r.phrase): r.freq for r in got} == {(None, "a b"): 1.0, (None, "c d"): 0.5, ("v", "a b"): 1.0}


def test_added(spark):
    seen = spark.createDataFrame([(None, 0, 5), ("v", 0, 5)], "venue string, batch int, n_rows int")
    added = spark.createDataFrame([(None, 0), (None, 0)], "venue string, batch int")
    got = progress.with_added(seen, added).collect()
    assert {r.venue: r.n_added for r in got} == {None: 2, "v": 0}


@pytest.mark.parametrize("small", [True, False])
def test_cap_is_exact_for_equal_positions(spark, monkeypatch, small):
    monkeypatch.setattr(reviews, "is_small", lambda df: small)
    rows = [(v, 7, "k", f"t{i}") for v in (None, "v") for i in range(3)] + [("v", 1, "k", "first")]
    df = spark.createDataFrame(rows, "venue string, ingest_seq int, review_key string, review_text string")
    got = reviews.cap_per_venue(df, 2).collect()
    assert sorted([(r.venue, r.ingest_seq) for r in got], key=repr) == sorted([(None, 7), (None, 7), ("v", 1), ("v", 7)], key=repr)
    already = spark.createDataFrame([(None, 1)], "venue string, n_stored int")
    assert sum(r.venue is None for r in reviews.cap_per_venue(df, 2, already).collect()) == 1


def test_slices_do_not_overflow(spark):
    df = spark.range(1000)
    got = {r.s for r in df.select(scale._slice_of(df, 7).alias("s")).collect()}
    assert got == set(range(7))
