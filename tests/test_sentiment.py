import math
import re

import pytest
from pyspark.sql import functions as F

from visitorlens.functions.scores import label_sentiment
from visitorlens.operators import sentiment as sn

LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "kind": 2.4, "love": 3.2, "dull": -1.7}
SPEC = sn.SentimentWords(LEXICON)


def norm(s):
    return round(s / math.sqrt(s * s + 15), 4)


GOLDEN = [
    ("it is good", norm(1.9)),
    ("it is good, really", norm(1.9)),
    ("(good)", 0.0),
    ("a good view and bad seats", norm(1.9 - 2.5)),
    ("very good", norm(1.9 + 0.293)),
    ("very very good", norm(1.9 + 0.293 + 0.293 * 0.95)),
    ("slightly good", norm(1.9 - 0.293)),
    ("very bad", norm(-2.5 - 0.293)),
    ("it is VERY good", norm(1.9 + 0.293 + 0.733)),
    ("it is GOOD", norm(1.9 + 0.733)),
    ("IT IS GOOD", norm(1.9)),
    ("not good", norm(1.9 * -0.74)),
    ("it isn't good", norm(1.9 * -0.74)),
    ("not really good", norm((1.9 + 0.293) * -0.74)),
    ("never so good", norm((1.9 + 0.293) * 1.5)),
    ("it was never this good", norm(1.9 * 1.5 * 1.25)),
    ("least good", norm(1.9 * -0.74)),
    ("at least good", norm(1.9)),
    ("good but bad", norm(1.9 * 0.5 - 2.5 * 1.5)),
    ("it was kind of them", 0.0),
    ("a kind host", norm(2.4)),
    ("it is good!!", norm(1.9 + 2 * 0.292)),
    ("it is bad !!!!!!", norm(-2.5 - 4 * 0.292)),
    ("is it good??", norm(1.9 + 2 * 0.18)),
    ("is it good?????", norm(0.0)),
    ("is it good? ????", norm(1.9 + 0.96)),
    ("good not x good", norm(1.9 + 1.9)),
    ("plain words only!!!", 0.0),
    ("", 0.0),
    ("   ", 0.0),
    (None, 0.0),
]


def frame(spark):
    return spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, review_text string")


def test_golden(spark):
    got = {r.i: r.compound for r in sn.sentiment_scores(frame(spark), SPEC).collect()}
    wrong = [(GOLDEN[i], got[i]) for i in got if abs(got[i] - GOLDEN[i][1]) > 1e-9]
    assert wrong == []


def test_lexicon_table_small_and_large_agree(spark):
    table = spark.createDataFrame(list(LEXICON.items()), "term string, valence double")
    spec = sn.SentimentWords(table)
    want = {r.i: r.compound for r in sn.sentiment_scores(frame(spark), SPEC).collect()}
    assert {r.i: r.compound for r in sn.sentiment_scores(frame(spark), spec).collect()} == want
    joined = sn.score_with_lexicon_table(frame(spark), spec, "review_text", sn.lexicon_entries(table))
    assert joined.columns == ["i", "review_text", "compound"]
    assert {r.i: r.compound for r in joined.collect()} == want


def test_repeated_terms_and_lexicon_sizes_have_one_rule(spark, monkeypatch):
    twice = [(t, v + d) for t, v in LEXICON.items() for d in (-0.5, 0.5)] + [(None, 1.0), ("x", None)]
    table = spark.createDataFrame(twice, "term string, valence double")
    rows = frame(spark).unionAll(frame(spark))
    scored = [sn.sentiment_scores(rows, s) for s in (SPEC, sn.SentimentWords(table))]
    monkeypatch.setattr(sn, "MAX_CONSTANT_BYTES", 30)
    scored += [sn.sentiment_scores(rows, s) for s in (SPEC, sn.SentimentWords(table))]
    results = [sorted((r.i, round(r.compound, 4)) for r in s.collect()) for s in scored]
    assert results[0] == results[1] == results[3] and len(results[0]) == 2 * len(GOLDEN)


def test_a_lexicon_of_usual_size_and_an_empty_one(spark):
    many = {**{f"term{i}é": (i % 80 - 40) / 10 for i in range(7500)}, **LEXICON}
    for words in (many, spark.createDataFrame(list(many.items()), "term string, valence double")):
        got = {r.i: r.compound for r in sn.sentiment_scores(frame(spark), sn.SentimentWords(words)).collect()}
        assert [i for i in got if abs(got[i] - GOLDEN[i][1]) > 1e-9] == []
    nothing = sn.sentiment_scores(frame(spark), sn.SentimentWords({}))
    assert {r.compound for r in nothing.collect()} == {0.0}


def test_labels_conserve_rows_and_columns(spark):
    labelled = sn.sentiment_labels(frame(spark), SPEC)
    assert labelled.columns == ["i", "review_text", "sentiment"]
    row = sn.sentiment_conservation(labelled).first()
    assert (row.n_rows, row.n_labelled, row.conserved) == (len(GOLDEN), len(GOLDEN), True)
    counts = sn.sentiment_counts(labelled).collect()
    assert sum(r.n for r in counts) == len(GOLDEN)
    assert [r.n for r in counts] == sorted((r.n for r in counts), reverse=True)


def test_thresholds_are_inclusive(spark):
    values = [-0.05, -0.0499, 0.0, 0.0499, 0.05, None]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = [r.s for r in df.select(label_sentiment(F.col("c")).alias("s")).collect()]
    assert got == ["Negative", "Neutral", "Neutral", "Neutral", "Positive", "Neutral"]


def test_edge_marks(spark):
    words = ["good,", "good!!", '"good', "(good)", "g!", "don't,", "...good", "good?!?"]
    pattern = re.compile(sn.edge_mark_pattern())
    want = [pattern.sub(lambda m: m.group(1) or m.group(2), w) for w in words]
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    assert df.select(sn.sentiment_tokens(F.col("t"))).first()[0] == want
    assert want == ["good", "good", "good", "(good)", "g!", "don't,", "...good", "good"]


def test_plan_is_one_narrow_pass(spark):
    plan = sn.sentiment_labels(frame(spark), SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
