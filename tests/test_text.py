import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitorlens.functions import text as t


def one(spark, value, fn):
    schema = "v array<string>" if isinstance(value, list) else "v string"
    return spark.createDataFrame([(value,)], schema).select(fn(F.col("v"))).first()[0]


def many(spark, values, fn):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", fn(F.col("v")).alias("o"))
    return [r.o for r in df.orderBy("i").collect()]


def python_clean(value):
    if value is None:
        return ""
    return re.sub(r"\s+", " ", re.sub(r"[^a-z\s]", " ", value.lower())).strip()


TEXTS = [
    None,
    "",
    "   ",
    "Great SEATS, bad parking!!",
    "tab\tand\nnewline é à",
    "naïve—dash 123 abc",
    "  x 　",
    "a" * 50,
]


def test_clean_text_equals_two_step_rule(spark, documents):
    texts = TEXTS + [r.text for r in documents.limit(60).collect()]
    assert many(spark, texts, t.clean_text) == [python_clean(x) for x in texts]


def test_strip_equals_python(spark):
    texts = [f"{c}x y{c}" for c in t.WHITESPACE] + ["", "  ", "x"]
    assert many(spark, texts, t.strip) == [x.strip() for x in texts]
    assert one(spark, None, t.strip) == ""


def test_mojibake_order(spark):
    texts = ["wait‚Ä¶", "waitâ€¦", "Âgood", "Ânimo Â", None]
    assert many(spark, texts, t.fix_mojibake) == ["wait…", "wait…", "good", "nimo ", None]


def test_truncated(spark):
    texts = ["cut...", "cut… ", "whole.", "", None]
    assert many(spark, texts, t.looks_truncated) == [True, True, False, False, False]


def test_stars(spark):
    texts = [" 4 Stars ", "1 star", "4.0 stars", "6 stars", None]
    assert many(spark, texts, t.stars) == [4, 1, None, None, None]


def test_tokens_and_ngrams_bridge_stop_words(spark):
    text = "The view of the stage was a great view"
    tokens = one(spark, text, t.content_tokens)
    assert tokens == ["view", "stage", "great", "view"]
    grams = one(spark, tokens, t.ngrams)
    assert grams == [*tokens, "view stage", "stage great", "great view"]
    assert one(spark, ["a", "b", "c"], lambda c: t.ngrams(c, (2, 3))) == ["a b", "b c", "a b c"]
    assert one(spark, ["a"], t.ngrams) == ["a"]
    assert one(spark, [], t.ngrams) == []


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(words=st.lists(st.sampled_from(["a", "b", "aa", "é", "c d"]), max_size=12))
def test_count_terms_is_a_counter(spark, words):
    got = one(spark, words, t.count_terms)
    assert {r.term: r.tf for r in got} == dict(Counter(words))
    assert len(got) == len(set(words))


def test_split_phrases(spark):
    text = "the big red chair, and a very nice old wooden stage door of one seat"
    expected = ["big red chair", "nice old wooden stage door", "one seat"]
    got = one(spark, text, lambda c: t.split_phrases(c, max_words=5))
    assert got == expected
    assert one(spark, text, t.split_phrases) == ["big red chair", "one seat"]
    assert one(spark, None, t.split_phrases) == []


def test_stop_word_lists(spark):
    assert len(t.ENGLISH_STOP_WORDS) == len(set(t.ENGLISH_STOP_WORDS)) == 179
    assert {"the", "d", "ll"} <= set(t.spark_stop_words(spark))
