import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from visitorlens.functions import text
from visitorlens.functions.text import ENGLISH_STOP_WORDS
from visitorlens.operators import phrases, scale, terms

STOPS = set(ENGLISH_STOP_WORDS)


def python_grams(text):
    words = re.findall("[a-z]+", (text or "").lower())
    kept = [w for w in words if len(w) > 1 and w not in STOPS]
    return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:], strict=False)]


def python_tfidf(texts, k=20, features=50):
    docs = [Counter(python_grams(t)) for t in texts]
    corpus = sum(docs, Counter())
    vocabulary = sorted(corpus, key=lambda w: (-corpus[w], w))[:features]
    df = {w: sum(w in d for d in docs) for w in vocabulary}
    idf = {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in vocabulary}
    score = defaultdict(float)
    for d in docs:
        weight = {w: d[w] * idf[w] for w in vocabulary if w in d}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        for w, x in weight.items():
            score[w] += x / norm
    return sorted(score.items(), key=lambda p: (-p[1], p[0]))[:k]


@pytest.fixture(scope="module")
def corpus(spark, documents):
    rows = documents.limit(80).collect()
    texts = [r.text for r in rows] + [None, "", "the of and"]
    data = [(f"v{i % 3}", t) for i, t in enumerate(texts)]
    return data, spark.createDataFrame(data, "venue string, review_text string").cache()


def test_tfidf_equals_brute_force(corpus):
    data, df = corpus
    got = [(r.term, r.score) for r in terms.tfidf_top_terms(df).collect()]
    want = python_tfidf([t for _, t in data])
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


@pytest.mark.parametrize("groups", [2_000, 0])
def test_tfidf_per_venue_equals_single_runs(corpus, monkeypatch, groups):
    data, df = corpus
    monkeypatch.setattr(terms, "BROADCAST_ROWS", groups)
    got = defaultdict(list)
    for r in terms.tfidf_top_terms(df, by=["venue"]).collect():
        got[r.venue].append((r.term, round(r.score, 9)))
    for venue in ("v0", "v1", "v2"):
        want = python_tfidf([t for v, t in data if v == venue])
        assert sorted(got[venue]) == sorted((w, round(s, 9)) for w, s in want)


def test_tfidf_of_an_empty_corpus_is_empty(spark):
    empty = spark.createDataFrame([], "venue string, review_text string")
    assert terms.tfidf_top_terms(empty).collect() == []
    assert phrases.phrase_frequency(phrases.candidate_phrases(empty)).collect() == []


def test_same_result_for_any_partitioning(corpus):
    _, df = corpus
    a = terms.term_doc_frequency(df.coalesce(1)).orderBy("term").collect()
    b = terms.term_doc_frequency(df.repartition(8)).orderBy("term").collect()
    assert a == b


def python_rake(texts):
    found = []
    for text in texts:
        run = []
        for w in [*re.findall("[a-z]+", (text or "").lower()), "the"]:
            if w in STOPS:
                if 2 <= len(run) <= 4:
                    found.append(tuple(run))
                run = []
            else:
                run.append(w)
    freq, degree = Counter(), Counter()
    for p in found:
        for w in p:
            freq[w] += 1
            degree[w] += len(p)
    return sorted(
        ((round(sum(degree[w] / freq[w] for w in p), 9), " ".join(p)) for p in found),
        reverse=True,
    )


@pytest.mark.parametrize("hot_keys, sent", [(500, 200_000), (500, 0), (3, 0)])
def test_rake_with_repeats_equals_brute_force(corpus, monkeypatch, hot_keys, sent):
    data, df = corpus
    monkeypatch.setattr(phrases, "BROADCAST_WORDS", sent)
    monkeypatch.setattr(scale.hot_key_join, "__defaults__", (hot_keys,))
    ranked = phrases.repeat_phrases(phrases.rake_phrases(df))
    got = sorted(((round(r.rake, 9), r.phrase) for r in ranked.collect()), reverse=True)
    assert got == python_rake([t for _, t in data])


def test_rake_golden(spark):
    text = "red chair and red wooden chair and lone and one two three four five"
    df = spark.createDataFrame([(text,), ("red red the",)], "review_text string")
    got = {r.phrase: (r.n, r.rake) for r in phrases.rake_phrases(df).collect()}
    red, chair = (2 + 3 + 2 + 2) / 4, 5 / 2
    assert got["red chair"] == (1, pytest.approx(red + chair))
    assert got["red wooden chair"] == (1, pytest.approx(red + 3 + chair))
    assert got["red red"] == (1, pytest.approx(2 * red))
    assert len(got) == 3


def test_repeats_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "REPEAT_CHUNK", 4)
    df = spark.createDataFrame([("a b", 9, 1.0), ("c d", 4, 2.0)], "phrase string, n long, rake double")
    got = phrases.repeat_phrases(df).groupBy("phrase").count().collect()
    assert {r.phrase: r["count"] for r in got} == {"a b": 9, "c d": 4}


def test_phrase_frequency_by_group(spark):
    df = spark.createDataFrame([("a", "p", 4), ("a", "q", 1), ("b", "p", 2)], "venue string, phrase string, n long")
    got = {(r.venue, r.phrase): r.freq for r in phrases.phrase_frequency(df, ["venue"]).collect()}
    assert got == {("a", "p"): 1.0, ("a", "q"): 0.25, ("b", "p"): 1.0}


def test_plans_stay_in_the_jvm_and_shuffle_no_text(corpus):
    _, df = corpus
    plan = terms.tfidf_top_terms(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.select(F.count("*")).first()[0] == 83


@pytest.mark.parametrize("by", [[], ["venue"]])
def test_only_ngrams_between_frequent_words_are_counted(spark, monkeypatch, by):
    """Texts of 400 words in ever new orders: nearly every pair of words is another one."""
    draw = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfghklmp" for b in "aeio" for c in "lmnprstvxz"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(None if i % 3 else "v", " ".join(draw.choices(vocabulary, weights, k=150))) for i in range(200)]
    df = spark.createDataFrame(rows, "venue string, review_text string")
    counted, top = [], terms.top_terms_by_count

    def spied(counts, *given):
        counted.append(counts.count())
        return top(counts, *given)

    monkeypatch.setattr(terms, "top_terms_by_count", spied)
    got = defaultdict(list)
    for r in terms.tfidf_top_terms(df, by=by, max_features=20).collect():
        got[r.venue if by else 0].append((r.term, round(r.score, 9)))
    for venue in ([None, "v"] if by else [0]):
        want = python_tfidf([t for v, t in rows if not by or v == venue], features=20)
        assert sorted(got[venue]) == sorted((w, round(s, 9)) for w, s in want)
    # Before, all distinct n-grams: some ten thousand.
    assert counted and max(counted) <= 2 * (25 + 25 * 25)


def test_tfidf_with_words_of_equal_counts(spark):
    """Ties at the last place of the vocabulary, among words and between words and pairs."""
    texts = ["ab cd ab cd", "ef gh", "ij kl ij kl", "mn op", "ab ef", "zz ab cd", "gh ef op mn", "qr"]
    df = spark.createDataFrame([(t,) for t in texts], "review_text string")
    for features in (1, 2, 3, 5, 8, 13, 50):
        got = [(r.term, round(r.score, 9)) for r in terms.tfidf_top_terms(df, max_features=features).collect()]
        want = python_tfidf(texts, features=features)
        assert sorted(got) == sorted((w, round(s, 9)) for w, s in want)


def counted_reads(spark, data):
    """Reviews and a count of how often one of them was read."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = spark.sparkContext.parallelize(data, 3).map(seen)
    return spark.createDataFrame(rows, "venue string, review_text string"), read


@pytest.mark.parametrize("by", [[], ["venue"]])
def test_rake_reads_the_texts_once(spark, corpus, by):
    data, _ = corpus
    df, read = counted_reads(spark, data)
    scored = phrases.score_phrases(phrases.candidate_phrases(df, by), by)
    assert scored.collect() and read.value == len(data)


@pytest.mark.parametrize("by", [[], ["venue"]])
def test_tfidf_reads_the_texts_twice(spark, corpus, by):
    """Words, then n-grams of frequent words; and once the rows are counted, without their texts."""
    data, _ = corpus
    df, read = counted_reads(spark, data)
    assert terms.tfidf_top_terms(df, by=by).collect() and read.value == 3 * len(data)


@pytest.mark.parametrize("listed", [1_000, 3])
@pytest.mark.parametrize("sizes", [(1, 1), (1, 3), (2, 3)])
def test_tfidf_of_longer_ngrams(corpus, monkeypatch, sizes, listed):
    data, df = corpus
    monkeypatch.setattr(terms, "LISTED_WORDS", listed)

    def grams(text):
        kept = [w for w in re.findall("[a-z]+", (text or "").lower()) if len(w) > 1 and w not in STOPS]
        return [" ".join(kept[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(kept) - n + 1)]

    monkeypatch.setitem(globals(), "python_grams", grams)
    got = sorted((r.term, round(r.score, 9)) for r in terms.tfidf_top_terms(df, sizes=sizes).collect())
    assert got == sorted((w, round(x, 9)) for w, x in python_tfidf([t for _, t in data]))


def test_ngrams_of_listed_words(spark):
    df = spark.createDataFrame([(["aa", "bb", "xx", "aa", "bb", "cc"],), ([],), (None,)], "w array<string>")
    got = [r.g for r in df.select(text.ngrams_of(F.col("w"), ["aa", "bb", "cc"], (2, 3)).alias("g")).collect()]
    assert got[:2] == [["aa bb", "aa bb", "bb cc", "aa bb cc"], []] and not got[2]
