import random
import re
from collections import Counter

from pyspark.sql import functions as F

from visitorlens.operators import keywords as kw
from visitorlens.schema import RATING_BUCKETS

WORDS = ["seat", "c++", "+1", "hand rail", "é", "u.s", "\\e", "\\E", "!!", "view", "a_b"]
TEXTS = [
    "The seat, the SEAT and seats", "seaté seat_ seat9", "I like c++ and c++x", "room +1 now a+1",
    "hand rail", "hand  rail, hand-rail", "café é", "in the U.S. or u.s", "path \\E x\\Ey", "wow!!",
    "so!!good", "view!!", "a_b a_bc", "", None, "  ", "!!", "c++", "+1", "nan",
]


def expected(keywords):
    out = Counter()
    for i, text in enumerate(TEXTS):
        for word in keywords:
            if text is not None and re.search(r"\b" + re.escape(word) + r"\b", text.lower()):
                out[word, f"{i % 5 + 1} stars"] += 1
    return dict(out)


def frame(spark):
    rows = [(i, t, f" {i % 5 + 1} Stars ") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "i int, review_text string, rating string")


def counted(df):
    return {(r.keyword, r.rating): r.n for r in df.collect()}


def test_list_equals_regular_expressions(spark):
    assert counted(kw.keyword_mentions(frame(spark), WORDS)) == expected(WORDS)


def test_table_equals_regular_expressions(spark, monkeypatch):
    table = spark.createDataFrame([(w,) for w in [*WORDS, "seat", ""]], "keyword string")
    assert counted(kw.keyword_table_mentions(frame(spark), table)) == expected(WORDS)
    # The same in several passes, each with a part of the table.
    monkeypatch.setattr(kw, "BLOCK_CHARS", 150)
    assert counted(kw.keyword_table_mentions(frame(spark), table)) == expected(WORDS)
    assert counted(kw.keyword_table_mentions(frame(spark), table.limit(0))) == {}


def test_marks_in_texts_and_keywords(spark):
    texts = ["a\x01b", "a\x02ab", "a\x02 b", "a\x01", "\x01b a"]
    words = ["a\x01b", "a\x02ab", "a", "b", "a\x02", "ab"]
    df = spark.createDataFrame([(t, "1 star") for t in texts], "review_text string, rating string")
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = {
        (w, "1 star"): n
        for w in words
        if (n := sum(bool(re.search(r"\b" + re.escape(w) + r"\b", t)) for t in texts))
    }
    assert counted(kw.keyword_table_mentions(df, table)) == want


def test_a_table_of_many_first_words(spark, monkeypatch):
    """Above ten thousand first runs of longer keywords, and the same with the few that occur."""
    df = frame(spark)
    many = [f"w{i} x" for i in range(12_000)] + WORDS
    few = counted(kw.keyword_table_mentions(df, spark.createDataFrame([(w,) for w in WORDS], "keyword string")))
    table = spark.createDataFrame([(w,) for w in many], "keyword string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("table", "before the result")
    result = kw.keyword_table_mentions(df, table)
    before = len(jobs.getJobIdsForGroup("table"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counted(result) == few == expected(WORDS)
    plan = result._jdf.queryExecution().executedPlan().toString()
    # Measuring the table is one query; with adaptive execution a stage is a job of its own.
    assert before <= 3 and "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_report_keeps_unmatched_keywords_and_order(spark):
    df = spark.createDataFrame(
        [("good seat seat", "5 stars"), ("seat", "4.0 stars"), ("view", None)],
        "review_text string, rating string",
    )
    rows = kw.keyword_by_rating(df, ["zzz", "view", "seat"]).collect()
    assert [tuple(r) for r in rows] == [
        ("zzz", 0, 0, 0, 0, 0), ("view", 0, 0, 0, 0, 0), ("seat", 0, 0, 0, 0, 1),
    ]
    assert rows[0].__fields__ == ["keyword", *RATING_BUCKETS]


def test_pivot_total_equals_long_total(spark):
    df = frame(spark)
    words = ["seat", "view", "!!"]
    long = kw.keyword_mentions(df, words).filter(F.col("rating").isin(RATING_BUCKETS))
    wide = kw.keyword_by_rating(df, words, ratings=RATING_BUCKETS)
    total = wide.select(F.sum(sum(F.col(f"`{c}`") for c in RATING_BUCKETS))).first()[0]
    assert total == long.agg(F.sum("n")).first()[0]


def test_text_is_scanned_once_without_python(spark):
    plan = kw.keyword_mentions(frame(spark), ["seat"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Python" not in plan
    assert "NestedLoop" not in plan

def test_keywords_that_begin_alike_meet_only_their_own_texts(spark):
    """Every text holds the first word of all keywords, or the first runs of the long ones."""
    n = 400
    short, long = [f"the w{i}" for i in range(n)], [f"one, two&three &{i}&x" for i in range(n)]
    table = spark.createDataFrame([(w,) for w in short + long], "keyword string")
    rows = [(f"The w{i}. one, two&three &{i}&x one, two&three &{i}&x? THE W{i}", "1 star") for i in range(n)]
    df = spark.createDataFrame(rows, "review_text string, rating string")
    result = kw.keyword_table_mentions(df, table)
    got = result.collect()
    assert {(r.keyword, r.n) for r in got} == {(w, 1) for w in short + long} and len(got) == 2 * n
    # No candidates that a condition has yet to sort out, whose number grows with the table.
    found = joins(result)
    assert found and all(join.condition().isEmpty() for join in found)


def joins(df):
    """Every join of the plan that ran."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif "QueryStage" in kind:
            todo.append(node.plan())
        else:
            if kind.endswith("JoinExec"):
                found.append(node)
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found


def test_long_keywords_between_boundaries(spark, monkeypatch):
    words = ["a b c d", "a b c d!", "b c d!! e", ", c, d, e", "a,b,c,d", "c d", "d e f g h", "ä ö ü ß"]
    texts = ["a b c d", "a b c d!", "A b c d!! e", "a b c d!x", "b, c, d, e", ", c, d, e", "xa b c d", "d e f g hi",
             "d e f g h", "a b c dx a b c d", "Ä Ö ü ß.", "(a,b,c,d)", None, "", "!!", "a b c d a b c d"]
    df = spark.createDataFrame([(t, "1 star") for t in texts], "review_text string, rating string")
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = {
        (w, "1 star"): n
        for w in words
        if (n := sum(bool(re.search(r"\b" + re.escape(w) + r"\b", (t or "").lower())) for t in texts))
    }
    assert counted(kw.keyword_table_mentions(df, table)) == want
    monkeypatch.setattr(kw, "BLOCK_CHARS", 150)
    assert counted(kw.keyword_table_mentions(df, table)) == want
    monkeypatch.setattr(kw, "HASHED_KEYWORDS", 1)
    assert counted(kw.keyword_table_mentions(df, table)) == want


def test_texts_are_cut_once(spark):
    """Nothing of a text or its rating is made again for its windows, and whole texts meet no window pattern."""
    words = ["seat", "c++x", "a-b", "x!", "-y", "a-b-c-d"]
    df = spark.createDataFrame([("A seat, c++x. a-b-c-d x!y", "1 star")], "review_text string, rating string")
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    result = kw.keyword_table_mentions(df, table)
    assert counted(result) == {(w, "1 star"): 1 for w in words if w != "-y"}
    plan = result._jdf.queryExecution().optimizedPlan().toString().splitlines()
    generate = [line for line in plan if "Generate explode(" in line and "array_distinct" in line]
    assert len(generate) == 2 and all("regexp_extract_all(_marked#" in line for line in generate)
    assert not any("regexp_extract_all(_lowered#" in line or "regexp_extract_all(lower(" in line for line in generate)
    first = next(i for i, line in enumerate(plan) if "Generate explode(" in line and "array_distinct" in line)
    assert not any("btrim" in line for line in plan[:first])
    assert not any("Filter" in line and "size(" in line and "regexp" in line for line in plan)


def test_marks_between_any_neighbours(spark):
    """Random texts of few characters: marks that keywords have, marks that none has, words."""
    draw = random.Random(3)
    texts = ["".join(draw.choices("aab\u00e9_1!!--(; .", k=draw.randint(0, 30))) for _ in range(300)]
    words = sorted({"".join(draw.choices("ab\u00e91!!--(", k=draw.randint(1, 7))) for _ in range(300)})
    df = spark.createDataFrame([(t, "1 star") for t in texts], "review_text string, rating string")
    want = {
        (w, "1 star"): n
        for w in words
        if (n := sum(bool(re.search(r"\b" + re.escape(w) + r"\b", t)) for t in texts))
    }
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    assert counted(kw.keyword_table_mentions(df, table)) == want
