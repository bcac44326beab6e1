import datetime

from pyspark.sql import functions as F

from visitorlens.operators import progress as pr

ADDED = {"v": [2, 0, 0, 3, 0, 0, 0, 1], "w": [0, 0, 5]}
OLDEST = {"v": [5, None, 1, None, None, 1, 1, 1], "w": [None, None, 9]}


def table(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (v, start + datetime.timedelta(minutes=i), 9, n,
         None if OLDEST[v][i] is None else datetime.date(2024, 1, OLDEST[v][i]))
        for v, ns in ADDED.items() for i, n in enumerate(ns)
    ]
    return spark.createDataFrame(
        rows, "venue string, batch timestamp, n_rows long, n_added long, oldest_date date"
    )


def by_venue(df, column):
    out = {}
    for r in df.orderBy("venue", "batch").collect():
        out.setdefault(r.venue, []).append(r[column])
    return out


def test_running_total_and_carried_date(spark):
    df = pr.progress(table(spark))
    assert by_venue(df, "total_added") == {"v": [2, 2, 2, 5, 5, 5, 5, 6], "w": [0, 0, 5]}
    seen = by_venue(df, "oldest_seen")
    assert [d and d.day for d in seen["v"]] == [5, 5, 1, 1, 1, 1, 1, 1]
    assert [d and d.day for d in seen["w"]] == [None, None, 9]


def test_streak_resets_on_growth(spark):
    df = pr.stagnation_streak(table(spark))
    assert by_venue(df, "stagnant") == {"v": [0, 1, 2, 0, 1, 2, 3, 0], "w": [1, 2, 0]}


def stops(df):
    return {
        r.venue: (r.batch.minute, r.total_added, r.stop_reason) for r in df.collect()
    }


def test_stop_rules_and_precedence(spark):
    df = table(spark)
    cutoff = F.lit("2024-01-03").cast("date")
    assert stops(pr.stop_reason(df, 5, 35)) == {"v": (3, 5, "target"), "w": (2, 5, "target")}
    assert stops(pr.stop_reason(df, None, 3)) == {"v": (6, 5, "stagnant")}
    assert stops(pr.stop_reason(df, None, 35, cutoff, 2)) == {"v": (5, 5, "cutoff")}
    assert stops(pr.stop_reason(df, None, 35, cutoff, 1)) == {"v": (2, 2, "cutoff")}
    assert stops(pr.stop_reason(df, 5, 35, max_seconds=119)) == {
        "v": (2, 2, "time"), "w": (2, 5, "time"),
    }
    assert stops(pr.stop_reason(df, 100, 35)) == {}


def test_state_is_the_latest_pass(spark):
    df = pr.progress_state(table(spark).select("venue", F.minute("batch").alias("batch"), "n_added"))
    got = {r.venue: r.state for r in df.collect()}
    assert got == {"v": '{"batch":7,"n_added":1}', "w": '{"batch":2,"n_added":5}'}
