import tempfile
import time

import pytest
from pyspark.sql import functions as F

from visitorlens.operators.reviews import new_reviews, normalize_reviews
from visitorlens.plans import fixtures as fx
from visitorlens.sources.files import compact_reviews, latest_progress, progress_rows, with_timings
from visitorlens.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark):
    """Raw records of the fixture in four files, written one after the other."""
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/raw"
    raw = fx.raw_records(spark, SF)
    for part in range(4):
        chunk = raw.filter(F.floor(F.col("ingest_seq") / 50) == part)
        chunk.coalesce(1).sortWithinPartitions("ingest_seq").write.mode("append").parquet(path)
    return path, raw


def run(spark, path, schema, root, files=1, **options):
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    )
    query = ingest.ingest_stream(
        stream, root + "/table", fx.as_of(), fx.cutoff(), root + "/checkpoint",
        progress_path=root + "/progress", **options,
    )
    query.awaitTermination()
    return [p for p in query.recentProgress if p["numInputRows"]]


def expected(spark, raw):
    rows = normalize_reviews(raw, fx.as_of())
    return new_reviews(rows, rows.limit(0), fx.cutoff(), ingest.KEYS)


def test_batches_equal_one_pass_and_rerun_adds_nothing(spark, source):
    path, raw = source
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    assert len(run(spark, path, raw.schema, root)) == 4
    want = sorted(r.ingest_seq for r in expected(spark, raw).select("ingest_seq").collect())

    def stored():
        return sorted(r.ingest_seq for r in spark.read.parquet(root + "/table").select("ingest_seq").collect())

    assert stored() == want
    # The same checkpoint has nothing left; a lost checkpoint reads everything again.
    run(spark, path, raw.schema, root)
    assert stored() == want
    query = ingest.ingest_stream(
        spark.readStream.schema(raw.schema).parquet(path), root + "/table", fx.as_of(), fx.cutoff(),
        root + "/checkpoint2",
    )
    query.awaitTermination()
    assert stored() == want

    schema = spark.read.json(root + "/progress").drop("updated_at").schema
    progress = spark.read.schema(schema).json(root + "/progress")
    assert progress.agg(F.sum("n_added")).first()[0] == len(want)
    assert progress.agg(F.sum("n_rows")).first()[0] == raw.count()
    # Twenty venues, and the rows without one.
    assert latest_progress(spark, root + "/progress", schema).count() == 21


def test_replayed_batch_is_idempotent_and_keeps_its_count(spark, source):
    _, raw = source
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for _ in range(2):
        ingest.ingest_batch(
            raw, root + "/table", fx.as_of(), fx.cutoff(), "run-0", 0, progress_path=root + "/progress"
        )
    want = expected(spark, raw).count()
    assert spark.read.parquet(root + "/table").count() == want
    schema = spark.read.json(root + "/progress").drop("updated_at").schema
    progress = progress_rows(spark, root + "/progress", schema)
    assert progress.agg(F.sum("n_added")).first()[0] == want
    assert {r.run_tag for r in progress.collect()} == {"run-0"}


def test_null_and_empty_venues_are_stored_once(spark):
    rows = [(v, str(i), "a", "5 stars", "today", "text", False, "", i) for i, v in enumerate(["", None, " ", "v"])]
    schema = "venue string, id string, author string, rating string, date string, text string, is_local_guide boolean, reviewer_total_reviews string, ingest_seq int"
    raw = spark.createDataFrame(rows, schema)
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for _ in range(2):
        ingest.ingest_batch(raw, root + "/table", fx.as_of(), fx.cutoff(), "run-0", 0)
    stored = spark.read.parquet(root + "/table").groupBy("venue").count().collect()
    assert {r.venue: r["count"] for r in stored} == {ingest.NO_VENUE: 3, "v": 1}
    with pytest.raises(ValueError):
        ingest.ingest_batch(raw, root, fx.as_of(), fx.cutoff(), "run-0", 0, prefer="longest")


def test_per_venue_target(spark, source):
    path, raw = source
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    run(spark, path, raw.schema, root, per_venue=3)
    counts = spark.read.parquet(root + "/table").groupBy("venue").count().collect()
    assert {r["count"] for r in counts} == {3}


def test_arrival_order_from_files(spark, source):
    path, raw = source
    df = ingest.with_arrival(spark.read.parquet(path))
    got = [r.ingest_seq for r in df.orderBy("arrival").select("ingest_seq").collect()]
    assert sorted(got) == got


def test_checkpoint_location():
    class Session:
        def __init__(self, **settings):
            self.conf = settings

    named = Session(**{"spark.checkpoint.dir": "/shared"})
    assert ingest.checkpoint_location(named, "x", "/tmp/c") == "/shared/x"
    assert ingest.checkpoint_location(Session(), "x", "/tmp/c/") == "/tmp/c/x"
    with pytest.raises(ValueError):
        ingest.checkpoint_location(Session(), "x")


# Stop rules, timings, horizon, compaction


RAW = "venue string, id string, author string, rating string, date string, text string, is_local_guide boolean, reviewer_total_reviews string, ingest_seq int"


def passes_of(spark, path, passes):
    """One file per pass; a pass is a list of (venue, id, date) or of ids of venue v."""
    seq = 0
    for rows in passes:
        data = []
        for row in rows:
            venue, key, date = row if isinstance(row, tuple) else ("v", row, "today")
            data.append((venue, key, "a", "5 stars", date, f"text {seq}", False, "", seq))
            seq += 1
        spark.createDataFrame(data, RAW).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)


def collect(spark, path, root, rules, **settings):
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    return ingest.run_ingestion(
        stream, root + "/table", fx.as_of(), fx.cutoff(), root + "/progress", rules, root + "/checkpoint", **settings
    )


def ids(spark, root):
    return sorted(r.review_id for r in spark.read.parquet(root + "/table").collect())


def folders():
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return root, root + "/raw"


def test_a_run_stops_at_its_target_and_a_higher_one_goes_on(spark):
    root, path = folders()
    passes_of(spark, path, [["a", "b"], ["c", "d"], ["e"], ["f"]])
    rules = ingest.StopRules(target=3)
    assert collect(spark, path, root, rules) == "target"
    assert ids(spark, root) == ["a", "b", "c"]
    # The same target: rows stored before the run count, so it ends after one pass.
    assert collect(spark, path, root, rules) == "target"
    assert ids(spark, root) == ["a", "b", "c"]
    # The pass that was not processed is the next one.
    assert collect(spark, path, root, ingest.StopRules(target=100)) is None
    assert ids(spark, root) == ["a", "b", "c", "f"]


def test_a_run_stops_when_it_stagnates_and_a_resume_goes_on(spark):
    root, path = folders()
    passes_of(spark, path, [["a"], ["a"], ["a"], ["b"], ["b"], ["c"]])
    rules = ingest.StopRules(no_growth_limit=2)
    assert collect(spark, path, root, rules) == "stagnant"
    assert ids(spark, root) == ["a"]
    assert collect(spark, path, root, rules) is None
    assert ids(spark, root) == ["a", "b", "c"]


def test_a_run_goes_on_while_any_venue_may(spark):
    root, path = folders()
    passes_of(spark, path, [
        [("v", "a", "today"), ("w", "b", "today")], [("v", "a", "today"), ("w", "c", "today")],
        [("v", "a", "today"), ("w", "c", "today")], [("v", "d", "today"), ("w", "e", "today")],
    ])
    assert collect(spark, path, root, ingest.StopRules(no_growth_limit=1)) == "stagnant"
    # v stagnated in the second pass, w in the third.
    assert ids(spark, root) == ["a", "b", "c"]


def test_a_run_stops_beyond_the_cutoff_and_by_time(spark):
    root, path = folders()
    passes_of(spark, path, [["a"], [("v", "b", "1/1/1990")], [("v", "c", "1/2/1990")], ["d"]])
    assert collect(spark, path, root, ingest.StopRules(past_cutoff_limit=2)) == "cutoff"
    assert ids(spark, root) == ["a"]
    # No time at all: the first pass of a run is always processed.
    assert collect(spark, path, root, ingest.StopRules(max_seconds=0)) is None
    assert ids(spark, root) == ["a", "d"]


def test_every_progress_row_has_its_pass_and_its_timing(spark):
    root, path = folders()
    passes_of(spark, path, [["a", "b"], [("v", "c", "today"), ("w", "d", "today"), ("w", "d", "today")], ["e"]])
    assert collect(spark, path, root, None) is None
    schema = spark.createDataFrame([], ingest.PROGRESS_SCHEMA).schema
    timings = spark.read.schema(ingest.TIMING_SCHEMA).json(root + "/progress-timings")
    rows = with_timings(progress_rows(spark, root + "/progress", schema), timings).collect()
    assert sorted((r.venue, r.batch, r.n_rows, r.input_rows) for r in rows) == [
        ("v", 0, 2, 2), ("v", 1, 1, 3), ("v", 2, 1, 1), ("w", 1, 2, 3),
    ]
    assert all(r.duration_ms > 0 for r in rows)
    assert timings.count() == timings.select("run_tag").distinct().count() == 3


def test_a_horizon_stores_the_same_rows(spark, source):
    path, raw = source
    root, other = folders()[0], folders()[0]
    again = root + "/raw"
    # Everything arrives twice.
    for _ in range(2):
        spark.read.parquet(path).repartition(3, "ingest_seq").write.mode("append").parquet(again)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(again)
    for folder, horizon in ((root, "1 day"), (other, None)):
        ingest.run_ingestion(
            stream, folder + "/table", fx.as_of(), fx.cutoff(), folder + "/progress", None, folder + "/checkpoint", horizon=horizon
        )

    def stored(folder):
        rows = spark.read.parquet(folder + "/table").drop("ingest_batch")
        return sorted(map(str, rows.select(sorted(rows.columns)).collect()))

    assert stored(root) == stored(other) and len(stored(root)) == expected(spark, raw).count()
    schema = spark.createDataFrame([], ingest.PROGRESS_SCHEMA).schema
    seen = [progress_rows(spark, f + "/progress", schema).agg(F.sum("n_rows")).first()[0] for f in (root, other)]
    assert seen[0] < 0.7 * seen[1] and seen[1] == 2 * raw.count()


def test_a_forgotten_key_is_still_found_in_the_table(spark):
    root, path = folders()
    passes_of(spark, path, [["a", "b", "a"], [("v", "old", "1/1/1990")]])
    assert collect(spark, path, root, None, horizon="1 millisecond") is None
    passes_of(spark, path, [["a"], [("v", "old", "today")], ["c"]])
    assert collect(spark, path, root, None, horizon="1 millisecond") is None
    assert ids(spark, root) == ["a", "b", "c", "old"]
    first = spark.read.parquet(root + "/table").filter("review_id = 'a'").first()
    assert first.review_text == "text 0"


def test_compaction_keeps_all_rows_in_few_files(spark):
    root, path = folders()
    passes_of(spark, path, [[("v", f"a{i}", "today"), ("7", f"b{i}", "today")] for i in range(4)] + [[("few", "c", "today")]])
    assert collect(spark, path, root, None) is None
    before = sorted(map(str, spark.read.parquet(root + "/table").collect()))
    for names in (["7", "v"], []):
        assert sorted(compact_reviews(spark, root + "/table", 3, root + "/shared")) == names
    table = spark.read.parquet(root + "/table")
    assert sorted(map(str, table.collect())) == before
    files = table.groupBy("venue").agg(F.count_distinct("_metadata.file_path").alias("n")).collect()
    assert {r.n for r in files} == {1}
    # Ingestion goes on from the compacted table.
    passes_of(spark, path, [[("v", "a0", "today"), ("v", "new", "today")]])
    assert collect(spark, path, root, None) is None
    assert spark.read.parquet(root + "/table").count() == len(before) + 1
