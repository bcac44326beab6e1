import tempfile

import pytest
from pyspark.sql import functions as F

from visitorlens.schema import REVIEW_COLUMNS, MissingColumnsError
from visitorlens.sources import files

HEADER = ",".join(REVIEW_COLUMNS)


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def write(text):
    path = folder() + "/reviews.csv"
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        f.write(text)
    return path


def test_csv_with_mark_quotes_and_newlines(spark):
    path = write(
        HEADER + "\r\n"
        'r1,Ann,12,True,5 stars,2024-01-05,"He said ""wow"",\nthen left"\r\n'
        ",Bo,,False,1 star,2 hours ago,\r\n"
    )
    one, two = files.read_reviews_csv(spark, path).orderBy(F.desc("review_id")).collect()
    assert one.review_text == 'He said "wow",\nthen left'
    assert (one.review_id, one.is_local_guide, one.reviewer_total_reviews) == ("r1", True, "12")
    assert (two.review_id, two.is_local_guide, two.review_text) == (None, False, None)


def test_csv_columns_are_matched_by_name(spark):
    reordered = [*reversed(REVIEW_COLUMNS), "extra"]
    path = write(",".join(reordered) + "\nbody,2024-01-01,5 stars,True,3,Ann,r9,x\n")
    df = files.read_reviews_csv(spark, path)
    assert df.columns == [*REVIEW_COLUMNS, "extra"]
    row = df.first()
    assert (row.review_id, row.review_text, row.is_local_guide, row.extra) == ("r9", "body", True, "x")
    with pytest.raises(MissingColumnsError, match="review_text"):
        files.read_reviews_csv(spark, write(HEADER.replace(",review_text", "") + "\n"))


def test_append_and_land(spark):
    target = folder() + "/table"
    path = write(HEADER + "\nr1,Ann,12,True,5 stars,2024-01-05,fine\n,Bo,x,False,1 star,,\n")
    files.land_csv(spark, path, target, "hall")
    files.land_csv(spark, path, target, "007")
    df = files.read_reviews(spark, target)
    files.land_csv(spark, path, target, "hall")
    assert df.count() == files.read_reviews(spark, target).count() == 4
    keys = {r.review_key[:3] for r in df.collect()}
    assert keys == {"id:", "fb:"}
    assert df.filter("venue = 'hall' and review_dt = date'2024-01-05'").count() == 1
    with pytest.raises(MissingColumnsError):
        files.append_reviews(df.drop("rating"), target)


def test_csv_files_with_headers_of_their_own(spark):
    path = folder()
    for name, columns in (("a", REVIEW_COLUMNS), ("b", [*reversed(REVIEW_COLUMNS), "extra"])):
        values = {c: f"{c}-{name}" for c in [*REVIEW_COLUMNS, "extra"]} | {"is_local_guide": "True"}
        with open(f"{path}/{name}.csv", "w") as f:
            f.write(",".join(columns) + "\n" + ",".join(values[c] for c in columns) + "\n")
    got = files.read_reviews_csv(spark, path).orderBy("review_id").collect()
    assert [(r.review_id, r.review_text, r.extra) for r in got] == [
        ("review_id-a", "review_text-a", None), ("review_id-b", "review_text-b", "extra-b"),
    ]


def test_headers_of_very_many_files_take_few_jobs(spark):
    path = folder()
    for i in range(300):
        columns = REVIEW_COLUMNS if i % 2 else [*reversed(REVIEW_COLUMNS)]
        values = {c: f"{c}-{i}" for c in REVIEW_COLUMNS} | {"is_local_guide": "True"}
        with open(f"{path}/f{i:04d}.csv", "w") as f:
            f.write(",".join(columns) + "\n" + ",".join(values[c] for c in columns) + "\n" if i else "")
    spark.sparkContext.setJobGroup("headers", "reading headers")
    df = files.read_reviews_csv(spark, path)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Listing, first lines, and one header for each of the two kinds of files.
    assert jobs <= 12
    got = df.select("review_id", "review_text").collect()
    assert sorted(map(tuple, got)) == sorted((f"review_id-{i}", f"review_text-{i}") for i in range(1, 300))


def test_progress_documents(spark):
    path = folder() + "/progress"
    schema = spark.createDataFrame([], "venue string, run_tag string, batch long, n_added long").schema
    # The first batch is replayed, and a new run begins with batch 0 again.
    for tag, batch, n in (("r-0", 0, 5), ("r-0", 0, 5), ("r-1", 1, 2), ("s-0", 0, 3)):
        files.write_progress(spark.createDataFrame([("v", tag, batch, n)], schema), path)
    rows = files.progress_rows(spark, path, schema)
    assert rows.count() == 3 and rows.agg(F.sum("n_added")).first()[0] == 10
    row = files.latest_progress(spark, path, schema).first()
    assert (row.venue, row.run_tag, row.batch, row.n_added) == ("v", "s-0", 0, 3)
    assert row.updated_at is not None


def test_export(spark):
    path = folder() + "/report"
    df = spark.createDataFrame([("seat", 'a "b", c', 3)], "keyword string, note string, n long")
    files.export_csv(df, path, single_file=True)
    back = spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=True).first()
    assert (back.keyword, back.note, back.n) == ("seat", 'a "b", c', 3)


def test_slugs(spark):
    # name, folder, file
    cases = [
        ("The Majestic Théâtre, Dallas, TX", "The_Majestic_Théâtre_Dallas_TX", "the_majestic_théâtre_dallas_tx"),
        (" A_b-c! ", "A_b-c", "_a_b-c_"),
        ("Hall 9/10 (north)", "Hall_910_north", "hall_910_north"),
        ("...", "", ""),
        ("", "", ""),
    ]
    df = spark.createDataFrame([c[:1] for c in cases], "n string")
    got = df.select("n", files.venue_directory_slug(F.col("n")), files.venue_file_slug(F.col("n"))).collect()
    assert [tuple(r) for r in got] == cases
