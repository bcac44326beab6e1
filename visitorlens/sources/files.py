"""Reading and writing review tables, progress documents and reports."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitorlens.functions.text import WHITESPACE
from visitorlens.operators.reviews import identity_columns
from visitorlens.schema import REVIEW_COLUMNS, REVIEW_SCHEMA, check_columns


def csv_columns(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Header of a review CSV (byte-order mark ignored)."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns


def read_reviews_csv(spark: SparkSession, path: str) -> DataFrame:
    """Review CSV with quoted newlines and an optional byte-order mark.

    Columns are matched by name, so their order in a file does not matter; extra
    columns are read as text and pass through. The files of a folder may have headers of
    their own: files with the same header are read together, and the groups are united
    by name. Quoted newlines make a CSV file unsplittable: convert it once with
    ``append_reviews`` and analyse that.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for files in _files_by_header(spark, path) or [[path]]:
        groups.setdefault(tuple(csv_columns(spark, files[:1])), []).extend(files)
    parts = [_read_csv(spark, sorted(files), list(header)) for header, files in groups.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """Paths of the files below ``path`` that hold anything, grouped by their first line.

    One job over the beginnings of all files, wherever Spark can read them; of a file only
    its first line leaves the task. Headers with line breaks in their names fall into more
    groups than need be, which does no harm.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    firsts = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "line").alias("header"))
    grouped = firsts.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [row.paths for row in grouped.orderBy("header").collect()]


def _read_csv(spark: SparkSession, path: list[str], header: list[str]) -> DataFrame:
    flag_types = {f.name: f.dataType for f in REVIEW_SCHEMA}
    schema = T.StructType([T.StructField(c, flag_types.get(c, T.StringType())) for c in header])
    df = (
        spark.read.schema(schema)
        .csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True)
    )
    check_columns(df)
    return df.select(*REVIEW_COLUMNS, *[c for c in header if c not in REVIEW_COLUMNS])


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review table in Parquet, after checking its columns.

    Converted and ingested files differ in their additional columns; all are kept.
    """
    return check_columns(spark.read.option("mergeSchema", "true").parquet(path))


def append_reviews(df: DataFrame, path: str, partition_by: str = "venue") -> None:
    """Append to a Parquet review table, partitioned by venue, after checking the columns.

    The rebalance hint lets Spark bring the rows of a venue together, so that few
    files are written, and split a venue that is too large for one task.
    """
    check_columns(df)
    if partition_by in df.columns:
        balanced = df.hint("rebalance", partition_by)
        balanced.write.mode("append").partitionBy(partition_by).parquet(path)
    else:
        df.write.mode("append").parquet(path)


def land_csv(spark: SparkSession, csv_path: str, path: str, venue: str) -> None:
    """Convert a venue's review CSV into the Parquet table, with the keys ingestion needs.

    Rows whose key the venue already has in the table are left out, so landing a file
    twice adds nothing the second time. Repeated rows within one file are kept.
    """
    rows = read_reviews_csv(spark, csv_path)
    texts = [c for c in REVIEW_COLUMNS if c not in ("is_local_guide", "reviewer_total_reviews")]
    rows = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts})
    rows = rows.withColumn(
        "reviewer_total_reviews", F.col("reviewer_total_reviews").try_cast("int")
    )
    keyed = rows.select("*", *identity_columns(), F.lit(venue).alias("venue"))
    if table_exists(spark, path):
        stored = spark.read.schema("review_key string, venue string").parquet(path)
        stored = stored.filter(F.col("venue") == venue).select("review_key").distinct()
        keyed = keyed.join(stored, "review_key", "left_anti").select(*keyed.columns)
    append_reviews(keyed, path)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("review_key string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def write_progress(progress: DataFrame, path: str) -> None:
    """Append progress rows as JSON lines with the time of writing; see ``latest_progress``."""
    progress.withColumn("updated_at", F.current_timestamp()).write.mode("append").json(path)


def latest_progress(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Newest progress row of every venue."""
    return _newest(progress_rows(spark, path, schema), ["venue"])


def progress_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per venue, run and batch: the newest, if a batch was replayed.

    These rows can be summed over replays, restarts and new checkpoints.
    """
    stamp = T.StructField("updated_at", T.TimestampType())
    named = schema if "updated_at" in schema.names else T.StructType([*schema.fields, stamp])
    keys = [c for c in ("venue", "run_tag", "batch") if c in named.names]
    return _newest(spark.read.schema(named).json(path), keys)


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    latest = [c for c in ("updated_at", "batch") if c in others]
    newest = F.max_by(F.struct(*others), F.struct(*latest))
    return rows.groupBy(*keys).agg(newest.alias("_p")).select(*keys, "_p.*")


def with_timings(progress: DataFrame, timings: DataFrame) -> DataFrame:
    """Adds ``input_rows`` and ``duration_ms`` of its pass to every progress row.

    ``timings`` has ``run_tag, input_rows, duration_ms, updated_at``; of repeated rows the
    newest counts. There is one row per pass, so they are few.
    """
    measured = F.struct("updated_at", "input_rows", "duration_ms")
    newest = timings.groupBy("run_tag").agg(F.max(measured).alias("_timing"))
    joined = progress.join(newest, "run_tag", "left")
    return joined.select(*progress.columns, "_timing.input_rows", "_timing.duration_ms")


def compact_reviews(
    spark: SparkSession, path: str, max_files: int = 8, copy_to: str | None = None
) -> list[str]:
    """Rewrite the venues of a review table that lie in more than ``max_files`` files.

    Returns their names. Ingestion adds a file per venue and batch, so run this between
    runs of it, never during one. The rows are first copied to ``copy_to``, by default the
    folder of ``spark.checkpoint.dir``; then each venue's folder is replaced and counted.
    The copy stays there until it is deleted by hand. Only file names are read to choose
    the venues.
    """
    root = copy_to or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir: rows are copied there before they are replaced")
    stored = spark.read.option("mergeSchema", "true").parquet(path)
    # Numbers as venue names stay text.
    named = T.StructType(
        [T.StructField(f.name, T.StringType()) if f.name == "venue" else f for f in stored.schema.fields]
    )
    files = spark.read.schema("venue string").parquet(path)
    per_venue = files.groupBy("venue").agg(
        F.count_distinct("_metadata.file_path").alias("files"), F.count(F.lit(1)).alias("n")
    )
    crowded = per_venue.filter(F.col("files") > max_files)
    names = [row.venue for row in crowded.select("venue").toLocalIterator()]
    if not names:
        return []
    copy = f"{root.rstrip('/')}/compact-{uuid.uuid4().hex}"
    rows = spark.read.schema(named).parquet(path)
    rows.join(crowded.select("venue"), "venue", "left_semi").write.partitionBy("venue").parquet(copy)
    copied = spark.read.schema(named).parquet(copy)
    balanced = copied.hint("rebalance", "venue").write.mode("overwrite").partitionBy("venue")
    balanced.option("partitionOverwriteMode", "dynamic").parquet(path)
    before = copied.groupBy("venue").agg(F.count(F.lit(1)).alias("n"))
    after = spark.read.schema("venue string").parquet(path).groupBy("venue").agg(F.count(F.lit(1)).alias("n"))
    if not before.exceptAll(after).isEmpty():
        raise RuntimeError(f"rows are missing after compaction; they are kept in {copy}")
    return names


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header. ``single_file`` is for reports of a few rows, such as the pivot."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("quote", '"').option("escape", '"').csv(path, header=True)


def venue_directory_slug(name: Column) -> Column:
    """Letters, digits, space, ``_`` and ``-`` only; trimmed; spaces become ``_``."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "")
    return F.translate(F.btrim(kept, F.lit(WHITESPACE)), " ", "_")


def venue_file_slug(name: Column) -> Column:
    """Lower case; spaces become ``_``; then letters, digits, ``_`` and ``-`` only."""
    return F.regexp_replace(F.translate(F.lower(name), " ", "_"), r"[^\p{L}\p{N}_-]", "")
