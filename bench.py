"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The test tables are one file with one row group each, which only one core can read. They
are laid out anew before timing, in as many files as cores, like any table of some size;
the queries themselves never redistribute their input. ``queries`` has the first run of
each, as in earlier rounds; ``warm`` the second, without the time to compile its plan.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "keyword_by_rating",
    "keyword_by_venue",
    "keyword_table_mentions",
    "normalize_reviews",
    "dedup_first_seen",
    "incremental_new_rows",
    "text_quality_counts",
    "sentiment_counts",
    "sentiment_by_venue",
    "top_bigrams",
    "tfidf_top_terms",
    "tfidf_by_venue",
    "phrase_frequency",
    "rake_phrases",
    "seed_similarity",
    "topic_top_items",
    "page_cards",
    "review_cards",
    "batch_progress",
    "stop_reason",
]


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages"
TABLES += " benchmark labels conversations"


def lay_out(spark, folder: str) -> str:
    """A copy of the tables with one file per core."""
    out = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES.split():
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        table.repartition(int(CPUS)).write.parquet(f"{out}/{name}.parquet")
    return out


def main() -> None:
    from visitorlens.plans.queries import QUERIES
    from visitorlens.plans.session import build_session

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's compiler and the Python workers before timing.
    spark.range(1000).selectExpr("sum(id)").collect()
    folder = lay_out(spark, SF_DIR)
    times, warm = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        for run in (times, warm):
            start = time.perf_counter()
            # The whole result is computed, without bringing it to the driver.
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            run[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]} {warm[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "warm_value": round(sum(warm.values()), 3),
        "warm": warm,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
