"""The driver tables reshaped into reviews, and the parameters of the registered queries.

The reshaping is one SELECT that Spark and other SQL engines run unchanged; every
row of ``documents`` becomes one review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitorlens.functions.html import contributor_is_guide, contributor_total
from visitorlens.operators.reviews import normalize_reviews
from visitorlens.operators.sentiment import SentimentWords

FIELDS_SQL = """
SELECT
  doc_id AS ingest_seq,
  CASE doc_id % 41 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE source END AS venue,
  lang,
  CASE WHEN doc_id % 7 = 0 THEN ''
       WHEN doc_id % 10 = 9 THEN concat('r', CAST(doc_id - 1 AS STRING))
       ELSE concat('r', CAST(doc_id AS STRING)) END AS review_id,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('user', CAST(doc_id % 37 AS STRING)) END
    AS reviewer_name,
  CASE doc_id % 4 WHEN 0 THEN concat('Local Guide · ', CAST(doc_id % 50 + 1 AS STRING), ' reviews')
                  WHEN 1 THEN concat('1,', CAST(100 + doc_id % 900 AS STRING), ' reviews · 3 photos')
                  WHEN 2 THEN '12 photos' ELSE '' END AS contributor_blob,
  CASE WHEN doc_id % 13 = 0 THEN '4.0 stars'
       WHEN doc_id % 5 = 0 THEN '1 star'
       WHEN doc_id % 5 = 3 THEN ' 4 Stars '
       ELSE concat(CAST(doc_id % 5 + 1 AS STRING), ' stars') END AS rating,
  CASE doc_id % 12 WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' WHEN 2 THEN 'a year ago'
       WHEN 3 THEN concat(CAST(doc_id % 40 + 1 AS STRING), ' months ago')
       WHEN 4 THEN concat(CAST(doc_id % 9 + 1 AS STRING), ' weeks ago')
       WHEN 5 THEN '5 days ago' WHEN 6 THEN concat('Jan ', CAST(doc_id % 31 + 1 AS STRING), ', 2024')
       WHEN 7 THEN concat(CAST(doc_id % 31 + 1 AS STRING), ' February 2023') WHEN 8 THEN 'Sept 2021'
       WHEN 9 THEN concat('1/', CAST(doc_id % 31 + 1 AS STRING), '/2022')
       WHEN 10 THEN '2 hours ago' ELSE '' END AS raw_date,"""
# Null, blank, cut and mis-decoded texts.
DAMAGED_TEXT = """
  CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '   '
       WHEN doc_id % 23 = 0 THEN concat(substring(text, 1, 60), '…')
       WHEN doc_id % 29 = 0 THEN concat('Â', text, 'â€¦') ELSE text END AS review_text
"""
REVIEWS_SQL = FIELDS_SQL + DAMAGED_TEXT + "FROM {documents}"
# For the queries that read texts; the damage is for those that repair or count it.
TEXTS_SQL = FIELDS_SQL + " text AS review_text FROM {documents}"

AS_OF = "2024-06-15"
CUTOFF = "2022-01-01"
# Keywords: words that occur in the test prose, words that are common, and one that never does.
KEYWORDS = [
    "trash",
    "scum",
    "idiot",
    "clown",
    "worthless",
    "license",
    "under",
    "thing",
    "of the",
    "avec",
    "la",
    "seat",
]
# Test-only valences and modifiers.
LEXICON = {
    "trash": -1.5,
    "scum": -2.3,
    "idiot": -2.3,
    "clown": -1.5,
    "worthless": -1.9,
    "moron": -2.2,
    "pathetic": -2.5,
    "loser": -2.4,
    "stupid": -2.4,
    "disgusting": -3.0,
    "thing": 1.8,
    "thst": 2.1,
    "only": 0.9,
    "en": 1.2,
    "sch": -0.8,
}
BOOSTERS = {"very": 0.293, "thble": 0.293, "ndre": -0.293, "aux": 0.293}
NEGATIONS = ["not", "thly", "nicht", "pas"]
TARGET_CAP = 30
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PROGRESS_TARGET = 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as reviews with raw (unnormalised) fields, some texts damaged on purpose."""
    return spark.sql(REVIEWS_SQL, documents=table(spark, sf_dir, "documents"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reviews with the whole text of every document."""
    return spark.sql(TEXTS_SQL, documents=table(spark, sf_dir, "documents"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reviews in the shape page extraction delivers."""
    blob = F.col("contributor_blob")
    return reviews(spark, sf_dir).select(
        "ingest_seq",
        "venue",
        "lang",
        F.col("review_id").alias("id"),
        F.col("reviewer_name").alias("author"),
        "rating",
        F.col("raw_date").alias("date"),
        F.col("review_text").alias("text"),
        contributor_is_guide(blob).alias("is_local_guide"),
        contributor_total(blob).alias("reviewer_total_reviews"),
    )


def as_of():
    return F.lit(AS_OF).cast("date")


def cutoff():
    return F.lit(CUTOFF).cast("date")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_reviews(raw_records(spark, sf_dir), as_of())


def sentiment_words() -> SentimentWords:
    return SentimentWords(LEXICON, BOOSTERS, NEGATIONS)
