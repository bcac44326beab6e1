"""Keyphrases by degree/frequency scoring (RAKE, Rose et al. 2010)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitorlens.functions.text import ENGLISH_STOP_WORDS, count_terms, split_phrases
from visitorlens.operators.scale import hot_key_join, salted_join

# Shortest and longest phrase, in words.
MIN_WORDS = 2
MAX_WORDS = 4
# Words whose scores may be sent to the phrases, some forty bytes each: those that more than one
# in so many words of all phrases are.
BROADCAST_WORDS = 200_000


def candidate_phrases(
    reviews: DataFrame,
    by: Sequence[str] = (),
    text: str = "review_text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    min_words: int = MIN_WORDS,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """``(*by, phrase, n)``: distinct phrases with their number of occurrences.

    Each review is reduced to its distinct phrases before the explode.
    """
    phrases = count_terms(split_phrases(F.col(text), stop_words, min_words, max_words))
    return (
        reviews.select(*by, F.inline(phrases))
        .groupBy(*by, F.col("term").alias("phrase"))
        .agg(F.sum("tf").alias("n"))
    )


def _phrase_words(phrases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct words of every phrase with their repetitions inside it (``times``)."""
    words = F.split("phrase", " ")
    return phrases.select(
        *by, "phrase", "n", F.size(words).alias("len"), F.inline(count_terms(words))
    ).select(
        *by, "phrase", "n", "len", F.col("term").alias("word"), F.col("tf").alias("times")
    )


def word_scores(phrases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, word, freq, degree, score, n_phrases)`` from a phrase table.

    ``freq`` counts occurrences of the word; ``degree`` adds, per occurrence, the
    number of words of the phrase. Both weigh distinct phrases by their count, so
    repeated phrases are never expanded.
    """
    return (
        _phrase_words(phrases, by)
        .groupBy(*by, "word")
        .agg(
            F.sum(F.col("n") * F.col("times")).alias("freq"),
            F.sum(F.col("n") * F.col("times") * F.col("len")).alias("degree"),
            F.count(F.lit(1)).alias("n_phrases"),
        )
        .withColumn("score", F.col("degree") / F.col("freq"))
    )


def score_phrases(phrases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, phrase, n, rake)``: phrase score = sum of its words' degree/frequency.

    Rounded to nine places, so that equal scores tie however their parts were added.
    """
    words = _phrase_words(phrases, by)
    stats = word_scores(phrases, by).select(*by, "word", "score", "n_phrases")
    if by:
        key = F.struct(*by, "word")
        words = words.withColumn("_key", key)
        stats = stats.select(key.alias("_key"), "score", "n_phrases")
    else:
        words = words.withColumnRenamed("word", "_key")
        stats = stats.withColumnRenamed("word", "_key")
    sent = [BROADCAST_WORDS] if BROADCAST_WORDS else []
    scored = hot_key_join(words, stats, "_key", "n_phrases", *sent)
    return scored.groupBy(*by, "phrase", "n").agg(
        F.round(F.sum(F.col("score") * F.col("times")), 9).alias("rake")
    )


def rake_phrases(
    reviews: DataFrame,
    by: Sequence[str] = (),
    text: str = "review_text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    min_words: int = MIN_WORDS,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """``(*by, phrase, n, rake)`` ranked by score, then by phrase, both descending.

    Repeats are kept as the count ``n``; see ``repeat_phrases`` for one row each.
    """
    phrases = candidate_phrases(reviews, by, text, stop_words, min_words, max_words)
    return score_phrases(phrases, by).orderBy(*by, F.desc("rake"), F.desc("phrase"))


REPEAT_CHUNK = 10_000


def repeat_phrases(scored: DataFrame) -> DataFrame:
    """One row per occurrence. Expanded in chunks, so no row holds a huge array."""
    rest = F.least(F.lit(REPEAT_CHUNK), F.col("n") - F.col("_chunk") * REPEAT_CHUNK)
    chunks = scored.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEAT_CHUNK)))
    )
    return chunks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), rest))).drop(
        "_chunk", "_copy", "n"
    )


def phrase_frequency(
    phrases: DataFrame, by: Sequence[str] = (), counts: DataFrame | None = None
) -> DataFrame:
    """Adds ``freq`` = n / largest n. An empty table stays empty.

    ``counts`` has the same phrases and numbers if ``phrases`` took long to compute from it.
    """
    if not by:
        top = (phrases if counts is None else counts).agg(F.max("n")).scalar()
        return phrases.withColumn("freq", F.col("n") / top)
    top = (phrases if counts is None else counts).groupBy(*by).agg(F.max("n").alias("_top"))
    return (
        salted_join(phrases, top, by).withColumn("freq", F.col("n") / F.col("_top")).drop("_top")
    )
