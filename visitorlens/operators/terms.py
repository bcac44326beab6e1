"""Dominant terms: n-gram counts and TF-IDF ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from visitorlens.functions.text import (
    ENGLISH_STOP_WORDS,
    MIN_CHARS,
    content_tokens,
    count_terms,
    ngrams,
    ngrams_of,
    tokenize,
)
from visitorlens.operators.scale import BROADCAST_ROWS, null_safe_join, top_per_group

# Size of the vocabulary, of the report, and the n-gram range.
MAX_FEATURES = 50
TOP_TERMS = 20
NGRAM_RANGE = (1, 2)
# So many frequent words are looked up inside the rows, more of them in a join.
LISTED_WORDS = 1_000


def document_terms(
    text: Column,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    sizes: tuple[int, int] = NGRAM_RANGE,
) -> Column:
    """n-grams of the content words of a text, with repetition."""
    return ngrams(content_tokens(text, stop_words), sizes)


def token_counts(reviews: DataFrame, text: str = "review_text") -> DataFrame:
    """``(term, n)``: occurrences of every token of the cleaned text."""
    counted = reviews.select(F.inline(count_terms(tokenize(F.col(text)))))
    return counted.groupBy("term").agg(F.sum("tf").alias("n"))


def term_doc_frequency(
    reviews: DataFrame,
    by: Sequence[str] = (),
    text: str = "review_text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    sizes: tuple[int, int] = NGRAM_RANGE,
) -> DataFrame:
    """``(*by, term, n, n_docs)``: occurrences in the corpus and documents containing the term.

    A document contributes its distinct terms with their counts, computed inside
    its row, so one shuffle on the term yields both numbers.
    """
    terms = count_terms(document_terms(F.col(text), stop_words, sizes))
    return (
        reviews.select(*by, F.inline(terms))
        .groupBy(*by, "term")
        .agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("n_docs"))
    )


def top_terms_by_count(
    counted: DataFrame, k: int = MAX_FEATURES, by: Sequence[str] = ()
) -> DataFrame:
    """The ``k`` most frequent terms (of every group); ties go alphabetically."""
    order = [F.desc("n"), F.asc("term")]
    if by:
        return top_per_group(counted, by, order, k)
    return counted.orderBy(*order).limit(k)


def tfidf_top_terms(
    reviews: DataFrame,
    by: Sequence[str] = (),
    k: int = TOP_TERMS,
    max_features: int = MAX_FEATURES,
    text: str = "review_text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    sizes: tuple[int, int] = NGRAM_RANGE,
) -> DataFrame:
    """``(*by, term, score)``: top terms by tf-idf weight summed over all documents.

    The vocabulary is the ``max_features`` most frequent terms; every row counts as a
    document, also empty ones. An n-gram is no more frequent than any of its words, so only
    n-grams of words that are as frequent as the last of the ``max_features`` first words
    can be among them. Two passes over the text: the first counts single words, the second
    those n-grams of every document, of which only the counts are shuffled. The vocabulary is
    found among these counts and joined with them. If those words are too many to be sent (groups
    in their thousands, or most words equally rare), all n-grams are counted, and the documents
    read once more for those of the vocabulary.
    """
    terms = document_terms(F.col(text), stop_words, sizes)
    documents = reviews.select(*by, F.monotonically_increasing_id().alias("_doc"), F.col(text).alias("_text"))
    words = None
    if sizes[0] == 1:
        # Stop words are dropped after the explode, in compiled code.
        single = reviews.select(*by, F.explode(tokenize(F.col(text), MIN_CHARS)).alias("term"))
        if stop_words:
            single = single.filter(~F.col("term").isin(sorted(set(stop_words))))
        words = _collected(_most_frequent_words(single, max_features, by))
    if words is None:
        counts = reviews.select(*by, F.explode(terms).alias("term")).groupBy(*by, "term")
        counts = counts.agg(F.count(F.lit(1)).alias("n"))
        frequent = top_terms_by_count(counts, max_features, by).select(*by, "term")
        vocabulary = _as_broadcast(frequent)
        inside = document_terms(F.col("_text"), stop_words, sizes)
        if vocabulary is None:
            # Too large to be sent: documents are reduced to their distinct terms before the shuffle.
            known, found = frequent, documents.select(*by, "_doc", F.inline(count_terms(inside)))
        else:
            known = vocabulary
            found = documents.select(*by, "_doc", F.explode(inside).alias("term"), F.lit(1).alias("tf"))
        # At most ``max_features`` rows per document from here on.
        counted = _of_groups(found, known, by).groupBy(*by, "_doc", "term").agg(F.sum("tf").alias("tf"))
        used = counted.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n_docs"))
        sent = vocabulary is not None
    else:
        listed = sorted({row.term for row in words})
        few = len(listed) <= LISTED_WORDS
        tokens = content_tokens(F.col("_text"), stop_words)
        inside = ngrams_of(tokens, listed, sizes) if few else ngrams(tokens, sizes)
        found = documents.select(*by, "_doc", F.explode(inside).alias("term"))
        if by or not few:
            found = _between_words(found, _sent(reviews, words, by), by)
        counted = found.groupBy(*by, "_doc", "term").agg(F.count(F.lit(1)).alias("tf"))
        counts = counted.groupBy(*by, "term")
        counts = counts.agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("n_docs"))
        used = top_terms_by_count(counts, max_features, by).select(*by, "term", "n_docs")
        # No group has a vocabulary without one of these words.
        sent = max_features * len({str(row[:-1]) for row in words}) <= BROADCAST_ROWS
    total = reviews.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all"))
    used = null_safe_join(used, total, by) if by else used.withColumn("n_all", total.scalar())
    idf = F.log((1 + F.col("n_all")) / (1 + F.col("n_docs"))) + 1
    used = used.select(*by, "term", idf.alias("idf"))
    weighed = _of_groups(counted, F.broadcast(used) if sent else used, by)
    weighed = weighed.select(*by, "_doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    normed = weighed.groupBy(*by, "_doc").agg(
        F.collect_list(F.struct("term", "w")).alias("_weights"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"),
    )
    weights = normed.select(*by, "_norm", F.inline("_weights"))
    scored = weights.groupBy(*by, "term").agg(F.sum(F.col("w") / F.col("_norm")).alias("score"))
    order = [F.desc("score"), F.asc("term")]
    if by:
        return top_per_group(scored, by, order, k)
    return scored.orderBy(*order).limit(k)


def _most_frequent_words(words: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """``(*by, term)``: words (of every group) with fewer than ``k`` more frequent ones, ties included."""
    counts = words.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))
    rank = F.rank().over(Window.partitionBy(*by).orderBy(F.desc("n")))
    return counts.withColumn("_rank", rank).filter(F.col("_rank") <= k).select(*by, "term")


def _between_words(found: DataFrame, words: DataFrame, by: Sequence[str]) -> DataFrame:
    """``found`` whose terms begin and end with one of its group's ``words``."""
    columns = found.columns
    for place in (1, -1):
        known = words.withColumnRenamed("term", "_word")
        found = found.withColumn("_end", F.substring_index("term", " ", place))
        known = known.withColumnsRenamed({c: f"_of_{c}" for c in by})
        same = F.col("_end") == F.col("_word")
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        found = found.join(F.broadcast(known), same, "left_semi").select(columns)
    return found


def _of_groups(rows: DataFrame, terms: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` whose group and term ``terms`` has, with its other columns. Groups may be
    null, terms are not: an ordinary key is faster."""
    known = terms.withColumnsRenamed({c: f"_of_{c}" for c in (*by, "term")})
    same = F.col("term") == F.col("_of_term")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(known, same).drop(*[f"_of_{c}" for c in (*by, "term")])


def _collected(df: DataFrame, max_rows: int | None = None) -> list[Row] | None:
    """The rows of ``df`` if it has no more than that; else None."""
    limit = BROADCAST_ROWS if max_rows is None else max_rows
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def _as_broadcast(df: DataFrame) -> DataFrame | None:
    """``df`` computed once, to be broadcast, if it is small; else None."""
    rows = _collected(df)
    return None if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def _sent(reviews: DataFrame, words: list[Row], by: Sequence[str]) -> DataFrame:
    """``words`` as a table ``(*by, term)``."""
    schema = reviews.select(*by, F.lit("").alias("term")).schema
    return F.broadcast(reviews.sparkSession.createDataFrame(words, schema))


def top_bigrams(
    reviews: DataFrame,
    k: int = TOP_TERMS,
    by: Sequence[str] = (),
    text: str = "review_text",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """``(*by, term, n, n_docs)`` of the most frequent word pairs across removed stop words."""
    return top_terms_by_count(
        term_doc_frequency(reviews, by, text, stop_words, (2, 2)), k, by
    )
