"""Every operator as a registered query over the driver tables.

Doubles are rounded to six places and dates are given as ISO text, so that results
can be compared with another engine value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitorlens.functions import dates, html, text
from visitorlens.operators import (
    keywords,
    pages,
    phrases,
    progress,
    reviews,
    sentiment,
    terms,
    topics,
)
from visitorlens.plans import fixtures as fx
from visitorlens.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Keywords


@query
def keyword_by_rating(spark, sf):
    return keywords.keyword_by_rating(fx.texts(spark, sf), fx.KEYWORDS)


@query
def keyword_mentions(spark, sf):
    return keywords.keyword_mentions(fx.texts(spark, sf), fx.KEYWORDS)


@query
def keyword_table_mentions(spark, sf):
    """Keywords are the titles of all pages, split into words: a table that grows with the data."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    words = fx.table(spark, sf, "pages").select(
        F.explode(F.filter(F.split(F.lower(title), "[ .,]+"), lambda w: w != "")).alias("keyword")
    )
    return keywords.keyword_table_mentions(fx.texts(spark, sf), words)


@query
def keyword_table_phrases(spark, sf):
    """Keywords of two words: how the titles of all pages begin."""
    start = F.regexp_extract("html", r"<title>([\p{L}\p{N}_]+ [\p{L}\p{N}_]+)", 1)
    pairs = fx.table(spark, sf, "pages").select(F.lower(start).alias("keyword"))
    return keywords.keyword_table_mentions(fx.texts(spark, sf), pairs)


@query
def keyword_by_venue(spark, sf):
    return keywords.keyword_by_rating(fx.texts(spark, sf), fx.KEYWORDS, by=["venue"])


@query
def keyword_by_month(spark, sf):
    """Reviews without a readable date are counted under a null month."""
    day = dates.iso_to_date(dates.normalize_review_date(F.col("raw_date"), fx.as_of()))
    rows = fx.texts(spark, sf).withColumn(
        "month", F.date_format(F.date_trunc("month", day), "yyyy-MM-dd")
    )
    return (
        keywords.keyword_mentions(rows, fx.KEYWORDS, by=["month"])
        .groupBy("month", "keyword")
        .agg(F.sum("n").alias("n"))
    )


# Scalars and the review table


@query
def fix_mojibake(spark, sf):
    return fx.reviews(spark, sf).select(
        "ingest_seq", text.fix_mojibake(F.col("review_text")).alias("fixed")
    )


@query
def clean_text(spark, sf):
    return fx.texts(spark, sf).select(
        "ingest_seq", text.clean_text(F.col("review_text")).alias("cleaned")
    )


@query
def normalize_dates(spark, sf):
    day = dates.normalize_review_date(F.col("raw_date"), fx.as_of())
    return fx.reviews(spark, sf).select(
        "ingest_seq",
        "raw_date",
        day.alias("review_date"),
        dates.iso_to_date(day).cast("string").alias("review_dt"),
    )


@query
def shift_dates(spark, sf):
    day = F.col("o_orderdate").cast("date")
    n = (F.col("o_orderkey") % 50 - 25).cast("int")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        dates.shift_months(day, n).cast("string").alias("by_months"),
        dates.shift_years(day, n).cast("string").alias("by_years"),
    )


@query
def venue_slug(spark, sf):
    name = F.concat(F.initcap("source"), F.lit(", "), F.initcap("lang"), F.lit(" – Théâtre & Co. "))
    return (
        fx.table(spark, sf, "documents")
        .select(name.alias("name"))
        .distinct()
        .select(
            "name",
            files.venue_directory_slug(F.col("name")).alias("directory"),
            files.venue_file_slug(F.col("name")).alias("file"),
        )
    )


@query
def contributor_meta(spark, sf):
    blob = F.col("contributor_blob")
    return fx.reviews(spark, sf).select(
        "ingest_seq",
        html.contributor_is_guide(blob).alias("is_local_guide"),
        html.contributor_total(blob).alias("total_reviews"),
    )


@query
def normalize_reviews(spark, sf):
    return (
        fx.normalized(spark, sf)
        .filter(reviews.has_content())
        .withColumn("reviewer_total_reviews", F.col("reviewer_total_reviews").cast("string"))
        .drop("review_dt", "review_key")
    )


@query
def review_keys(spark, sf):
    return fx.normalized(spark, sf).select("ingest_seq", "review_key")


@query
def seen_keys(spark, sf):
    return reviews.stored_keys(fx.normalized(spark, sf))


@query
def cutoff_filter(spark, sf):
    return reviews.cutoff_filter(fx.normalized(spark, sf), fx.cutoff()).select(
        "ingest_seq", "review_date"
    )


@query
def dedup_first_seen(spark, sf):
    return reviews.first_seen(fx.normalized(spark, sf)).select(
        "review_key", "ingest_seq", "venue", "rating"
    )


@query
def dedup_longest_text(spark, sf):
    return reviews.first_seen(fx.normalized(spark, sf), prefer="longest").select(
        "review_key", "ingest_seq", F.length("review_text").cast("string").alias("n_text")
    )


def _stored(spark, sf):
    """Reviews already collected: those whose document has been labelled."""
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("ingest_seq"))
    return fx.normalized(spark, sf).join(labelled, "ingest_seq", "left_semi")


@query
def incremental_new_rows(spark, sf):
    new = reviews.new_reviews(fx.normalized(spark, sf), _stored(spark, sf), fx.cutoff())
    return new.select("ingest_seq", "review_key", "review_date")


@query
def union_stored_new(spark, sf):
    stored = _stored(spark, sf)
    new = reviews.new_reviews(fx.normalized(spark, sf), stored, fx.cutoff())
    return reviews.union_reviews(stored, new).groupBy("venue").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("ingest_seq").alias("seq_sum")
    )


@query
def text_quality_counts(spark, sf):
    return reviews.text_quality(fx.normalized(spark, sf))


@query
def sample_gate(spark, sf):
    return reviews.sample_gate(fx.normalized(spark, sf))


@query
def target_cap(spark, sf):
    already = (
        _stored(spark, sf).groupBy("venue").agg(F.count(F.lit(1)).alias("n_stored"))
    )
    rows = fx.normalized(spark, sf)
    return reviews.cap_per_venue(rows, fx.TARGET_CAP, already).select("venue", "ingest_seq")


# Terms


@query
def tokenize_counts(spark, sf):
    return terms.token_counts(fx.texts(spark, sf))


@query
def term_doc_frequency(spark, sf):
    return terms.term_doc_frequency(fx.texts(spark, sf))


@query
def top_terms_by_count(spark, sf):
    return terms.top_terms_by_count(terms.term_doc_frequency(fx.texts(spark, sf)))


@query
def top_bigrams(spark, sf):
    return terms.top_bigrams(fx.texts(spark, sf))


@query
def tfidf_top_terms(spark, sf):
    return _rounded(terms.tfidf_top_terms(fx.texts(spark, sf)), "score")


@query
def tfidf_by_venue(spark, sf):
    return _rounded(terms.tfidf_top_terms(fx.texts(spark, sf), by=["venue"]), "score")


# Phrases


@query
def phrase_frequency(spark, sf):
    found = phrases.candidate_phrases(fx.texts(spark, sf))
    return _rounded(phrases.phrase_frequency(found), "freq")


@query
def rake_word_scores(spark, sf):
    found = phrases.candidate_phrases(fx.texts(spark, sf))
    return _rounded(phrases.word_scores(found), "score").drop("n_phrases")


@query
def rake_phrases(spark, sf):
    return _rounded(phrases.rake_phrases(fx.texts(spark, sf)), "rake")


@query
def rake_ranked_with_repeats(spark, sf):
    ranked = phrases.repeat_phrases(phrases.rake_phrases(fx.texts(spark, sf)))
    return _rounded(ranked, "rake")


@query
def rake_by_venue(spark, sf):
    return _rounded(phrases.rake_phrases(fx.texts(spark, sf), by=["venue"]), "rake")


# Topics


def _items(spark, sf):
    """All vectors; an item's frequency is the size of its label group."""
    vectors = fx.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "item_id")
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return vectors, phrases.phrase_frequency(sizes)


def _seeds(spark, sf):
    """One seed per label, its first vector; low labels are topic A, high labels topic B."""
    vectors = fx.table(spark, sf, "embeddings")
    return (
        vectors.groupBy("label")
        .agg(F.min_by("embedding", "vec_id").alias("embedding"))
        .select(F.when(F.col("label") < 5, "A").otherwise("B").alias("topic"), "embedding")
    )


def _assigned(spark, sf):
    vectors, freq = _items(spark, sf)
    return topics.assign_topics(
        vectors.join(freq, "label", "left"), _seeds(spark, sf), ["A", "B"]
    )


@query
def seed_similarity(spark, sf):
    vectors, _ = _items(spark, sf)
    similar = topics.seed_similarity(vectors.drop("label"), _seeds(spark, sf))
    return _rounded(similar, "similarity")


@query
def topic_items(spark, sf):
    return _rounded(_assigned(spark, sf).select("item_id", "topic", "score"), "score")


@query
def topic_top_items(spark, sf):
    top = topics.topic_top_items(_assigned(spark, sf))
    return _rounded(top.select("topic", "rank", "item_id", "score"), "score")


@query
def phrase_topic_hashed(spark, sf):
    """Keyphrases of all reviews to topics, embedded by hashed character trigrams."""
    found = phrases.candidate_phrases(fx.texts(spark, sf))
    ranked = phrases.phrase_frequency(phrases.score_phrases(found), counts=found)
    assigned = topics.phrase_topics(ranked, topics.embed_hashed)
    # Equal scores are equal in the ranking too, however their sums were rounded.
    assigned = assigned.withColumn("score", F.round("score", 9))
    top = topics.topic_top_items(assigned, ties=[F.desc("rake")], item_id="phrase")
    return _rounded(top.select("topic", "rank", "phrase", "n", "score"), "score")


@query
def phrase_topic_letters(spark, sf):
    """Keyphrases of all reviews to topics, embedded by how often each letter occurs."""

    def embed(df, column):
        letters = F.array(*[F.lit(c) for c in fx.LETTERS])
        counts = F.transform(
            letters,
            lambda c: (F.length(column) - F.length(F.replace(F.col(column), c, F.lit(""))))
            .cast("double"),
        )
        return df.withColumn("embedding", counts)

    found = phrases.candidate_phrases(fx.texts(spark, sf))
    ranked = phrases.phrase_frequency(phrases.score_phrases(found), counts=found)
    assigned = topics.phrase_topics(ranked, embed)
    return _rounded(assigned.select("phrase", "topic", "n", "score"), "score")


# Sentiment


@query
def sentiment_scores(spark, sf):
    scored = sentiment.sentiment_scores(fx.texts(spark, sf), fx.sentiment_words())
    return scored.select("ingest_seq", "compound")


def _labelled(spark, sf):
    return sentiment.sentiment_labels(fx.texts(spark, sf), fx.sentiment_words())


@query
def sentiment_labels(spark, sf):
    return _labelled(spark, sf).select("ingest_seq", "venue", "rating", "sentiment")


@query
def sentiment_conversations(spark, sf):
    """Another table and text column: turns of conversations."""
    turns = fx.table(spark, sf, "conversations")
    labelled = sentiment.sentiment_labels(turns, fx.sentiment_words(), text="text")
    return labelled.select("conv_id", "turn", "role", "sentiment")


@query
def sentiment_counts(spark, sf):
    return sentiment.sentiment_counts(_labelled(spark, sf))


@query
def sentiment_by_venue(spark, sf):
    return sentiment.sentiment_counts(_labelled(spark, sf), by=["venue"])


@query
def sentiment_conservation(spark, sf):
    return sentiment.sentiment_conservation(_labelled(spark, sf))


# Pages



@query
def page_cards(spark, sf):
    """Paragraphs stand for review cards here: the test pages have no review markup."""
    starts = [*pages.CARD_STARTS, "<p>", "<li>"]
    cards = pages.extract_cards(fx.table(spark, sf, "pages"), starts, ["(?s)^<p>(.*?)</p>"])
    return cards.select(
        "page_id", "pos", "id", "author", "text", "is_local_guide", "reviewer_total_reviews"
    )


@query
def review_cards(spark, sf):
    """Every page's links as review cards: the markup is written around titles and links.

    It has nested elements of the same name, all three kinds of quotes, and unclosed ones.
    """
    links = F.regexp_extract_all("html", F.lit('<a href="/[^"]*">([^<]*)</a>'), F.lit(1))
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))

    def card(t, i):
        said = F.when(
            i % 3 == 0,
            F.concat(F.lit('<span class="wiI7pd">'), title, F.lit("</span>")),
        ).when(
            i % 3 == 1,
            F.concat(
                F.lit("<span title='a > b' class='x wiI7pd'>"),
                title,
                F.lit(" <span><b>by</b></span> <span>"),
                t,
                F.lit("</span> and a tail</span>"),
            ),
        )
        return F.concat(
            F.lit("<div class='jftiEf x' data-review-id='"),
            F.concat_ws("-", F.col("page_id"), i),
            F.lit("'><div><div class=d4r55>"),
            t,
            F.lit(" <div>of <i>here</div></div><div>Local Guide · <b>"),
            i + 2,
            F.lit('</b> reviews</div></div><span class="kvMYJc" aria-label="'),
            i % 5 + 1,
            F.lit(" stars\"></span><span class='rsqaWe'>a <span>year</span> ago</span><div class=\"MyEned\">"),
            F.coalesce(said, F.concat(F.lit("<span>Late <span>"), title, F.lit("</span> <p>end<div>!</div></span>"))),
            F.lit("<button>More</button></div></div><p>Outside of every card, 99 reviews</p>"),
        )

    made = fx.table(spark, sf, "pages").withColumn("html", F.array_join(F.transform(links, card), ""))
    return pages.extract_cards(made).drop("url")


@query
def page_longest_paragraph(spark, sf):
    def blocks(tag):
        found = F.regexp_extract_all("html", F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
        return F.transform(found, html.inner_text)

    return fx.table(spark, sf, "pages").select(
        "page_id", html.longest_text(blocks("p"), blocks("li")).alias("longest")
    )


@query
def page_interstitial_flag(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id",
        html.is_interstitial(F.col("url"), F.col("html")).alias("is_interstitial"),
        html.is_profile_url(F.col("url")).alias("is_profile"),
    )


# Progress

N_PASSES = 50


def _passes(spark, sf):
    """Reviews in arrival order, cut into passes of equal size."""
    rows = fx.normalized(spark, sf)
    span = fx.table(spark, sf, "documents").agg(F.max("doc_id") + 1).scalar()
    return rows.withColumn("batch", F.floor(F.col("ingest_seq") * N_PASSES / span))


@query
def batch_progress(spark, sf):
    counters = progress.batch_counters(_passes(spark, sf), fx.cutoff())
    table = progress.progress(counters)
    return table.withColumns(
        {c: F.col(c).cast("string") for c in ("oldest_date", "oldest_seen")}
    )


def _event_passes(spark, sf):
    hour = F.date_trunc("hour", "ts")
    return progress.arrivals(
        fx.table(spark, sf, "events"), "event_type", "user_id", hour, "event_id"
    )


@query
def stagnation_streak(spark, sf):
    streaks = progress.stagnation_streak(_event_passes(spark, sf))
    return streaks.withColumn("batch", F.date_format("batch", "yyyy-MM-dd HH:mm:ss"))


@query
def stop_reason(spark, sf):
    """Stops by target and by stagnation, for the same passes under different limits."""
    passes = _event_passes(spark, sf)
    runs = {
        "target": progress.stop_reason(passes, fx.PROGRESS_TARGET, 35),
        "stagnant": progress.stop_reason(passes, None, 35),
        "time": progress.stop_reason(passes, fx.PROGRESS_TARGET, 35, max_seconds=86_400),
    }
    out = None
    for name, run in runs.items():
        run = run.withColumn("run", F.lit(name))
        out = run if out is None else out.unionByName(run)
    return out.withColumn("batch", F.date_format("batch", "yyyy-MM-dd HH:mm:ss"))


@query
def stop_at_cutoff(spark, sf):
    counters = progress.batch_counters(
        _passes(spark, sf), F.lit("2024-06-01").cast("date"), ["review_key"]
    )
    limit = F.lit("2024-06-01").cast("date")
    return progress.stop_reason(counters, None, 35, limit, past_cutoff_limit=2)


@query
def progress_state(spark, sf):
    table = progress.progress(progress.batch_counters(_passes(spark, sf), fx.cutoff()))
    return progress.progress_state(table.select("venue", "batch", "n_added", "total_added"))
