"""Keyword mentions by rating: whole-word matching, grouped counts and the report pivot."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitorlens.functions.text import standardize_rating
from visitorlens.operators.scale import null_safe_join
from visitorlens.schema import RATING_BUCKETS

# The keywords tracked when the caller names none.
DEFAULT_KEYWORDS = [
    "seat",
    "parking",
    "staff",
    "acoustics",
    "website",
    "lobby",
    "security",
    "experience",
    "sound",
    "navigation",
]

# Characters of keywords that are broadcast as they stand; a larger table is met by hashes first.
BLOCK_CHARS = 16_000_000
# What a keyword takes in a broadcast beside its characters.
ENTRY_CHARS = 64
# Hashes of keywords that are broadcast; without them the counted windows are joined alone.
HASHED_KEYWORDS = 2_000_000
# Keywords of up to so many runs are looked up whole, longer ones by their first so many.
HEAD_RUNS = 3
# The shape of a keyword that is one run of word characters.
ONE_WORD = (1, True)
# A table with more kinds of other characters than that is met by runs of any of them.
MAX_MARKS = 500

# Letters, digits and underscore of any script. Spelled out because the meaning of
# \w and \b in Java depends on the version, and is ASCII-only in recent ones. Java tries the
# parts in this order, and most letters are among the first.
WORD_CHAR = r"[a-z0-9_\p{L}\p{N}]"
OTHER_CHAR = r"[^a-z0-9_\p{L}\p{N}]"
RUNS = f"({WORD_CHAR}+|{OTHER_CHAR}+)"


def _edge(neighbour: str, char_is_word: bool, look: str) -> str:
    # A word boundary next to a word character means "no word character beyond";
    # next to any other character it means "a word character beyond".
    sign = "!" if char_is_word else "="
    return f"(?{look}{sign}{neighbour})"


def keyword_pattern(keyword: str) -> str:
    """Java pattern for ``keyword`` between word boundaries, matched literally."""

    def is_word(ch: str) -> bool:
        return ch.isalnum() or ch == "_"

    literal = "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    before = _edge(WORD_CHAR, is_word(keyword[0]), "<")
    after = _edge(WORD_CHAR, is_word(keyword[-1]), "")
    return before + literal + after


def mentions(text: Column, keyword: str) -> Column:
    """True when lower-cased ``text`` contains ``keyword`` as a whole word; null text never does.

    The plain substring test runs first: most texts fail it and skip the regex.
    """
    lowered = F.lower(text)
    found = F.contains(lowered, F.lit(keyword)) & lowered.rlike(keyword_pattern(keyword))
    return F.coalesce(found, F.lit(False))


def _keywords_hit(text: Column, keywords: Sequence[str]) -> Column:
    """Array of the keywords that occur in the text, each at most once."""
    return F.array_compact(
        F.array(*[F.when(mentions(text, kw), F.lit(kw)) for kw in dict.fromkeys(keywords)])
    )


def keyword_mentions(
    reviews: DataFrame,
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    by: Sequence[str] = (),
    text: str = "review_text",
    rating: str = "rating",
) -> DataFrame:
    """``(*by, keyword, rating, n)``: reviews mentioning a keyword, counted once per review.

    One pass over the text: the list is evaluated inside the row and only hits
    are exploded, into partial counts; nothing but counts is shuffled.
    """
    return (
        reviews.select(
            *by,
            standardize_rating(F.col(rating)).alias("rating"),
            F.explode(_keywords_hit(F.col(text), keywords)).alias("keyword"),
        )
        .groupBy(*by, "keyword", "rating")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def keyword_table_mentions(
    reviews: DataFrame,
    keyword_table: DataFrame,
    by: Sequence[str] = (),
    text: str = "review_text",
    rating: str = "rating",
) -> DataFrame:
    """Like ``keyword_mentions`` for a keyword *table* (column ``keyword``) of any size.

    Cut a text into maximal runs of word and of other characters and drop the
    marks at its two ends. A keyword between word boundaries is then exactly a
    sequence of whole runs, and equal to the text's characters there. So a text's distinct
    windows of one to ``HEAD_RUNS`` runs, of the lengths that keywords have, are joined with the
    keywords by equality: how many keywords begin alike plays no part. Of longer keywords the first
    runs are joined so, with the lengths that follow them, and the windows of those lengths
    at the places found are joined with the keywords in turn. Windows with a character between
    words that no keyword has are never made: single words are cut out by one split of the text, and
    windows with marks are looked for only in the stretches that hold one.

    A table that is too large to be broadcast is joined with counted windows, after those
    whose hash no keyword has were dropped.
    """
    keys = keyword_table.select("keyword").filter(F.col("keyword") != "")
    # An aggregate, since Spark holds whatever is filtered by an expression of a keyword against every
    # window that it is joined with.
    runs = F.size(F.regexp_extract_all("keyword", F.lit(RUNS)))
    keys = keys.groupBy("keyword").agg(F.max(runs).alias("_length"))
    first_is_word = F.col("keyword").rlike(f"^{WORD_CHAR}")
    shape = F.struct(F.least("_length", F.lit(HEAD_RUNS + 1)).alias("length"), first_is_word.alias("word"))
    marks = F.array_distinct(F.regexp_extract_all("keyword", F.lit(OTHER_CHAR), 0))
    # The first row of a keyword counts for it.
    first = F.coalesce(F.col("_i"), F.lit(0)) == 0
    measured = (
        keys.select("keyword", shape.alias("_shape"), F.posexplode_outer(marks).alias("_i", "_mark"))
        .agg(
            F.sum(F.when(first, F.length("keyword") + ENTRY_CHARS)).alias("size"),
            F.count(F.when(first, 1)).alias("n"),
            F.collect_set("_shape").alias("shapes"),
            F.collect_set("_mark").alias("marks"),
        )
        .first()
    )
    small = (measured.size or 0) <= BLOCK_CHARS
    hashed = measured.n <= HASHED_KEYWORDS
    whole = sorted((s.length, s.word) for s in measured.shapes if s.length <= HEAD_RUNS)
    longer = sorted(s.word for s in measured.shapes if s.length > HEAD_RUNS)
    between = _one_of(measured.marks)
    lowered = F.lower(F.col(text))
    rated = [*by, standardize_rating(F.col(rating)).alias("rating")]

    def counted(found: DataFrame, known: DataFrame) -> DataFrame:
        """Reviews of every keyword from ``found``, the windows of each review, each once."""
        found = found.withColumnRenamed("_window", "keyword")
        known = known.select("keyword")
        if small:
            found = found.join(F.broadcast(known), "keyword")
        elif hashed:
            hashes = known.select(F.xxhash64("keyword").alias("_hash")).distinct()
            found = found.withColumn("_hash", F.xxhash64("keyword"))
            found = found.join(F.broadcast(hashes), "_hash", "left_semi")
        counts = found.groupBy(*by, "keyword", "rating").agg(F.count(F.lit(1)).alias("n"))
        return counts if small else counts.join(known, "keyword").select(*by, "keyword", "rating", "n")

    texts = reviews.select(*rated, lowered.alias("_lowered"))
    if longer or any(s != ONE_WORD for s in whole):
        texts = texts.withColumn("_marked", _with_marks(F.col("_lowered"), measured.marks))
    # Windows of different shapes differ. Arrays are exploded where they are made: of a column, Spark
    # would make them twice, and the other columns made beside them would be made for every window.
    windows = [
        F.split("_lowered", f"{OTHER_CHAR}+")
        if s == ONE_WORD
        else F.regexp_extract_all("_marked", F.lit(_window_pattern(*s, between)))
        for s in whole
    ]
    windows = F.concat(*map(F.array_distinct, windows)) if windows else F.array().cast("array<string>")
    found = texts.select(*by, "rating", F.explode(windows).alias("_window"))
    result = counted(found, keys.filter(F.col("_length") <= HEAD_RUNS))
    if longer:
        known = keys.filter(F.col("_length") > HEAD_RUNS)
        # As long as the shortest of them with a word before and after it.
        stretch = f"{WORD_CHAR}++(?:{between}++{WORD_CHAR}++){{{(HEAD_RUNS + 1) // 2},}}+"
        stretches = F.array_distinct(F.regexp_extract_all("_marked", F.lit(f"({stretch})")))
        texts = texts.select(*by, "rating", "_marked", F.monotonically_increasing_id().alias("_doc"))
        texts = texts.select(*by, "rating", "_doc", F.explode(stretches).alias("_text"))
        found = _longer_windows(texts, known, longer, between, small)
        result = result.unionByName(counted(found, known))
    return result


def _one_of(marks: Sequence[str]) -> str:
    """Java pattern for the characters between words that keywords have."""
    if not 0 < len(marks) <= MAX_MARKS:
        return OTHER_CHAR
    return "[" + "".join(f"\\x{{{ord(mark):x}}}" for mark in sorted(marks)) + "]"


def _with_marks(lowered: Column, marks: Sequence[str]) -> Column:
    """The stretches of words and ``marks`` in a text that hold a mark, each once, a space apart. Every
    window with a mark and its neighbours lie in one. White space among the marks, as in
    phrases, would join most of the text to one stretch: then, as without marks, the text is left as it is."""
    one_of = _one_of(marks)
    if one_of == OTHER_CHAR or any(mark.isspace() for mark in marks):
        return lowered
    either = f"(?:{WORD_CHAR}|{one_of})"
    stretch = f"((?<!{either}){WORD_CHAR}*+{one_of}{either}*+)"
    stretches = F.array_distinct(F.regexp_extract_all(lowered, F.lit(stretch)))
    return F.when(lowered.rlike(one_of), F.array_join(stretches, " ")).otherwise(F.lit(""))


def _window_pattern(length: int, word: bool, between: str) -> str:
    """Java pattern whose group is a window of ``length`` runs of a text, the first of them of
    word characters or not. A match ends with the first run, so windows overlap."""
    kinds = [WORD_CHAR if word == (i % 2 == 0) else between for i in range(length)]
    before = f"(?<!{WORD_CHAR})" if word else f"(?<={WORD_CHAR})"
    after = "" if kinds[-1] == WORD_CHAR else f"(?={WORD_CHAR})"
    rest = "".join(f"{kind}++" for kind in kinds)
    if length == 1:
        return f"{before}({rest}){after}"
    return f"{before}(?=({rest}{after})){kinds[0]}++"


def _longer_windows(
    stretches: DataFrame, known: DataFrame, starts: Sequence[bool], between: str, small: bool
) -> DataFrame:
    """The distinct windows in ``_window`` of every ``_doc`` that are as long as a keyword with the same
    first runs. A stretch (``_text``) of a document starts and ends with a word. The first runs of a
    table that is not small are met by their hashes."""
    head = F.array_join(F.slice(F.regexp_extract_all("keyword", F.lit(RUNS)), 1, HEAD_RUNS), "")
    heads = known.groupBy((head if small else F.xxhash64(head)).alias("_head"))
    heads = heads.agg(F.collect_set("_length").alias("_lengths"))

    def places(word: bool) -> Column:
        # The windows that start with a word begin at the runs 1, 3, 5 and so on of the stretch.
        found = F.regexp_extract_all("_text", F.lit(_window_pattern(HEAD_RUNS, word, between)))
        first = 1 if word else 2
        return F.transform(
            found,
            lambda w, i: F.struct(
                (i * 2 + first).alias("_at"), (w if small else F.xxhash64(w)).alias("_head")
            ),
        )

    others = [c for c in stretches.columns if c != "_text"]
    placed = stretches.withColumn("_runs", F.regexp_extract_all("_text", F.lit(RUNS)))
    placed = placed.select(*others, "_runs", F.inline(F.concat(*[places(word) for word in starts])))
    met = placed.join(F.broadcast(heads), "_head").withColumn("_length", F.explode("_lengths"))
    window = F.array_join(F.slice("_runs", F.col("_at"), F.col("_length")), "")
    return met.select(*others, window.alias("_window")).distinct().drop("_doc")


def keyword_by_rating(
    reviews: DataFrame,
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    ratings: Sequence[str] = RATING_BUCKETS,
    by: Sequence[str] = (),
    text: str = "review_text",
    rating: str = "rating",
) -> DataFrame:
    """The report: one row per keyword (and group), one column per rating, zero-filled.

    Every keyword keeps a row. Ratings outside ``ratings`` are not reported. The
    pivot is a set of conditional counts in the same single pass.
    """
    listed = json.dumps([{"i": i, "k": k} for i, k in enumerate(dict.fromkeys(keywords))])
    entries = F.from_json(F.lit(listed), "array<struct<i:int,k:string>>")
    long = keyword_mentions(reviews, keywords, by, text, rating)
    wide = long.groupBy(*by, "keyword").pivot("rating", list(ratings)).agg(F.sum("n"))
    groups = reviews.select(*by).distinct() if by else reviews.sparkSession.range(1).select()
    rows = groups.select(*by, F.explode(entries).alias("e")).select(
        *by, F.col("e.k").alias("keyword"), F.col("e.i").alias("keyword_no")
    )
    return (
        null_safe_join(rows, wide, [*by, "keyword"], "left")
        .na.fill(0, list(ratings))
        .orderBy(*by, "keyword_no")
        .select(*by, "keyword", *ratings)
    )
