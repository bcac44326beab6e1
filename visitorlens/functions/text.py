"""Text functions: native column expressions, no Python code per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from visitorlens.functions.expr import let

# Every character Unicode calls white space plus the four ASCII separators.
# Spark's plain trim only removes U+0020.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Double-encoded ellipses and the stray lead byte, repaired in this order.
MOJIBAKE_REPAIRS = [("‚Ä¶", "…"), ("â€¦", "…"), ("Â", "")]

# The standard English stop-word list of the text-mining toolkit
# (179 entries). Contractions are listed with their apostrophe, as published.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()


# Fixed value: letters of the shortest word that is counted as a term.
MIN_CHARS = 2


def spark_stop_words(spark: SparkSession, language: str = "english") -> list[str]:
    """Spark ML's own stop-word list, plus the fragments cleaning makes of contractions."""
    from pyspark.ml.feature import StopWordsRemover

    return [*StopWordsRemover.loadDefaultStopWords(language), "d", "ll", "m", "o", "re", "ve", "y"]


def strip(col: Column) -> Column:
    """Null-safe trim of all Unicode white space; null becomes ``''``."""
    return F.btrim(F.coalesce(col, F.lit("")), F.lit(WHITESPACE))


def fix_mojibake(col: Column) -> Column:
    """Repair double-encoded ellipses, then delete every remaining ``Â``."""
    for bad, good in MOJIBAKE_REPAIRS:
        col = F.replace(col, F.lit(bad), F.lit(good))
    return col


def looks_truncated(col: Column) -> Column:
    """True when the text ends in an ellipsis, i.e. was cut by the page."""
    text = strip(col)
    return F.endswith(text, F.lit("...")) | F.endswith(text, F.lit("…"))


def standardize_rating(col: Column) -> Column:
    """Lower-case, trimmed rating label; null stays null."""
    return F.lower(F.btrim(col, F.lit(WHITESPACE)))


def stars(rating: Column) -> Column:
    """Star count 1..5 of a standard rating label, else null."""
    digit = F.regexp_extract(standardize_rating(rating), "^([1-5]) stars?$", 1)
    return digit.try_cast("int")


def clean_text(col: Column) -> Column:
    """Lower-case ASCII words separated by single spaces; null becomes ``''``.

    One regular expression is enough: whatever is not a-z becomes a single space.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z]+", " "))


def tokenize(col: Column, min_chars: int = 1) -> Column:
    """Words (a-z) of a text in order, as in its cleaned form; empty array for empty text.

    One pattern pass; cleaning, splitting and filtering would walk the text three times.
    """
    words = F.lit(f"([a-z]{{{min_chars},}})")
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), words)


def remove_terms(tokens: Column, terms: Iterable[str]) -> Column:
    """Drop the given terms. A literal IN list compiles to a hash-set probe."""
    drop = sorted(set(terms))
    return F.filter(tokens, lambda w: ~w.isin(drop)) if drop else tokens


def content_tokens(
    col: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS, min_chars: int = MIN_CHARS
) -> Column:
    """Tokens of at least ``min_chars`` letters that are not stop words."""
    return remove_terms(tokenize(col, min_chars), stop_words)


def ngrams(tokens: Column, sizes: tuple[int, int] = (1, 2)) -> Column:
    """All n-grams for n in ``sizes`` (inclusive) of a token array, inside the row.

    Call it on tokens from which stop words are already gone, so that n-grams
    bridge the removed words.
    """
    low, high = sizes

    def build(words: Column) -> Column:
        grams, parts = words, []
        for n in range(1, high + 1):
            if n > 1:
                tail = F.slice(words, n, F.greatest(F.size(words), F.lit(0)))
                grams = F.array_compact(
                    F.zip_with(grams, tail, lambda a, b: F.concat(a, F.lit(" "), b))
                )
            if n >= low:
                parts.append(grams)
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return let(tokens, build)


def ngrams_of(tokens: Column, words: Iterable[str], sizes: tuple[int, int] = (1, 2)) -> Column:
    """The n-grams of ``ngrams`` that consist of ``words``. Others are null, which costs little, until
    the last step."""
    listed = sorted(set(words))
    if not listed:
        return F.array().cast("array<string>")
    low, high = sizes

    def build(known: Column) -> Column:
        grams, parts = known, []
        for n in range(1, high + 1):
            if n > 1:
                tail = F.slice(known, n, F.greatest(F.size(known), F.lit(0)))
                grams = F.zip_with(grams, tail, lambda a, b: F.concat(a, F.lit(" "), b))
            if n >= low:
                parts.append(grams)
        return F.array_compact(F.concat(*parts))

    return let(F.transform(tokens, lambda w: F.when(w.isin(listed), w)), build)


def count_terms(terms: Column) -> Column:
    """``array<struct<term, tf>>``: distinct terms of an array with their counts.

    Sorts the array and measures run lengths, so a document is reduced to its
    distinct terms before anything is exploded, without a per-document shuffle.
    """

    def runs(ordered: Column) -> Column:
        starts = F.array_compact(
            F.transform(
                ordered,
                lambda w, i: F.when((i == 0) | (w != F.get(ordered, i - 1)), i),
            )
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda begin, j: F.struct(
                    F.get(ordered, begin).alias("term"),
                    (F.coalesce(F.get(at, j + 1), F.size(ordered)) - begin)
                    .cast("long")
                    .alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(terms), runs)


def split_phrases(
    col: Column,
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
    min_words: int = 2,
    max_words: int = 4,
) -> Column:
    """Maximal runs of non-stop words with ``min_words``..``max_words`` words.

    Stop words are replaced by a line break and the text is split there, which
    keeps the gaps-and-islands work inside the row.
    """
    stops = sorted(set(stop_words))
    marked = F.array_join(
        F.transform(tokenize(col), lambda w: F.when(w.isin(stops), F.lit("\n")).otherwise(w)), " "
    )
    runs = F.transform(F.split(marked, "\n"), lambda p: F.trim(p))
    return F.filter(
        runs, lambda p: (p != "") & F.size(F.split(p, " ")).between(min_words, max_words)
    )
