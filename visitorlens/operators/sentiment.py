"""Lexicon sentiment (Hutto & Gilbert 2014) computed inside the row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitorlens.functions.expr import let
from visitorlens.functions.scores import label_sentiment
from visitorlens.functions.text import strip
from visitorlens.operators.scale import hot_key_join

# Bytes of a lexicon that may travel as a constant in the plan.
MAX_CONSTANT_BYTES = 1_000_000
# What an entry takes beside its term.
ENTRY_BYTES = 16

# Fixed values of the published method: empirical increments and factors.
CAPS_INCREMENT = 0.733
BOOST = 0.293
NEGATION_FACTOR = -0.74
DISTANCE_DAMPING = [1.0, 0.95, 0.9]
NEVER_SO_FACTORS = [1.5, 1.25]
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
EXCLAMATION_STEP = 0.292
MAX_EXCLAMATIONS = 4
QUESTION_STEP = 0.18
MANY_QUESTIONS = 0.96
NORMALISER = 15.0

# Fixed values of the published method: intensifying words.
INTENSIFIERS = """
absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely
especially exceptionally extremely fabulously flipping flippin fricking frickin frigging friggin
fully fucking greatly hella highly hugely incredibly intensely majorly more most particularly
purely quite really remarkably so substantially thoroughly totally tremendously uber unbelievably
unusually utterly very
""".split()

# Fixed values of the published method: dampening words.
DAMPENERS = """
almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely
slightly somewhat sorta sortof sort-of
""".split()

# Fixed values of the published method: negations (any word containing n't counts as well).
NEGATIONS = """
aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't
doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't
mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt
uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't
wouldn't rarely seldom despite
""".split()

# Fixed values of the published method: marks that may be cut from one end of a word.
WORD_MARKS = ["?!?!", "!?!?", "!!!", "???", "?!?", "!?!", "!!", "??"]
SINGLE_MARKS = r"[.!?,;:'\"-]"
NO_PUNCTUATION = r"[^!-/:-@\[-`{-~]{2,}"


@dataclass(frozen=True)
class SentimentWords:
    """The word lists of a scorer.

    ``lexicon`` is ``{term: valence}`` or a table ``(term, valence)``. No lexicon
    is shipped: it is data of the caller.
    """

    lexicon: Mapping[str, float] | DataFrame
    boosters: Mapping[str, float] = field(
        default_factory=lambda: {
            **dict.fromkeys(INTENSIFIERS, BOOST),
            **dict.fromkeys(DAMPENERS, -BOOST),
        }
    )
    negations: Iterable[str] = tuple(NEGATIONS)


def edge_mark_pattern() -> str:
    """A word with one known mark at its front or at its end, and no other punctuation."""
    marks = "|".join([*(m.replace("?", "\\?") for m in WORD_MARKS), SINGLE_MARKS])
    return f"^(?:{marks})({NO_PUNCTUATION})$|^({NO_PUNCTUATION})(?:{marks})$"


def sentiment_tokens(text: Column) -> Column:
    """White-space words of at least two characters, freed of a mark at one end; case kept."""
    words = F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: F.length(w) > 1)
    return F.transform(words, lambda w: F.regexp_replace(w, edge_mark_pattern(), "$1$2"))


def _is_upper(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def _is_one_of(word: Column, terms: Iterable[str]) -> Column:
    listed = sorted(set(terms))
    return word.isin(listed) if listed else F.lit(False)


class _Context:
    """Rules that look at the words around a scored word of one document."""

    def __init__(self, words: Column, valences: Column, spec: SentimentWords):
        self.words = words
        self.valences = valences
        self.spec = spec
        upper = F.size(F.filter(words, _is_upper))
        self.mixed_case = (upper > 0) & (upper < F.size(words))

    def back(self, i: Column, distance: int) -> Column:
        # get() with a negative index is null, which stands for "no such word".
        return F.get(self.words, i - distance)

    def negates(self, word: Column) -> Column:
        lowered = F.lower(word)
        return F.coalesce(
            _is_one_of(lowered, self.spec.negations) | F.contains(lowered, F.lit("n't")),
            F.lit(False),
        )

    def boost(self, word: Column) -> Column:
        """Weight of a booster, 0 for any other word."""
        by_weight: dict[float, list[str]] = {}
        for term, weight in self.spec.boosters.items():
            by_weight.setdefault(weight, []).append(term)
        lowered = F.lower(word)
        value = F.lit(0.0)
        for weight, terms in sorted(by_weight.items()):
            value = F.when(_is_one_of(lowered, terms), F.lit(float(weight))).otherwise(value)
        return value

    def emphasis(self, value: Column, mixed_case: Column, word: Column) -> Column:
        """Capital letters push away from zero when not everything is capitals."""
        push = F.when(value > 0, F.lit(CAPS_INCREMENT)).otherwise(F.lit(-CAPS_INCREMENT))
        return F.when(_is_upper(word) & mixed_case, push).otherwise(F.lit(0.0))

    def after_word_before(
        self, value: Column, i: Column, distance: int, mixed_case: Column
    ) -> Column:
        """Effect of the word ``distance`` places back: boost first, then negation."""
        word = self.back(i, distance)
        weight = self.boost(word)
        signed = F.when(value < 0, -weight).otherwise(weight)
        change = F.when(
            weight != 0, (signed + self.emphasis(value, mixed_case, word))
        ).otherwise(F.lit(0.0)) * F.lit(DISTANCE_DAMPING[distance - 1])
        boosted = value + change

        factor = F.when(self.negates(word), F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0))
        so_next = F.coalesce(self.back(i, distance - 1).isin("so", "this"), F.lit(False))
        never_so = (word == "never") & so_next
        if distance == 2:
            factor = F.when(never_so, F.lit(NEVER_SO_FACTORS[0])).otherwise(factor)
        elif distance == 3:
            so_before = F.coalesce(self.back(i, 1).isin("so", "this"), F.lit(False))
            factor = F.when(never_so | so_before, F.lit(NEVER_SO_FACTORS[1])).otherwise(factor)
        # Words that carry their own valence, and missing words, change nothing.
        acts = word.isNotNull() & F.get(self.valences, i - distance).isNull()
        return F.when(acts, boosted * factor).otherwise(value)

    def least_factor(self, i: Column) -> Column:
        """``least`` reverses, unless it is ``at least`` or ``very least``."""
        least = (F.lower(self.back(i, 1)) == "least") & F.get(self.valences, i - 1).isNull()
        harmless = F.coalesce(F.lower(self.back(i, 2)).isin("at", "very"), F.lit(False))
        return F.when(least & ~harmless, F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0))

    def valence_at(self, i: Column, mixed_case: Column) -> Column:
        word = F.get(self.words, i)
        start = F.get(self.valences, i)

        def after(distance: int, value: Column) -> Column:
            if distance > 3:
                return value * self.least_factor(i)
            return let(
                self.after_word_before(value, i, distance, mixed_case),
                lambda v: after(distance + 1, v),
            )

        emphasised = start + self.emphasis(start, mixed_case, word)
        return let(emphasised, lambda v: after(1, v))

    def scores_nothing(self, i: Column) -> Column:
        """Boosters, and the ``kind`` of ``kind of``, have no valence of their own."""
        word = F.lower(F.get(self.words, i))
        next_of_first = F.get(
            self.words, F.array_position(self.words, F.get(self.words, i)).cast("int")
        )
        kind_of = (word == "kind") & F.coalesce(F.lower(next_of_first) == "of", F.lit(False))
        return _is_one_of(word, self.spec.boosters) | kind_of

    def total(self) -> Column:
        hits = F.array_compact(
            F.transform(
                self.valences, lambda v, i: F.when(v.isNotNull() & ~self.scores_nothing(i), i)
            )
        )
        but_at = F.array_position(F.transform(self.words, F.lower), "but") - 1

        def add_up(at: Column, mixed_case: Column, but: Column) -> Column:
            def contribution(p: Column) -> Column:
                # A repeated word takes the context of its first occurrence.
                first = (F.array_position(self.words, F.get(self.words, p)) - 1).cast("int")
                share = (
                    F.when(but < 0, F.lit(1.0))
                    .when(p < but, F.lit(BEFORE_BUT))
                    .when(p > but, F.lit(AFTER_BUT))
                    .otherwise(F.lit(1.0))
                )
                return let(first, lambda i: self.valence_at(i, mixed_case)) * share

            return F.aggregate(
                F.transform(at, contribution), F.lit(0.0), lambda acc, x: acc + x
            )

        # Most texts of a corpus have few scored words: nothing else runs without one.
        return let(
            hits,
            lambda at: F.when(F.size(at) == 0, F.lit(0.0)).otherwise(
                let(
                    F.struct(self.mixed_case.alias("m"), but_at.alias("b")),
                    lambda s: add_up(at, s["m"], s["b"]),
                )
            ),
        )


def _punctuation(text: Column) -> Column:
    def count(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    questions = count("?")
    return F.least(count("!"), F.lit(MAX_EXCLAMATIONS)) * F.lit(EXCLAMATION_STEP) + F.when(
        questions > 3, F.lit(MANY_QUESTIONS)
    ).when(questions > 1, questions * F.lit(QUESTION_STEP)).otherwise(F.lit(0.0))


def compound_score(
    text: Column, spec: SentimentWords, lookup: Callable[[Column], Column]
) -> Column:
    """Score in [-1, 1], four decimals; 0 for text without any lexicon word."""

    def from_words(words: Column) -> Column:
        valences = F.transform(words, lambda w: lookup(F.lower(w)))
        return let(valences, lambda v: _Context(words, v, spec).total())

    total = let(sentiment_tokens(text), from_words)

    def finish(s: Column) -> Column:
        emphasised = s + F.signum(s) * _punctuation(F.coalesce(text, F.lit("")))
        return F.round(
            let(emphasised, lambda e: e / F.sqrt(e * e + F.lit(NORMALISER))), 4
        )

    return let(total, finish)


def sentiment_scores(
    reviews: DataFrame,
    spec: SentimentWords,
    text: str = "review_text",
) -> DataFrame:
    """Adds ``compound``. Null or blank text scores 0.

    A term that a lexicon table lists several times has the mean of its valences.
    A lexicon of up to a megabyte becomes a constant of the plan: one narrow pass, no
    join, no shuffle. A larger one is joined with the distinct words of the distinct
    texts instead, with the same result.
    """
    lexicon = spec.lexicon
    if not isinstance(lexicon, DataFrame):
        if sum(len(t.encode()) + ENTRY_BYTES for t in lexicon) > MAX_CONSTANT_BYTES:
            rows = [(term, float(valence)) for term, valence in lexicon.items()]
            lexicon = reviews.sparkSession.createDataFrame(rows, "term string, valence double")
    if isinstance(lexicon, DataFrame):
        entries = lexicon_entries(lexicon)
        size = entries.agg(F.sum(F.octet_length("term") + ENTRY_BYTES)).first()[0] or 0
        if size > MAX_CONSTANT_BYTES:
            return score_with_lexicon_table(reviews, spec, text, entries)
        lexicon = {row.term: row.valence for row in entries.collect()}
    return reviews.withColumn("compound", compound_score(F.col(text), spec, constant_valences(lexicon)))


def constant_valences(lexicon: Mapping[str, float]) -> Callable[[Column], Column]:
    """Valence of a word, or null. Spark keeps an IN list as a hash set, which nearly all
    words fail; only the few that pass are looked up in the map."""
    terms = sorted(lexicon)
    table = F.from_json(F.lit(json.dumps({t: float(lexicon[t]) for t in terms})), "map<string,double>")
    if not terms:
        return lambda word: F.lit(None).cast("double")
    return lambda word: F.when(word.isin(terms), F.try_element_at(table, word))


def lexicon_entries(lexicon: DataFrame) -> DataFrame:
    """``(term, valence)`` with one row per term: the mean of its valences; nulls are left out."""
    known = lexicon.select("term", F.col("valence").cast("double").alias("valence")).dropna()
    return known.groupBy("term").agg(F.avg("valence").alias("valence"))


def score_with_lexicon_table(
    reviews: DataFrame, spec: SentimentWords, text: str, entries: DataFrame
) -> DataFrame:
    """The way for a lexicon of any size: each distinct text first fetches its own entries.

    What a text needs depends on the text alone, so texts are told apart by their
    SHA-256, and copies fetch once. A text held by very many rows is broadcast.
    """
    keyed = reviews.withColumn("_text_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    words = F.array_distinct(F.transform(sentiment_tokens(F.col(text)), F.lower))
    texts = keyed.groupBy("_text_key").agg(
        F.first(words).alias("_words"), F.count(F.lit(1)).alias("_rows")
    )
    used = texts.select("_text_key", F.explode("_words").alias("term"))
    per_term = used.groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    found = hot_key_join(used, entries.join(per_term, "term"), "term", "_n")
    own = found.groupBy("_text_key").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "valence"))).alias("_own")
    )
    known = texts.drop("_words").join(own, "_text_key", "left")
    joined = hot_key_join(keyed, known, "_text_key", "_rows").drop("_rows", "_text_key")
    empty = F.from_json(F.lit("{}"), "map<string,double>")
    entry_of = F.coalesce(F.col("_own"), empty)
    return joined.withColumn(
        "compound",
        compound_score(F.col(text), spec, lambda w: F.try_element_at(entry_of, w)),
    ).drop("_own")


def sentiment_labels(
    reviews: DataFrame,
    spec: SentimentWords,
    text: str = "review_text",
) -> DataFrame:
    """Every row and column plus ``sentiment``: Positive, Neutral or Negative."""
    scored = sentiment_scores(reviews, spec, text)
    return scored.withColumn("sentiment", label_sentiment(F.col("compound"))).drop("compound")


def sentiment_counts(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, sentiment, n)``, most frequent label first. Absent labels have no row."""
    return (
        labelled.groupBy(*by, "sentiment")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*by, F.desc("n"), "sentiment")
    )


def sentiment_conservation(labelled: DataFrame) -> DataFrame:
    """One row: total rows, labelled rows, and whether they agree."""
    return labelled.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("sentiment").alias("n_labelled"),
    ).withColumn("conserved", F.col("n_rows") == F.col("n_labelled"))
