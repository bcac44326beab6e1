"""Quality rules: base counts of a text, and rule cutoffs with a guaranteed false rejection.

Every document gets scores in thousandths (0 to 1000), higher is worse. A rule rejects
scores from its cutoff on, and a document goes if any rule rejects it. Cutoffs are chosen
per stratum from labelled documents, all rules of a stratum together:

* labelled documents are halved by a hash of their id, into a tuning and a holdout half;
* the tuning half gives a nested family of cutoff vectors, one for each share in ``LEVELS``:
  each rule's cutoff leaves at most that share of the good tuning documents at or beyond
  it, and lies halfway from there to where bad documents begin: to the next of their scores
  but the closest tenth, rounded up, which tells little. A rule without a bad document
  beyond is off. Of the family the vector with the greatest gain on the tuning half is
  taken: bad documents rejected less ``good_weight`` times good ones; ties go to the more
  lenient one, and without a gain the stratum rejects nothing;
* that one vector is tested on the holdout half. Its p-value is the exact binomial
  probability that so few of the ``n`` good holdout documents are rejected by any rule
  if the true false rejection is ``max_loss``. Strata are certified by Holm's procedure: in
  the order of their p-values, while the i-th of ``m`` is at most ``risk / (m - i + 1)``.

So with probability ``1 - risk`` no stratum loses more than ``max_loss`` of its good
documents to the method. Without any false rejection the holdout half of a stratum needs
``ln(risk / m) / ln(1 - max_loss)`` good documents: 59 for one stratum, 86 for four.
A stratum with too few labels rejects nothing.

Defined cases: a null text has no words and fails the base rules; a null stratum is a
stratum of its own; a document with several labels counts as good if one of them says
so; rows with the same id each count with that label; null labels and labels without a
document are left out; an empty table gives no rows; scores of texts without words
are 0. Equal windows of three words are recognised by a 64-bit hash. Columns of any name
pass through; of the columns that ``judge_quality`` adds, existing ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitorlens.llm.common import cut, free_name, quoted
from visitorlens.operators.scale import is_small

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["symbols", "dup_lines", "repeats", "capitals"]
MIN_WORDS = 50
MAX_LOSS, RISK, GOOD_WEIGHT = 0.05, 0.05, 20
# Shares of good tuning documents that a rule of a cutoff vector may reject.
LEVELS = [0.0, 0.001, 0.002, 0.005, 0.01, 0.02]
SEED = 77
# Labels are sent to the documents if there are at most so many (16 bytes each).
BROADCAST_LABELS = 500_000
HELPERS = "_spaced _lines _words _triples _pairs _of _cutoffs".split()
RESULTS = ["_counts", "_failed", "_kept"]


def _covered(pairs: Column) -> Column:
    """Words covered by windows that occur twice; ``pairs`` are ``(hash, start)`` in order."""
    repeated = F.filter(
        pairs,
        lambda p, i: (F.get(pairs, i - 1)["hash"] == p["hash"])
        | (F.get(pairs, i + 1)["hash"] == p["hash"]),
    )
    starts = F.sort_array(F.transform(repeated, lambda p: p["start"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda done, at: F.struct(
            (done["words"] + at + 3 - F.greatest(at, done["end"])).alias("words"),
            (at + 3).alias("end"),
        ),
        lambda done: done["words"],
    )


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one column ``_counts`` of the base counts and what the scores need.

    Every array is a column of its own before it is used twice, so it is built once. The
    counts come out of an explode of one element: Spark doesn't move a filter on them
    below it, where it would put the expressions in place of the columns and build the
    arrays anew for every element.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = text
    for space in SPACES:
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    words = F.array_remove(F.split(F.col("_spaced"), " "), "")
    triples = F.transform(
        F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    pairs = F.when(
        F.size(F.array_distinct("_triples")) < F.size("_triples"),
        F.sort_array(
            F.transform("_triples", lambda h, i: F.struct(h.alias("hash"), i.alias("start")))
        ),
    )

    def number(value: Column, name: str) -> Column:
        return F.coalesce(value, F.lit(0)).cast("long").alias(name)

    done = docs.withColumns({"_spaced": spaced, "_lines": lines})
    done = done.withColumn("_words", words)
    done = done.withColumn("_triples", triples)
    done = done.withColumn("_pairs", pairs)
    counts = F.struct(
        number(F.size("_words"), "n_words"),
        number(F.length(F.replace("_spaced", F.lit(" "), F.lit(""))), "word_chars"),
        number(F.regexp_count(text, F.lit(SYMBOLS)), "n_symbols"),
        number(F.size("_lines") - F.size(F.array_distinct("_lines")), "n_dup_lines"),
        number(_covered(F.col("_pairs")), "n_repeat_words"),
        number(F.size("_lines"), "n_lines"),
        number(F.regexp_count(text, F.lit("[A-Z]")), "n_capitals"),
    )
    return done.withColumn("_counts", F.explode(F.array(counts))).drop(
        "_spaced", "_lines", "_words", "_triples", "_pairs"
    )


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (
        100 * counts["n_repeat_words"] > 50 * counts["n_words"]
    )


def scores(counts: Column) -> dict[str, Column]:
    """Scores by rule, in whole thousandths."""

    def share(part: str, whole: str) -> Column:
        ratio = F.call_function("div", 1000 * counts[part], F.greatest(counts[whole], F.lit(1)))
        return F.least(ratio, F.lit(1000)).cast("int")

    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
    }


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, whose error is below 1e-13, less ln of the steps."""
    x = n + 11.0
    series = (
        (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    )
    steps = F.lit(0.0)
    for i in range(1, 11):
        steps = steps + F.log(n + float(i))
    return series - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) and k < n p: the terms from k down to 0, added up.

    The term j below the first is at most exp(-j^2 / 2np) of it. From ten times the root
    of np on that is under 1e-21, and what is left can't change a double.
    """
    top = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    terms = F.least(k, F.ceil(10 * F.sqrt(n * p)) + 60)
    added = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(terms - 1, F.lit(0)).cast("long")),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda done, i: F.struct(
            (done["sum"] + done["term"] * _down(k, n, p, i)).alias("sum"),
            (done["term"] * _down(k, n, p, i)).alias("term"),
        ),
        lambda done: done["sum"],
    )
    return F.exp(top) * added


def _down(k: Column, n: Column, p: float, i: Column) -> Column:
    """Ratio of the probability of k - i - 1 to that of k - i; 0 below 0."""
    return (k - i) * (1 - p) / ((n - k + i + 1) * p)


def cutoff_vectors(labelled: DataFrame, rules: Sequence[str]) -> DataFrame:
    """``(stratum, level, cutoffs)``: the nested family of every stratum, an array in the
    order of ``rules`` (null: the rule is off).

    ``labelled`` is reduced to counts per stratum, rule and score in each task before
    anything is shuffled: at most 1001 rows per stratum and rule.
    """
    tuning = labelled.filter(~F.col("holdout"))
    scored = [F.struct(F.lit(i).alias("rule"), F.col(r).alias("score")) for i, r in enumerate(rules)]
    long = tuning.select("stratum", "good", F.explode(F.array(*scored)).alias("x"))
    counts = long.groupBy("stratum", "x.rule", "x.score").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    whole = Window.partitionBy("stratum", "rule")
    beyond = whole.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select(
        "stratum",
        "rule",
        "score",
        "bad",
        F.sum("good").over(beyond).alias("lost"),
        F.sum("good").over(whole).alias("all"),
        F.explode(F.array(*map(F.lit, LEVELS))).alias("level"),
    )
    # The highest score that must stay, and the scores of bad documents above it.
    stays = F.max(F.when(F.col("lost") > F.col("level") * F.col("all"), F.col("score")))
    edges = ranked.groupBy("stratum", "rule", "level").agg(
        F.coalesce(stays, F.lit(0)).alias("edge"),
        F.sort_array(F.collect_list(F.when(F.col("bad") > 0, F.col("score")))).alias("bad"),
    )
    edges = edges.withColumn("bad", F.filter("bad", lambda b: b > F.col("edge")))
    skipped = F.least(F.ceil(F.size("bad") / 10), F.size("bad") - 1).cast("int")
    begin = F.get("bad", skipped)
    cutoff = F.call_function("div", F.col("edge") + 2 + begin, F.lit(2)).cast("int")
    vector = F.transform(
        F.sort_array(F.collect_list(F.struct("rule", cutoff.alias("cutoff")))), lambda x: x["cutoff"]
    )
    return edges.groupBy("stratum", "level").agg(vector.alias("cutoffs"))


def any_beyond(scores: Sequence[Column], cutoffs: Column) -> Column:
    """Whether any score reaches its cutoff; a cutoff that is null is off."""
    out = F.lit(False)
    for i, score in enumerate(scores):
        out |= F.coalesce(score >= F.get(cutoffs, F.lit(i)), F.lit(False))
    return out


def choose_cutoffs(
    labelled: DataFrame,
    rules: Sequence[str],
    max_loss: float = MAX_LOSS,
    risk: float = RISK,
    good_weight: float = GOOD_WEIGHT,
) -> DataFrame:
    """``(stratum, cutoffs)`` of every stratum whose chosen vector is certified.

    ``labelled`` has ``stratum``, ``good`` and ``holdout`` (booleans) and a score column for
    each rule.
    """
    labelled = cut(labelled.select("stratum", "good", "holdout", *rules))
    family = cut(cutoff_vectors(labelled, rules))
    listed = F.sort_array(F.collect_list(F.struct("level", "cutoffs")))
    by_stratum = family.groupBy(F.col("stratum").alias("_of")).agg(listed.alias("family"))
    if is_small(by_stratum):
        by_stratum = F.broadcast(by_stratum)
    joined = labelled.join(by_stratum, F.col("stratum").eqNullSafe(F.col("_of")))
    tried = joined.select(
        "stratum",
        "good",
        "holdout",
        F.inline(
            F.transform(
                "family",
                lambda v: F.struct(
                    v["level"].alias("level"),
                    any_beyond([F.col(r) for r in rules], v["cutoffs"]).alias("rejected"),
                ),
            )
        ),
    )
    good, bad, rejected = F.col("good"), ~F.col("good"), F.col("rejected")
    tuned = rejected & ~F.col("holdout")
    outcome = tried.groupBy("stratum", "level").agg(
        (F.count_if(tuned & bad) - good_weight * F.count_if(tuned & good)).alias("gain"),
        F.count_if(rejected & F.col("holdout") & good).cast("double").alias("k"),
        F.count_if(F.col("holdout") & good).cast("double").alias("n"),
    )
    best = F.max_by(F.struct("level", "gain", "k", "n"), F.struct("gain", -F.col("level")))
    chosen = outcome.groupBy("stratum").agg(best.alias("b")).select("stratum", "b.*")
    chosen = chosen.filter("gain > 0 AND n > 0")
    # The tail is summed below the mean only; from there on nothing is certified anyway.
    p = F.when(F.col("k") < F.col("n") * max_loss, binomial_tail(F.col("k"), F.col("n"), max_loss))
    tested = chosen.withColumn("p", F.coalesce(p, F.lit(1.0)))
    # One row per stratum: the windows are as long as there are strata with labels.
    every, in_order = Window.partitionBy(), Window.orderBy("p", "stratum")
    left = F.count(F.lit(1)).over(every) - F.row_number().over(in_order) + 1
    corrected = tested.withColumn("corrected", F.col("p") * left)
    worst = F.max("corrected").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    certified = corrected.withColumn("worst", worst).filter(F.col("worst") <= risk)
    kept = certified.select(F.col("stratum").alias("_s"), F.col("level").alias("_l"))
    same = F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("level") == F.col("_l"))
    return family.join(kept, same).select("stratum", "cutoffs")


def learn_cutoffs(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, **settings: float
) -> DataFrame:
    """``(_of, _cutoffs)`` per stratum from all labelled rows of ``docs``.

    ``docs`` may have ``_counts``. If not, only labelled documents are counted for it where
    the labels can be sent to the documents, else all; the text itself is never shuffled.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
    known = cut(known.agg((F.max("quality") > 0).alias("good")))
    columns = [F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum")]
    if "_counts" in docs.columns:
        counted = docs.select(*columns, "_counts").join(known, "doc_id")
    elif is_small(known, BROADCAST_LABELS):
        texts = docs.select(*columns, F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
        counted = with_counts(texts)
    else:
        texts = docs.select(*columns, F.col(text_col).alias("text"))
        counted = with_counts(texts).drop("text").join(known, "doc_id")
    by_rule = [c.alias(r) for r, c in scores(F.col("_counts")).items()]
    holdout = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)) == 0
    labelled = counted.select("stratum", "good", holdout.alias("holdout"), *by_rule)
    cutoffs = cut(choose_cutoffs(labelled, RULES, **settings))
    cutoffs = cutoffs.select(F.col("stratum").alias("_of"), F.col("cutoffs").alias("_cutoffs"))
    return F.broadcast(cutoffs) if is_small(cutoffs) else cutoffs


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    carry: Sequence[str] | None = None,
    **settings: float,
) -> DataFrame:
    """``docs`` with ``_counts``, ``_failed`` (base) and ``_kept``.

    Cutoffs come from all labelled rows of ``docs``. Only ids, strata and scores are
    shuffled for that; the verdict itself moves no text. ``carry`` names the columns that
    the result needs: without the text, every text is counted once and for both purposes.
    """
    docs = docs.drop(*RESULTS)
    clashing = {c: free_name(docs, f"{c}_") for c in docs.columns if c.lower() in HELPERS}
    columns = [clashing.get(c, c) for c in (docs.columns if carry is None else carry)]
    docs = docs.withColumnsRenamed(clashing)
    id_col, text_col, stratum_col = (clashing.get(c, c) for c in (id_col, text_col, stratum_col))
    if text_col in columns:
        cutoffs = learn_cutoffs(docs, labels, id_col, text_col, stratum_col, **settings)
        counted = with_counts(docs, text_col)
    else:
        wanted = dict.fromkeys([*columns, id_col, stratum_col])
        counted = with_counts(docs.select(*[quoted(c) for c in wanted], quoted(text_col)), text_col)
        counted = cut(counted.drop(text_col))
        cutoffs = learn_cutoffs(counted, labels, id_col, text_col, stratum_col, **settings)
    joined = counted.join(cutoffs, F.col(stratum_col).eqNullSafe(F.col("_of")), "left")
    rejected = any_beyond(list(scores(F.col("_counts")).values()), F.col("_cutoffs"))
    failed = base_failed(F.col("_counts"))
    judged = joined.withColumns({"_failed": failed, "_kept": ~failed & ~rejected})
    judged = judged.select(*[quoted(c) for c in columns], *RESULTS)
    return judged.withColumnsRenamed({v: k for k, v in clashing.items()})


def quality_report(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return judged.select(
        id_col,
        *[F.col("_counts")[c].alias(c) for c in COUNTS],
        F.col("_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the certified cutoffs."""
    clashing = {c: free_name(docs, f"{c}_") for c in docs.columns if c.lower() in RESULTS}
    judged = judge_quality(docs.withColumnsRenamed(clashing), labels, **columns)
    kept = judged.filter("_kept").select(*[quoted(clashing.get(c, c)) for c in docs.columns])
    return kept.withColumnsRenamed({v: k for k, v in clashing.items()})
