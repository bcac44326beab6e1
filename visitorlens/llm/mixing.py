"""Mixing sources: temperature weights, realised as budgeted permutations of blocks.

*Weights.* The token share of a source is raised to an exponent ``a`` in 0..1 and
normalised; 1 keeps the corpus as it is, 0 makes all sources equal. The exponent is the
least one (flattest mixture) that meets every given target: an entropy of at most
``entropy`` of the greatest possible one, and at most ``max_repeats`` passes over any
source. Both fall as ``a`` grows, so it is found by bisection. Each pass over the table
of sources halves the interval five times, by trying all the points that five halvings
could ask for.

*Budget.* ``budget`` tokens are dealt by weight. By default it is the least budget that
uses every source whole at least once, so no document is lost to mixing.

*Realisation.* The rows of a source are dealt into blocks by a hash of id and text, and a
block into parts. A source's budget covers some whole passes and a rest. In each pass the
blocks come in an order of its own, a keyed permutation. The rest takes blocks in order
while they fit, then parts of the next block while they fit. So a budget is never
exceeded, and what is left of it is less than one part, 1/65536 of the source or a row.

Defined cases: a null source is a source; a null text has no tokens; rows without tokens
cost nothing and go with their block; a source without any tokens has weight 0 and is
passed once; a single source has weight 1; equal rows are in the same part and go
together; an empty table gives no rows; existing columns with the names of the added ones
are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitorlens.llm.common import cut, free_name
from visitorlens.operators.scale import is_small

# Blocks of a source, and parts of a block. Plans have as many rows for each source.
BLOCKS = 256
MAX_REPEATS = 2.0
ENTROPY = 0.95
SEED = 4_242
HALVINGS = 5
# Exponents are exact to 2 ** -(HALVINGS * PASSES).
PASSES = 6


def count_tokens(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _digests(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(source_col).alias("source"),
        count_tokens(F.col(text_col)).alias("tokens"),
        *_places(id_col, text_col),
    )


def _places(id_col: str, text_col: str) -> list[Column]:
    """Block of a row, and part of the block."""
    key = F.xxhash64(id_col, text_col, F.lit(SEED))
    within = F.pmod(key, F.lit(BLOCKS * BLOCKS))
    block = F.call_function("div", within, F.lit(BLOCKS)).cast("int")
    return [block.alias("block"), F.pmod(within, F.lit(BLOCKS)).cast("int").alias("part")]


def solve_exponent(
    sources: DataFrame,
    budget: float | None = None,
    max_repeats: float | None = MAX_REPEATS,
    entropy: float | None = ENTROPY,
) -> float:
    """Least exponent in 0..1 that meets the targets, for sources with ``share`` > 0.

    If not even 1 meets them (the corpus itself is flatter or repeats more), it is 1.
    ``budget`` is in units of the whole corpus.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / 2**HALVINGS
        tried = [low + i * step for i in range(2**HALVINGS + 1)]
        powers = [F.pow("share", F.lit(a)) for a in tried]
        row = sources.agg(
            F.count(F.lit(1)),
            F.min("share"),
            F.max("share"),
            *[F.sum(p) for p in powers],
            *[F.sum(p * F.log("share")) for p in powers],
        ).first()
        count, least, most = row[:3]
        sums, logs = row[3 : 3 + len(tried)], row[3 + len(tried) :]
        if not count:
            return 1.0

        def meets(i: int) -> bool:
            a, total = tried[i], sums[i]
            if entropy is not None and count > 1:
                found = math.log(total) - a * logs[i] / total
                if found > entropy * math.log(count) + 1e-12:
                    return False
            if max_repeats is None:
                return True
            # Passes over a source are budget * weight / share, most for the smallest share.
            dealt = budget or total * most ** (1 - a)
            return dealt * least ** (a - 1) / total <= max_repeats * (1 + 1e-12)

        good = next((i for i in range(len(tried)) if meets(i)), None)
        if good is None:
            return 1.0
        if good == 0:
            return tried[0]
        low, high = tried[good - 1], tried[good]
    return high


def weigh_sources(
    digests: DataFrame,
    budget_tokens: int | None = None,
    max_repeats: float | None = MAX_REPEATS,
    entropy: float | None = ENTROPY,
) -> DataFrame:
    """``(source, tokens, share, weight, budget, passes, rest)``; one row per source.

    ``passes`` is the number of whole passes, ``rest`` the tokens beyond them.
    """
    totals = cut(digests.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shared = totals.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    used = shared.filter("share > 0")
    budget = None if budget_tokens is None else budget_tokens / max(total, 1)
    a = solve_exponent(used, budget, max_repeats, entropy)
    scale = used.agg(
        F.coalesce(F.sum(F.pow("share", F.lit(a))), F.lit(1.0)),
        F.coalesce(F.max(F.pow("share", F.lit(1 - a))), F.lit(1.0)),
    ).first()
    # The least budget that covers every source: the greatest share / weight.
    dealt = scale[0] * scale[1] if budget is None else budget
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(a)) / scale[0]).otherwise(0.0)
    passes = F.when(
        F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-9)
    ).otherwise(1)
    weighed = shared.withColumn("weight", weight)
    weighed = weighed.withColumn("budget", F.col("weight") * (dealt * total))
    weighed = weighed.withColumn("passes", passes.cast("int"))
    rest = F.greatest(F.col("budget") - F.col("passes") * F.col("tokens"), F.lit(0.0))
    return weighed.withColumn("rest", F.floor(rest + 1e-6).cast("long"))


def plan_blocks(digests: DataFrame, weighed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which blocks, and which parts of each source's next block, belong to the mixture.

    ``(source, block, epoch, position)`` and ``(source, block, part, epoch, position)``.
    The position in 0..1 is where the block stands in the source's budget, so reading by
    position interleaves the sources by weight. Windows run over the at most 256 blocks of
    a source and pass, or parts of a block.
    """
    sources = weighed.withColumnRenamed("tokens", "of_source").withColumnRenamed("source", "_s")
    blocks = digests.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
    blocks = blocks.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    epochs = F.sequence(F.lit(0), F.col("passes"))
    blocks = blocks.withColumn("epoch", F.explode(epochs))
    turn = F.xxhash64("source", "block", "epoch", F.lit(SEED))
    order = Window.partitionBy("source", "epoch").orderBy(turn, "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    ends = F.col("start") + F.col("tokens")
    fits = (F.col("epoch") < F.col("passes")) | ((ends <= F.col("rest")) & (F.col("rest") > 0))
    placed = placed.withColumn("fits", fits)
    position = (F.col("epoch") * F.col("of_source") + F.col("start")) / F.greatest(
        F.col("budget"), F.lit(1.0)
    )
    whole = placed.filter("fits").select("source", "block", "epoch", position.alias("position"))
    # The first block that doesn't fit: it starts within the rest and ends beyond it.
    split = placed.filter(~F.col("fits") & (F.col("start") < F.col("rest"))).select(
        F.col("source").alias("_s"),
        F.col("block").alias("_b"),
        "epoch",
        "start",
        "of_source",
        "budget",
        "rest",
    )
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))
    split = F.broadcast(split) if is_small(split) else split
    of_split = ["epoch", "start", "of_source", "budget", "rest"]
    parts = digests.join(split, same).groupBy("source", "block", "part", *of_split)
    parts = parts.agg(F.sum("tokens").alias("tokens"))
    turn = F.xxhash64("source", "block", "part", "epoch", F.lit(SEED))
    order = Window.partitionBy("source", "block").orderBy(turn, "part")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.col("start") + F.sum("tokens").over(upto))
    position = (F.col("epoch") * F.col("of_source") + F.col("end") - F.col("tokens")) / F.greatest(
        F.col("budget"), F.lit(1.0)
    )
    chosen = parts.filter(F.col("end") <= F.col("rest"))
    return whole, chosen.select("source", "block", "part", "epoch", position.alias("position"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget_tokens: int | None = None,
    max_repeats: float | None = MAX_REPEATS,
    entropy: float | None = ENTROPY,
) -> DataFrame:
    """The mixture: rows of ``docs`` once per pass that takes them, with ``epoch`` and ``position``.

    Only counts per block are shuffled, as long as the plan is small enough to send it to
    every task, which is measured; a plan for very many sources is joined by source and
    block, which spreads a source over its blocks.
    """
    docs = docs.drop("epoch", "position")
    digests = cut(_digests(docs, id_col, text_col, source_col))
    weighed = cut(weigh_sources(digests, budget_tokens, max_repeats, entropy))
    whole, parts = (cut(p) for p in plan_blocks(digests, weighed))
    names = {key: free_name(docs, f"_plan_{key}") for key in ("source", "block", "part")}
    block, part = _places(id_col, text_col)
    out = []
    for plan, keys in ((whole, [block]), (parts, [block, part])):
        plan = plan.withColumnsRenamed(names)
        plan = F.broadcast(plan) if is_small(plan) else plan
        on = F.col(source_col).eqNullSafe(F.col(names["source"]))
        for key, name in zip(keys, (names["block"], names["part"]), strict=False):
            on &= key == F.col(name)
        out.append(docs.join(plan, on).drop(*names.values()))
    return out[0].unionByName(out[1])

