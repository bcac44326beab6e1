"""Items against topic seeds: similarity, combined score, assignment, top lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitorlens.operators.scale import top_per_group

# Seed words of the two topics.
UX_SEEDS = [
    "user experience",
    "interface",
    "navigation",
    "workflow",
    "usability",
    "interaction",
    "parking",
    "staff",
    "security",
    "overall experience",
]
ARCHITECTURE_SEEDS = [
    "architecture",
    "space",
    "layout",
    "flow",
    "environment",
    "amenities",
    "circulation",
    "seating",
    "auditorium",
]
DEFAULT_SEEDS = {"ux": UX_SEEDS, "architecture": ARCHITECTURE_SEEDS}

# Weights of similarity and frequency, least score, list length.
SEMANTIC_WEIGHT = 0.7
FREQUENCY_WEIGHT = 0.3
THRESHOLD = 0.35
TOP_ITEMS = 10

# Seed vectors that are compared in one go.
SEEDS_PER_BLOCK = 2_000


def _similarity_udf(n_topics: int, width: int, matrices: Broadcast):
    """Vectorised kernel: a batch of vectors against the unit seed vectors of every topic."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def best(vectors: pa.Array) -> pa.Array:
        rows = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)
        if vectors.null_count:
            # A null vector is a zero vector.
            given = vectors.is_valid().to_numpy(zero_copy_only=False)
            known, rows = rows, np.zeros((len(vectors), width))
            rows[given] = known
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        # A zero vector stays zero, so that its cosine is 0.
        rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
        # A topic without seeds in this block scores below any cosine.
        scores = np.column_stack(
            [(rows @ seeds.T).max(axis=1, initial=-2.0) for seeds in matrices.value]
        )
        offsets = np.arange(len(rows) + 1, dtype="int32") * n_topics
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.reshape(-1)))

    return best


def _unit_rows(vectors: list[list[float]], width: int) -> np.ndarray:
    rows = np.array(vectors, dtype="float64").reshape(-1, width)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def seed_similarity(
    items: DataFrame,
    seeds: DataFrame,
    item_id: str = "item_id",
    vector: str = "embedding",
    block: int = SEEDS_PER_BLOCK,
) -> DataFrame:
    """``(items' columns but the vector, topic, similarity)``: best cosine to any seed of a topic.

    ``seeds`` has ``topic`` and ``embedding``; all vectors have the same length. A null or
    zero vector has similarity 0 to every topic; repeated items stay repeated; seeds
    without a topic or vector are left out. The topics are few, as each is a part of the
    result; their seeds may be many: the driver holds one block of them at a time and
    broadcasts it, and every item is compared with it inside its own task in Arrow batches
    (interpreted array lambdas take a hundred times as long on dense vectors). All blocks
    take one pass over the items, and no row per item and seed exists.
    """
    carried = [c for c in items.columns if c != vector]
    topics, best = _best_scores(seeds, vector, block)
    if not topics:
        return items.select(
            *carried, F.lit("").alias("topic"), F.lit(0.0).alias("similarity")
        ).limit(0)
    scored = items.select(*carried, best.alias("_s"))
    pairs = [
        F.struct(F.lit(t).alias("topic"), F.get("_s", F.lit(i)).alias("similarity"))
        for i, t in enumerate(topics)
    ]
    return scored.select(*carried, F.inline(F.array(*pairs)))


def _best_scores(seeds: DataFrame, vector: str, block: int) -> tuple[list[str], Column]:
    """Topics, and the array of a vector's best cosine to a seed of each of them.

    The seeds come to the driver one block after the other and leave it as a broadcast.
    """
    context = seeds.sparkSession.sparkContext
    known = seeds.select("topic", "embedding").dropna()
    topics = sorted(row.topic for row in known.select("topic").distinct().collect())
    fetched = known.toLocalIterator()
    best = None
    while part := list(islice(fetched, block)):
        width = len(part[0].embedding)
        matrices = [
            _unit_rows([r.embedding for r in part if r.topic == t], width) for t in topics
        ]
        given = F.col(vector).cast("array<double>")
        scores = _similarity_udf(len(topics), width, context.broadcast(matrices))(given)
        best = scores if best is None else F.zip_with(best, scores, lambda a, b: F.greatest(a, b))
    return topics, best


def assign_topics(
    items: DataFrame,
    seeds: DataFrame,
    topics: Sequence[str],
    vector: str = "embedding",
    freq: str = "freq",
    semantic_weight: float | Mapping[str, float] = SEMANTIC_WEIGHT,
    frequency_weight: float | Mapping[str, float] = FREQUENCY_WEIGHT,
    threshold: float = THRESHOLD,
    block: int = SEEDS_PER_BLOCK,
) -> DataFrame:
    """``seed_similarity`` and ``topic_items`` in one narrow pass.

    ``(items' columns but the vector, topic, score)`` for every row that reaches
    ``threshold``; the best topic is chosen inside the row, so nothing is shuffled.
    """
    carried = [c for c in items.columns if c != vector]
    found, best = _best_scores(seeds, vector, block)
    named = [t for t in topics if t in found]
    if not named:
        return items.select(*carried, F.lit("").alias("topic"), F.lit(0.0).alias("score")).limit(0)

    def weight(w: float | Mapping[str, float], topic: str) -> float:
        return float(w.get(topic, 0.0) if isinstance(w, Mapping) else w)

    share = F.coalesce(F.col(freq), F.lit(0.0))
    options = [
        F.struct(
            (
                weight(semantic_weight, t) * F.get("_s", F.lit(found.index(t)))
                + weight(frequency_weight, t) * share
            ).alias("score"),
            F.lit(-rank).alias("rank"),
            F.lit(t).alias("topic"),
        )
        for rank, t in enumerate(named)
    ]
    chosen = items.select(*carried, best.alias("_s"))
    # The threshold is tested inside the row: a filter would be pushed down to the scan, and
    # the similarities with it, to be computed twice.
    reached = F.filter(F.array(F.array_max(F.array(*options))), lambda b: b["score"] >= threshold)
    return chosen.select(*carried, F.inline(reached)).select(*carried, "topic", "score")


def topic_items(
    similarities: DataFrame,
    topics: Sequence[str],
    item_id: str = "item_id",
    freq: str = "freq",
    semantic_weight: float | Mapping[str, float] = SEMANTIC_WEIGHT,
    frequency_weight: float | Mapping[str, float] = FREQUENCY_WEIGHT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per item that reaches ``threshold``: its best topic and combined score.

    ``similarities`` carries the item's ``freq`` along (a missing one counts 0).
    Equal scores go to the topic named first. Other columns are carried along.
    """

    def weight(w: float | Mapping[str, float]) -> Column:
        if not isinstance(w, Mapping):
            return F.lit(float(w))
        value = F.lit(0.0)
        for topic, share in w.items():
            value = F.when(F.col("topic") == topic, F.lit(float(share))).otherwise(value)
        return value

    rank = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("topic"))
    score = weight(semantic_weight) * F.col("similarity") + weight(
        frequency_weight
    ) * F.coalesce(F.col(freq), F.lit(0.0))
    others = [c for c in similarities.columns if c not in (item_id, "topic", "similarity")]
    scored = similarities.withColumn("score", score).withColumn("_order", rank)
    # Both topics of an item come from the same row, so partial aggregation already
    # reduces each item to one row inside its task.
    best = scored.groupBy(item_id).agg(
        F.max_by(F.struct("topic", "score", *others), F.struct("score", -F.col("_order"))).alias(
            "_best"
        )
    )
    return best.select(item_id, "_best.*").filter(F.col("score") >= threshold)


def topic_top_items(
    assigned: DataFrame,
    k: int = TOP_ITEMS,
    ties: Sequence[Column] = (),
    item_id: str = "item_id",
) -> DataFrame:
    """The ``k`` best items of every topic with their ``rank``; ``ties`` order equal scores."""
    order = [F.desc("score"), *ties, F.desc(item_id)]
    return top_per_group(assigned, ["topic"], order, k, "rank")


def embed_hashed(
    items: DataFrame, text: str, dimensions: int = 512, out: str = "embedding"
) -> DataFrame:
    """Adds a unit vector of character trigrams, each counted at a place found by arithmetic.

    A stand-in for a sentence model when no embedding table is at hand: it sees
    spelling, not meaning. The place of a trigram is a number made of its three character
    codes, modulo ``dimensions``. Null text is an empty one.
    """
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))
    return items.withColumn(out, _trigram_udf(dimensions)(padded))


def _trigram_udf(dimensions: int):
    """Vectorised kernel: padded texts to unit vectors of their trigrams' counts."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def unit(texts: pa.Array) -> pa.Array:
        parts = texts.to_pylist()
        sizes = np.array([len(t) for t in parts], dtype="int64")
        # Two more characters of code 0, for a text of only two.
        codes = np.array([*map(ord, "".join(parts)), 0, 0], dtype="int64")
        places = (codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) % dimensions
        ends = np.cumsum(sizes)
        short = ends[sizes == 2] - 2
        places[short] = (codes[short] * 961 + codes[short + 1] * 31) % dimensions
        # All characters begin a trigram but a text's last two; a text of two has one.
        begins = np.ones(len(places), dtype=bool)
        begins[ends - 1] = False
        begins[ends[sizes > 2] - 2] = False
        row = np.repeat(np.arange(len(parts)), sizes)[begins]
        rows = np.bincount(row * dimensions + places[begins], minlength=len(parts) * dimensions)
        rows = rows.astype("float64").reshape(len(parts), dimensions)
        rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        offsets = np.arange(len(parts) + 1, dtype="int32") * dimensions
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))

    return unit


def seed_table(spark, seeds: Mapping[str, Sequence[str]] = DEFAULT_SEEDS) -> DataFrame:
    """``(topic, seed)`` rows of seed word lists."""
    rows = [(topic, seed) for topic, words in seeds.items() for seed in words]
    return spark.createDataFrame(rows, "topic string, seed string")


def phrase_topics(
    phrases: DataFrame,
    embed,
    seeds: Mapping[str, Sequence[str]] = DEFAULT_SEEDS,
    semantic_weight: float = SEMANTIC_WEIGHT,
    frequency_weight: float = FREQUENCY_WEIGHT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Scored phrases ``(phrase, n, rake, freq)`` to topics.

    ``embed(df, text_column)`` adds ``embedding``: ``embed_hashed``, or a function
    that joins stored vectors or calls the user's own pandas UDF.
    """
    seed_vectors = embed(seed_table(phrases.sparkSession, seeds), "seed")
    return assign_topics(
        embed(phrases, "phrase"),
        seed_vectors,
        list(seeds),
        semantic_weight=semantic_weight,
        frequency_weight=frequency_weight,
        threshold=threshold,
    )
