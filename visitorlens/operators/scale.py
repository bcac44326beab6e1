"""Join and top-k building blocks that stay balanced when one key is very hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A side is broadcast only after a bounded look has shown it to be this small.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 64_000_000
# Keys holding more than 1/HOT_KEYS of all rows count as hot; there can be at most HOT_KEYS.
HOT_KEYS = 500
# Spread of a key whose rows cannot be pre-aggregated.
SALTS = 16
# Above this k the per-group limit is taken in two steps.
SINGLE_STEP_TOP_K = 100


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether ``df`` has at most so many rows and bytes; looks at no more than one row beyond.

    Bytes are those of the rows written as JSON.
    """
    some = df.limit(max_rows + 1)
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    rows, held = some.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return rows <= max_rows and held <= max_bytes


def _slice_of(df: DataFrame, slices: int) -> Column:
    """Slice number that also separates equal rows, by the task that read them.

    Unlike a random number it is the same when a task is run again.
    """
    slice_of_row = F.pmod(F.xxhash64(*df.columns), F.lit(slices))
    return F.pmod(slice_of_row + F.spark_partition_id(), F.lit(slices)).cast("int")


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which a null key is a key like any other; keys appear once."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(renamed, same, how).drop(*[f"_right_{c}" for c in on])


def null_safe_anti_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys, null included, ``right`` does not have."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") for c in on])
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(renamed, same, "left_anti")


def salted_join(
    big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Null-safe join in which every key of ``big`` is spread over ``salts`` tasks.

    ``lookup`` is repeated once per salt, so it should be the side with few rows per key.
    """
    salted = big.withColumn("_salt", _slice_of(big, salts))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(salted, copies, [*on, "_salt"], how).drop("_salt")


def hot_key_join(
    big: DataFrame, stats: DataFrame, on: str, weight: str, hot_keys: int = HOT_KEYS
) -> DataFrame:
    """Inner join with per-key statistics that know how many rows each key has in ``big``.

    ``stats`` has one row per key and the key's row count in ``weight``. Keys with
    more than ``1/hot_keys`` of the rows number at most ``hot_keys`` by arithmetic, so
    they are broadcast; all other keys are light and take an ordinary shuffled join.

    Every use of ``stats`` reads all of its columns: with fewer of them it would be another
    plan, and what it is made of would be computed once more.
    """
    others = [c for c in stats.columns if c != on]
    read = [F.count(c).alias(f"_n{i}") for i, c in enumerate(others)]
    total = stats.agg(F.struct(F.coalesce(F.sum(weight), F.lit(0)).alias("_all"), *read)).scalar()
    limit = total.getField("_all")
    hot = stats.filter(F.col(weight) * hot_keys > limit)
    light = stats.filter(F.col(weight) * hot_keys <= limit)
    met = big.join(F.broadcast(hot.select(on, F.struct(*others).alias("_held"))), on, "left")
    of_hot = met.filter(F.col("_held").isNotNull()).select(*big.columns, "_held.*")
    of_light = met.filter(F.col("_held").isNull()).select(*big.columns).join(light, on)
    return of_hot.unionByName(of_light)


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_name: str | None = None,
    salts: int | None = None,
) -> DataFrame:
    """The first ``k`` rows of every group by a total order.

    For small ``k`` Spark prunes each map task to ``k`` rows per group before the
    shuffle. For larger ``k`` the group is first ranked in ``salts`` slices, so
    that no task ever sorts a whole hot group.
    """
    rank = rank_name or "_rank"
    if salts is None:
        salts = 1 if k <= SINGLE_STEP_TOP_K else 1024
    if salts > 1:
        sliced = df.withColumn("_slice", _slice_of(df, salts))
        window = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            sliced.withColumn(rank, F.row_number().over(window))
            .filter(F.col(rank) <= k)
            .drop("_slice", rank)
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
    return ranked if rank_name else ranked.drop(rank)
