"""Sharding: a keyed permutation of global row numbers gives every row its shard and slot.

Every row gets a global number from 0 on: rows are dealt into buckets by a hash of their
columns, numbered within their bucket in the order of hash and columns, and each bucket
starts where the one before ends. The numbers depend on the rows alone, not on files or
tasks. A Feistel network over ``left x right >= n`` positions permutes the numbers; a
result of ``n`` or more walks on along its cycle until it falls below ``n``. Row number
``p`` after the permutation is slot ``p // shards`` of shard ``p % shards``, so counts
differ by one at most, slots have no gaps, and both can be computed from the number.

Defined cases: rows that are equal in all columns are interchangeable and each get a
place of their own; nulls count as values; an empty table gives no rows; columns that
are already named ``shard`` or ``slot`` are replaced; columns of a type that can't be
ordered (maps) don't take part in the order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from visitorlens.llm.common import cut, free_name, quoted

# Buckets for numbering. The table of their counts is what is broadcast, about 1 MB.
BUCKETS = 1 << 16
# A bucket of more rows may be full of equal ones.
CROWDED_ROWS = 10_000
ROUNDS = 6
SEED = 20_240
# Steps of a walk that are taken one by one, before the rest in one expression.
STEPS = 3


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, MapType | VariantType):
        return False
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, StructType) or all(_orderable(f.dataType) for f in kind.fields)


def number_rows(
    df: DataFrame, name: str, buckets: int = BUCKETS, crowded: int = CROWDED_ROWS
) -> tuple[DataFrame, int]:
    """``df`` with a gapless number from 0 on in column ``name``, and the number of rows.

    One aggregate of counts per bucket and one shuffle of the rows; a bucket holds about
    ``1/buckets`` of them, since all columns take part in the hash. Only equal rows can make
    a bucket much larger. Of the buckets with over ``crowded`` rows and a hundredth of a
    percent of all, equal rows are first counted, which shrinks them in each task; the
    counted ones are numbered, and get their copies back in pieces of ``crowded`` rows.
    """
    key, bucket, first, copies = (free_name(df, x) for x in ("_key", "_bucket", "_first", "_copies"))
    columns = [quoted(f.name) for f in df.schema.fields if _orderable(f.dataType)]
    keyed = df.withColumn(key, F.xxhash64(*columns, F.lit(SEED)))
    keyed = keyed.withColumn(bucket, F.pmod(quoted(key), F.lit(buckets)).cast("int"))
    counts = cut(keyed.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")))
    # At most ``buckets`` rows: this window and the broadcast are bounded.
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    starts = F.broadcast(starts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most ten thousand, by arithmetic.
    large = counts.filter(F.col("n") > max(crowded, total // 10_000)).select(bucket)
    full = [row[0] for row in large.collect()] if len(columns) == len(df.columns) else []
    within = Window.partitionBy(bucket).orderBy(key, *columns)
    spread = keyed.filter(~F.col(bucket).isin(full)) if full else keyed
    numbered = spread.withColumn(name, F.row_number().over(within).cast("long") - 1)
    numbered = numbered.join(starts, bucket).withColumn(name, F.col(name) + F.col(first))
    if full:
        same = keyed.filter(F.col(bucket).isin(full)).groupBy(bucket, key, *columns)
        counted = same.agg(F.count(F.lit(1)).alias(copies))
        ahead = within.rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn(name, F.coalesce(F.sum(copies).over(ahead), F.lit(0)))
        counted = counted.join(starts, bucket).withColumn(name, F.col(name) + F.col(first))
        last = free_name(df, "_last")
        pieces = counted.withColumn(last, F.col(name) + F.col(copies) - 1)
        begins = F.sequence(F.col(name), F.col(last), F.lit(crowded))
        pieces = pieces.withColumn(name, F.explode(begins)).repartition(key, name)
        ends = F.least(F.col(name) + crowded - 1, F.col(last))
        pieces = pieces.withColumn(name, F.explode(F.sequence(F.col(name), ends)))
        numbered = numbered.unionByName(pieces.select(*numbered.columns))
    return numbered.drop(key, bucket, first), total


def halves(n: int) -> tuple[int, int]:
    """Sizes of the two halves: ``left * right >= n``, with fewer than ``left`` to spare."""
    left = math.isqrt(max(n - 1, 0)) + 1
    return left, max(1, -(-n // left))


def _split(number: Column, right: int) -> tuple[Column, Column]:
    return F.call_function("div", number, F.lit(right)), F.pmod(number, F.lit(right))


def _mixed(changed: Column, other: Column, size: int, key: int) -> Column:
    """One half-round: ``changed`` shifted by a keyed hash of the other half."""
    return F.pmod(changed + F.pmod(F.xxhash64(F.lit(key), other), F.lit(size)), F.lit(size))


def permute(df: DataFrame, name: str, n: int, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with the numbers 0..n-1 in column ``name`` replaced by their permutation.

    Each half-round is a step of its own over two columns. Rows that fall out of range
    (fewer than the square root of ``n``) walk on. Nearly all are back after one step, so a
    few steps are taken on their own, and rows still out of range walk on inside an
    expression; a walk meets each of the positions out of range once at most, which bounds
    its length by ``left``.
    """
    left, right = halves(n)
    a, b = free_name(df, "_left"), free_name(df, "_right")
    out = df.withColumns(dict(zip((a, b), _split(F.col(name), right), strict=True)))
    for i in range(rounds):
        changed, other, size = (a, b, left) if i % 2 == 0 else (b, a, right)
        out = out.withColumn(changed, _mixed(F.col(changed), F.col(other), size, seed + i))

    def network(x: Column) -> Column:
        x, y = _split(x, right)
        for i in range(rounds):
            if i % 2 == 0:
                x = _mixed(x, y, left, seed + i)
            else:
                y = _mixed(y, x, right, seed + i)
        return x * right + y

    out = out.withColumn(name, F.col(a) * right + F.col(b)).drop(a, b)
    for _ in range(STEPS):
        x = F.col(name)
        out = out.withColumn(name, F.when(x < n, x).otherwise(network(x)))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(left)),
        F.col(name),
        lambda x, _: F.when(x < n, x).otherwise(network(x)),
    )
    return out.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(walked))


def shard_rows(
    df: DataFrame,
    shards: int = 16,
    seed: int = SEED,
    buckets: int = BUCKETS,
    crowded: int = CROWDED_ROWS,
) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long) of every row."""
    df = df.drop("shard", "slot")
    place = free_name(df, "_place")
    numbered, n = number_rows(df, place, buckets, crowded)
    placed = permute(numbered, place, n, seed)
    where = F.col(place)
    return placed.withColumns(
        {
            "shard": F.pmod(where, F.lit(shards)).cast("int"),
            "slot": F.call_function("div", where, F.lit(shards)),
        }
    ).drop(place)


def shard_report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Sizes, checksums and places of documents; only these small columns are shuffled."""
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shard_rows(sizes, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
