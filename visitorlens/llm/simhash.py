"""SimHash near-duplicates found with pivot distance tables.

A fingerprint has 64 bits; a bit is set if more than half of the text's shingle hashes
have it. Fingerprints link when at most ``max_bits`` bits differ, and documents whose
fingerprints are linked, directly or through others, form a component.

Links between distinct fingerprints are found in the table of Hamming distances to fixed
reference fingerprints (pivots). For two fingerprints ``x`` and ``y`` with distance
``d(x, y) <= m`` every coordinate ``d(x, p)`` and ``d(y, p)`` differs by ``m`` at most.

* The pivots belong to ``blocks`` blocks of bits: those of a block differ from the base
  pivot in bits of that block only, so ``d(x, p) - d(x, base)`` depends on that block of
  ``x`` alone. ``m`` differing bits leave at least ``blocks - m`` blocks untouched, and
  in those *all* coordinate differences of ``x`` and ``y`` are equal. So every linking
  pair has the same coordinates in some ``blocks - m`` blocks; these are the table's
  keys, one for each choice of blocks, and only rows with an equal key meet.
* Rows that meet are discarded if any coordinate of the global pivots differs by more
  than ``m``, and the others are verified by their distance.

No pair of distinct texts' fingerprints within ``max_bits`` is lost. Within a key only a
spanning forest of the links is kept (a row with links to several rows that are already
connected adds one), so a dense group of copies gives no more rows than it has members.
A key with very many rows is cut into tiles, and each pair of tiles is a group of its own.

Defined cases: a null text has no words, like an empty one; texts without words have
fingerprint 0, which is linked like any other; repeated rows stay repeated and share a
component; a null id takes part in links but can't be the smallest id; a component
without any id has a null ``component_id``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from visitorlens.llm.common import column_types, cut, free_name, map_rows
from visitorlens.operators.scale import hot_key_join, is_small

SHINGLE_WORDS = 4
MAX_BITS = 4
# Blocks of bits. The rows that meet fall with the blocks, the keys grow: 6 blocks give
# 15 keys of 21 to 22 bits for 4 differing bits, 7 give 35 keys of 27 to 28 bits.
BLOCKS = 6
# Rows of one key that are compared in one go; a key with more is cut into tiles.
TILE_ROWS = 4096
GLOBAL_PIVOTS = 8
SEED = 42


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z in lower case."""
    if not text:
        return 0
    split = text.encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    if len(split) <= words:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: 1 - words].tolist()
        hashes = [
            xxh64_intdigest(joined[a:b], SEED)
            for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)
        ]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; counted in steps of bounded size."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long."""

    def start():
        return lambda key, text: [(key, int(np.uint64(fingerprint(text)).astype(np.int64)))]

    return map_rows(docs.select(id_col, text_col), start, column_types(docs, [id_col]) + ", fp long")


class PivotTable:
    """Pivots, and from them the keys and the global coordinates of fingerprints."""

    def __init__(self, max_bits: int = MAX_BITS, blocks: int = BLOCKS, seed: int = SEED):
        if not 0 <= max_bits < blocks <= 16:
            raise ValueError("there must be more blocks than differing bits")
        rng = np.random.default_rng(seed)
        self.max_bits = max_bits
        self.base = rng.integers(0, 2**64, dtype=np.uint64)
        self.extra = rng.integers(0, 2**64, GLOBAL_PIVOTS, dtype=np.uint64)
        edges = [64 * i // blocks for i in range(blocks + 1)]
        # A pivot that differs from the base in one bit tells that bit by its coordinate.
        self.block_pivots = [
            self.base ^ (np.uint64(1) << np.arange(a, b, dtype=np.uint64))
            for a, b in zip(edges, edges[1:], strict=False)
        ]
        self.choices = list(combinations(range(blocks), blocks - max_bits))

    def coordinates(self, fps: np.ndarray) -> np.ndarray:
        """Distances to the global pivots, the base first."""
        pivots = np.append(self.base, self.extra)
        return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """One column per choice of blocks: equal where all coordinate differences are equal.

        The differences of a block are +1 or -1 for each of its pivots; they are packed
        into bits, and the blocks of a choice put one after another.
        """
        base = np.bitwise_count(fps ^ self.base).astype(np.int16)
        packed = []
        for pivots in self.block_pivots:
            value = np.zeros(len(fps), np.int64)
            for p in pivots:
                nearer = np.bitwise_count(fps ^ p).astype(np.int16) < base
                value = (value << 1) | nearer
            packed.append((value, len(pivots)))
        columns = []
        for number, choice in enumerate(self.choices):
            key = np.zeros(len(fps), np.int64)
            for block in choice:
                value, bits = packed[block]
                key = (key << bits) | value
            columns.append((key * len(self.choices)) + number)
        return np.stack(columns, axis=1) if len(fps) else np.zeros((0, len(self.choices)), np.int64)


def linked_pairs(left: np.ndarray, right: np.ndarray, table: PivotTable) -> np.ndarray:
    """Matrix of the pairs that pass the coordinate filter and the verification."""
    a, b = table.coordinates(left), table.coordinates(right)
    near = np.ones((len(left), len(right)), bool)
    for p in range(a.shape[1]):
        near &= np.abs(a[:, p][:, None] - b[:, p][None, :]) <= table.max_bits
    i, j = np.nonzero(near)
    true = np.bitwise_count(left[i] ^ right[j]) <= table.max_bits
    near[i[~true], j[~true]] = False
    return near


def forest(left: np.ndarray, right: np.ndarray | None, table: PivotTable) -> list[tuple[int, int]]:
    """Links of a spanning forest, as positions; ``right`` goes on where ``left`` ends.

    Without ``right`` the rows of ``left`` are compared with each other.
    """
    split = 0 if right is None else len(left)
    right = left if right is None else right
    part = np.arange(split + len(right))
    edges = []
    for at in range(0, len(left), 512):  # one strip of the matrix at a time
        near = linked_pairs(left[at : at + 512], right, table)
        for row in np.nonzero(near.any(axis=1))[0].tolist():
            others = np.nonzero(near[row])[0] + split
            parts, first = np.unique(part[others], return_index=True)
            for other, where in zip(parts.tolist(), first.tolist(), strict=True):
                if other != part[at + row]:
                    edges.append((at + row, int(others[where])))
                    part[part == other] = part[at + row]
    return edges


def group_links(
    keys: np.ndarray, fps: np.ndarray, sides: np.ndarray, table: PivotTable
) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal ``keys``; all rows of a key stand together.

    Short runs are compared all at once, by shifting the column against itself.
    """
    if not len(fps):
        return fps, fps
    begins = np.nonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))[0]
    sizes = np.diff(np.append(begins, len(fps)))
    short = np.repeat((sizes <= 8) & (sizes > 1), sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    coordinates = table.coordinates(fps)
    found = []
    for shift in range(1, 8):
        i = np.nonzero(short[:-shift] & (run[:-shift] == run[shift:]))[0]
        j = i + shift
        # Tiles are compared with each other only: sides 1 and 2, or both 0.
        meet = (sides[i] == 0) | (sides[i] != sides[j])
        i, j = i[meet], j[meet]
        gap = np.abs(coordinates[i] - coordinates[j]).max(axis=1, initial=0)
        i, j = i[gap <= table.max_bits], j[gap <= table.max_bits]
        true = np.bitwise_count(fps[i] ^ fps[j]) <= table.max_bits
        found.append((i[true], j[true]))
    for r in np.nonzero(sizes > 8)[0].tolist():
        own = np.arange(begins[r], begins[r] + sizes[r])
        if (sides[own] == 0).all():
            edges = forest(fps[own], None, table)
        else:
            own = np.concatenate([own[sides[own] == 1], own[sides[own] == 2]])
            split = int((sides[own] == 1).sum())
            edges = forest(fps[own[:split]], fps[own[split:]], table)
        if edges:
            pairs = own[np.array(edges)]
            found.append((pairs[:, 0], pairs[:, 1]))
    i, j = (np.concatenate([f[x] for f in found]) for x in (0, 1))
    return fps[i], fps[j]


def find_links(
    fps: DataFrame,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``(a, b)`` with ``a < b``: links between distinct fingerprints that connect all links.

    ``fps`` has distinct values ``fp``. Every group of rows that meet is reduced to the
    links of a spanning forest in the task that compares it.
    """
    table = PivotTable(max_bits, blocks)

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = table.keys(values.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(values, keys.shape[1]))], ["key", "fp"]
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros((0, 3), np.int64)
        fps, sides = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def links(count: int) -> pa.RecordBatch:
            a, b = (x.view(np.int64) for x in group_links(keys[:count], fps[:count], sides[:count], table))
            columns = [np.minimum(a, b), np.maximum(a, b)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            keys = np.concatenate([keys, np.stack(new[:3], axis=1)])
            sides = np.concatenate([sides, new[3]])
            fps = np.concatenate([fps, new[4].view(np.uint64)])
            # The last group may go on in the next batch.
            open_from = int(np.nonzero((keys != keys[-1]).any(axis=1))[0].max(initial=-1)) + 1
            if open_from:
                yield links(open_from)
                keys, sides, fps = keys[open_from:], sides[open_from:], fps[open_from:]
        if len(fps):
            yield links(len(fps))

    keyed = fps.select("fp").mapInArrow(with_keys, "key long, fp long")
    # Keys with more rows than a tile are few: their number is bounded by rows / tile_rows.
    crowded = cut(keyed.groupBy("key").count().filter(F.col("count") > tile_rows))
    crowded = crowded.select("key", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles"))
    if is_small(crowded):
        crowded = F.broadcast(crowded)
    tiled = keyed.join(crowded, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    placed = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select(
        "key",
        F.least("tile", "other").cast("long").alias("i"),
        F.greatest("tile", "other").cast("long").alias("j"),
        F.when(F.col("tile") == F.col("other"), 0)
        .when(F.col("tile") < F.col("other"), 1)
        .otherwise(2)
        .cast("long")
        .alias("side"),
        "fp",
    )
    grouped = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return grouped.mapInArrow(compare, "a long, b long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the component's least.

    Large-star and small-star steps by turns: every node is hung on its least neighbour
    until nothing changes, which takes a number of rounds that grows with the logarithm
    of the longest chain. A node with very many links is only ever joined to one minimum.
    """
    edges = cut(links.select("a", "b").filter("a <> b"))
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.filter("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
        small = small.union(down.select(F.col("m").alias("a"), "b")).filter("a <> b")
        edges = cut(small.distinct())
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = edges.agg(F.count(F.lit(1)), digest).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def with_components(fingerprinted: DataFrame, id_col: str = "doc_id", **settings: int) -> DataFrame:
    """``(fp, n_rows, component_id, root)`` for every distinct fingerprint of ``(id, fp)``."""
    distinct = cut(
        fingerprinted.groupBy("fp").agg(
            F.min(id_col).alias("least_id"), F.count(F.lit(1)).alias("n_rows")
        )
    )
    roots = connected(find_links(distinct, **settings)).withColumnRenamed("node", "fp")
    roots = roots.union(roots.select(F.col("root").alias("fp"), "root").distinct())
    linked = roots.join(distinct, "fp")
    ids = linked.groupBy("root").agg(
        F.min("least_id").alias("of_root"), F.lit(True).alias("is_linked"), F.count(F.lit(1)).alias("n")
    )
    # A component of very many fingerprints is one root: it is sent to them.
    linked = hot_key_join(roots, ids, "root", "n").select("fp", "root", "of_root", "is_linked")
    return distinct.join(linked, "fp", "left").select(
        "fp",
        "n_rows",
        F.when(F.col("is_linked"), F.col("of_root")).otherwise(F.col("least_id")).alias("component_id"),
        F.coalesce("root", "fp").alias("root"),
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row; the fingerprint in hexadecimal."""
    fingerprinted = cut(with_fingerprints(docs, id_col, text_col))
    components = cut(with_components(fingerprinted, id_col, **settings))
    # A fingerprint of very many rows is sent to them, the others are joined.
    return hot_key_join(fingerprinted, components, "fp", "n_rows").select(
        id_col,
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int
) -> DataFrame:
    """One row of each component, with all columns: the one with the least id.

    Rows are told apart by a 128-bit hash of id and text, so that repeated ids do no
    harm; of rows that are equal in both, one stays. The texts are shuffled once. Columns
    of any name pass through.
    """
    hashes = [F.xxhash64(id_col, text_col), F.xxhash64(text_col, F.lit(1), id_col)]
    marks = [free_name(docs, f"_row_hash_{i}") for i in (1, 2)]
    named = [h.alias(m) for h, m in zip(hashes, marks, strict=True)]

    def start():
        return lambda key, a, b, text: [(key, a, b, int(np.uint64(fingerprint(text)).astype(np.int64)))]

    schema = f"{column_types(docs, [id_col])}, {marks[0]} long, {marks[1]} long, fp long"
    rows = cut(map_rows(docs.select(id_col, *named, text_col), start, schema))
    components = with_components(rows, id_col, **settings)
    order = F.struct(F.col(id_col).isNull().alias("no_id"), id_col, *marks)
    # One row per fingerprint first, in each task, so that no fingerprint is hot in the join.
    least = rows.groupBy("fp").agg(F.min(order).alias("least"))
    chosen = least.join(components, "fp").groupBy("root").agg(F.min("least").alias("chosen"))
    chosen = chosen.select(*[F.col(f"chosen.{m}").alias(m) for m in marks])
    marked = docs.withColumns(dict(zip(marks, hashes, strict=True)))
    return marked.join(chosen, marks, "left_semi").dropDuplicates(marks).drop(*marks)
