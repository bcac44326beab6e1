"""Exact top-k search by inner product in three phases with a uniform threshold.

Components are scaled to whole numbers, so scores are exact. The components are dealt into
slices; the list of a slice ranks rows by their partial score for a query. Queries go in
blocks of bounded size, and every block takes three phases over all rows:

1. Local score lists: every task walks its rows in chunks and takes the head of each slice's
   list in each chunk. It sends the ``k`` best full scores among those rows, without ids.
2. The ``k``-th best score gathered is a safe cutoff: ``k`` rows reach it, so no row below it
   is a result. It is broadcast; with ``m`` slices, a row whose partial scores are all below
   cutoff / m can't reach it, so rows with one partial score at the uniform threshold suffice.
3. The scores of those entries are resolved exactly in the task that has the row; entries
   below the cutoff go, and each task sends its ``k`` best of the rest (ties to smaller ids).
   As the rows are whole in a task, phases 2 and 3 are one pass.

Without a cutoff (fewer than ``k`` rows gathered) every row is an entry, with the same result.
A task holds one chunk of scores and ``k`` entries per query, whatever the number of ties.

Defined cases: vectors that are null or hold a null or non-finite component take no part,
nor do rows without an id; vectors of other lengths than the query's are not its candidates;
a query's own row is left out once, so a repeated row is a candidate, and a repeated query
row gives its results again; scores beyond a long are the nearest long; an empty table gives
no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitorlens.llm.common import blocks_of, cut
from visitorlens.operators.scale import top_per_group

SLICES = 4
# Components of queries that are sent to the tasks at once.
BLOCK_VALUES = 1 << 20
# Rows and queries that are scored at once in a task.
CHUNK_ROWS, CHUNK_QUERIES = 1024, 512
# Entries that a task holds before it keeps the best of each query only.
HELD_ENTRIES = 1 << 18
LEAST, MOST = -(2**63), 2**63 - 1

Queries = dict[int, tuple[np.ndarray, np.ndarray]]  # length -> positions, vectors


def scaled_vectors(
    vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(id, v array<double>)`` of whole numbers for every row that takes part."""

    def floored(x: Column) -> Column:
        # A double beyond 2**53 is whole, and may not fit into a long.
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    v = F.transform(vector_col, floored)
    whole = F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    kept = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole)
    return kept.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def slice_scores(rows: np.ndarray, queries: np.ndarray, slices: int) -> list[np.ndarray]:
    """Partial scores ``queries x rows`` of every slice, exact; their sum is the score.

    Whole numbers below 2**53 are exact in floating point. Larger ones are summed as
    integers, and scores that may leave a long are one slice of the nearest longs.
    """
    d = rows.shape[1]
    bound = d * np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0)
    if bound >= 2.0**62:
        whole = [[int(x) for x in r] for r in rows], [[int(x) for x in q] for q in queries]
        exact = [[sum(a * b for a, b in zip(q, r, strict=True)) for r in whole[0]] for q in whole[1]]
        return [np.array([[min(max(x, LEAST), MOST) for x in line] for line in exact], np.int64)]
    if bound >= 2.0**53:
        rows, queries = rows.astype(np.int64), queries.astype(np.int64)
    edges = [d * i // slices for i in range(slices + 1)]
    return [queries[:, a:b] @ rows[:, a:b].T for a, b in zip(edges, edges[1:], strict=False)]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of rows of one length, ``CHUNK_ROWS`` at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            lists = part.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            begins = np.cumsum(lengths) - lengths
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                yield ids[own], values[begins[own][:, None] + np.arange(d)]


def scored(batches, queries: Queries, slices: int):
    """``(positions, ids, slice scores)`` of every chunk of rows against every chunk of queries."""
    for ids, rows in chunks(batches):
        if rows.shape[1] in queries:
            positions, vectors = queries[rows.shape[1]]
            for at in range(0, len(positions), CHUNK_QUERIES):
                some = slice(at, at + CHUNK_QUERIES)
                yield positions[some], ids, slice_scores(rows, vectors[some], slices)


def unpacked(block: Broadcast) -> tuple[np.ndarray, Queries]:
    """Ids of the block's queries, and their vectors by length."""
    ids, vectors = block.value
    lengths = np.array([len(v) for v in vectors])
    queries = {}
    for d in np.unique(lengths):
        own = np.flatnonzero(lengths == d)
        queries[int(d)] = own, np.array([vectors[i] for i in own], float).reshape(len(own), d)
    return np.array(ids, np.int64), queries


def list_heads(block: Broadcast, k: int, slices: int):
    """Phase 1: the best full scores among the heads of the slices' lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = unpacked(block)
        best = np.full((len(query_ids), k), LEAST, np.int64)
        found = np.zeros(len(query_ids), np.int64)
        for positions, ids, parts in scored(batches, queries, slices):
            own = query_ids[positions][:, None] == ids[None, :]
            total = sum(parts[1:], start=parts[0])
            lines = np.arange(len(positions))
            heads, listed = [], np.zeros(total.shape, bool)
            for part in parts:
                at = np.where(own, part.min() - 1, part).argmax(axis=1)
                new = ~own[lines, at] & ~listed[lines, at]
                listed[lines[new], at[new]] = True
                heads.append(np.where(new, total[lines, at].astype(np.int64), LEAST))
                found[positions] += new
            merged = np.concatenate([best[positions], np.stack(heads, axis=1)], axis=1)
            best[positions] = np.sort(merged, axis=1)[:, ::-1][:, :k]
        sizes = np.minimum(found, k)
        at = np.repeat(np.arange(len(query_ids)), sizes)
        within = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = [pa.array(at, pa.int32()), pa.array(best[at, within])]
        yield pa.RecordBatch.from_arrays(columns, ["query", "score"])

    return run


def best_entries(query: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int):
    """The ``most`` best entries of each query: by score, ties to the smaller id."""
    order = np.lexsort((ids, ~score, query))  # ~x falls as x rises, without overflow
    query, ids, score = query[order], ids[order], score[order]
    begins = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
    sizes = np.diff(np.append(begins, len(query)))
    kept = np.arange(len(query)) - np.repeat(begins, sizes) < most
    return query[kept], ids[kept], score[kept]


def sufficient_entries(block: Broadcast, cutoffs: Broadcast, k: int, slices: int):
    """Phases 2 and 3: entries at the uniform threshold, resolved, the best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = unpacked(block)
        cutoff = cutoffs.value
        # The query's own row may be among them, so one more is kept.
        held, count = [(np.zeros(0, np.int64),) * 3], 0
        for positions, ids, parts in scored(batches, queries, slices):
            # Floor division: whole partial scores below it can't add up to the cutoff.
            least = cutoff[positions]
            threshold = (least // len(parts))[:, None]
            entry = np.repeat((least == LEAST)[:, None], len(ids), axis=1)
            for part in parts:
                entry |= part >= threshold
            line, column = np.nonzero(entry)
            score = sum(part[line, column].astype(np.int64) for part in parts)
            enough = score >= least[line]
            held.append((positions[line[enough]], ids[column[enough]], score[enough]))
            count += int(enough.sum())
            if count >= HELD_ENTRIES + (k + 1) * len(query_ids):
                held = [best_entries(*map(np.concatenate, zip(*held, strict=True)), k + 1)]
                count = len(held[0][0])
        query, ids, score = best_entries(*map(np.concatenate, zip(*held, strict=True)), k + 1)
        for at in range(0, len(query), 1 << 16):
            some = slice(at, at + (1 << 16))
            columns = [pa.array(query[some], pa.int32()), pa.array(ids[some]), pa.array(score[some])]
            yield pa.RecordBatch.from_arrays(columns, ["query", "vec_id", "score"])

    return run


def search_block(vectors: DataFrame, block: list, k: int, slices: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the queries of one block."""
    context = vectors.sparkSession.sparkContext
    ids, components = [r.id for r in block], [r.v for r in block]
    sent = context.broadcast((ids, components))
    gathered = vectors.mapInArrow(list_heads(sent, k, slices), "query int, score long")
    listed = top_per_group(gathered, ["query"], [F.desc("score")], k)
    listed = listed.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    cutoff = np.full(len(ids), LEAST, np.int64)
    for row in listed.filter(F.col("n") == k).toLocalIterator():
        cutoff[row.query] = row.score
    safe = context.broadcast(cutoff)
    entries = vectors.mapInArrow(
        sufficient_entries(sent, safe, k, slices), "query int, vec_id long, score long"
    )
    order = [F.desc("score"), F.asc("vec_id")]
    ranked = top_per_group(entries, ["query"], order, k + 1, rank_name="rank")
    own = [(i, q, squared(v)) for i, (q, v) in enumerate(zip(ids, components, strict=True))]
    session = vectors.sparkSession
    queries = F.broadcast(session.createDataFrame(own, "query int, query_id long, own_score long"))
    # The own row is one of the entries that equal it, if it is among the best.
    is_own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own_score"))
    listed = ranked.join(queries, "query").withColumn("is_own", is_own)
    done = cut(without_own(listed, k))
    sent.unpersist()
    safe.unpersist()
    return done


def squared(v: list[float]) -> int:
    return min(sum(int(x) * int(x) for x in v), MOST)


def without_own(listed: DataFrame, k: int) -> DataFrame:
    """Ranks without the first row that equals the query's own one."""
    rows = F.struct("rank", "vec_id", "score", "is_own")
    grouped = listed.groupBy("query", "query_id").agg(F.sort_array(F.collect_list(rows)).alias("rows"))
    own = F.array_position(F.transform("rows", lambda r: r["is_own"]), F.lit(True))

    def kept(rows: Column) -> Column:
        return F.filter(rows, lambda r: (own == 0) | (r["rank"] != own))

    out = grouped.select("query_id", F.posexplode(F.slice(kept(F.col("rows")), 1, k)).alias("at", "row"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "row.vec_id", "row.score")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    slices: int = SLICES,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest inner products.

    ``queries`` has the columns of ``vectors``. The driver holds one block of queries and a
    cutoff for each; the vectors are scaled once and read twice a block.
    """
    rows = cut(scaled_vectors(vectors, scale, id_col, vector_col))
    asked = scaled_vectors(queries, scale, id_col, vector_col).toLocalIterator()
    found = [
        search_block(rows, block, k, slices)
        for block in blocks_of(asked, lambda r: len(r.v) + 1, block_values)
    ]
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for part in found:
        out = out.unionByName(part)
    return out
