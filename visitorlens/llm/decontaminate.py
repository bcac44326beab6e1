"""Benchmark decontamination by the q-gram lemma in diagonal bands, and banded alignment.

Texts are compared as code points with A-Z in lower case and every run of white space as
one space. A benchmark item is contained in a document where a *window* of the item
(``window`` characters, or the whole item if it is shorter) aligns with a region of the
document with at most ``edits = floor(max_error * window)`` insertions, deletions and
substitutions. Windows start at every multiple of ``step`` characters, by default at every
character, and at the item's last window.

* Lemma: a window of ``w`` characters that aligns within ``e`` edits shares at least
  ``w - q + 1 - q * e`` q-grams with the region, on diagonals (document position less item
  position) that lie within ``e`` of each other.
* Every q-gram of a document is looked up in the item's q-grams. Hits are counted in
  bands of ``2 * band`` neighbouring diagonals that overlap by half, so any ``band = e + 1``
  diagonals lie in one band. A window with fewer hits in a band than the lemma's bound is
  discarded.
* The rest is verified: a window that is equal to the region has no edits, any other is
  aligned within the band, for the least number of edits against any region on it.

No window within the edit budget is lost, and none beyond it is reported.

Defined cases: null or empty texts match nothing; items shorter than ``min_chars`` are too
short to tell and match nothing; repeated rows are reported each; null ids are carried as
they are; of several places of an item in a document the one with the fewest edits, then
the first, is given (without edits its exact start, otherwise that of its band); an empty table gives no rows; columns other than the named ones are
not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from visitorlens.llm.common import SLICE_ROWS, ascii_lower, blocks_of, column_types, map_slices

# Characters of benchmark text in one broadcast index; more are searched in several passes.
BLOCK_CHARS = 2_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 22
# Hits that are counted at once.
PIECE = 1_000_000
# Characters of documents that are searched together.
BATCH_CHARS = 500_000
# Windows that are aligned together.
ALIGNED = 5_000


@dataclass(frozen=True)
class Match:
    """What counts as contained."""

    q: int = 10
    window: int = 80
    step: int = 1
    max_error: float = 0.075
    min_chars: int = 40

    def __post_init__(self):
        if any(self.needed(n) < 1 for n in range(self.min_chars, self.window + 1)):
            raise ValueError("the error is too large for this window and q")

    def edits(self, size: int) -> int:
        return int(self.max_error * size + 1e-9)

    def needed(self, size: int) -> int:
        """Fewest common q-grams of a window within its edit budget."""
        return size - self.q + 1 - self.q * self.edits(size)

    def windows(self, size: int) -> list[tuple[int, int]]:
        """``(start, length)`` of the windows of an item."""
        if size < self.min_chars:
            return []
        if size <= self.window:
            return [(0, size)]
        last = size - self.window
        return [(s, self.window) for s in sorted({*range(0, last + 1, self.step), last})]


MATCH = Match()


def normalised(text: str | None) -> str:
    return " ".join(ascii_lower(text or "").split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (a >> np.uint64(29))) * MULTIPLIER
    out += b
    return out


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at every position, built from powers of two."""
    n = len(points) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    power, size = points.astype(np.uint64) * MULTIPLIER, 1
    out, done = None, 0
    while True:
        if q & size:
            part = power[done : done + n]
            out = part if out is None else _mix(out, part)
            done += size
        if done == q:
            return out * MULTIPLIER
        power, size = _mix(power[:-size], power[size:]), 2 * size


class ItemIndex:
    """Q-grams of benchmark items with the places where they stand."""

    def __init__(self, items: list[tuple[int | None, str]], match: Match = MATCH):
        self.match = match
        self.ids, self.points = [], []
        self.grams, self.band = [], match.edits(match.window) + 1
        owners, places = [], []
        for key, text in items:
            points = code_points(text)
            if len(points) < match.min_chars:
                continue
            grams = gram_hashes(points, match.q)
            self.grams.append(grams)
            owners.append(np.full(len(grams), len(self.ids), np.int64))
            places.append(np.arange(len(grams)))
            self.ids.append(key)
            self.points.append(points)
        self.lead = max(map(len, self.points), default=0)
        # The least bound of an item's windows.
        self.least = np.array(
            [min(match.needed(n) for _, n in match.windows(len(p))) for p in self.points], np.int64
        )
        joined = np.concatenate(self.grams) if self.ids else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.hashes = joined[order]
        self.owners = np.concatenate(owners)[order] if self.ids else order
        self.places = np.concatenate(places)[order] if self.ids else order
        # One bit per slot tells most q-grams that no item has without a search.
        self.present = np.zeros(1 << TABLE_BITS, bool)
        self.present[self.hashes >> np.uint64(64 - TABLE_BITS)] = True

    def cells(self, at: np.ndarray, grams: np.ndarray, band: int) -> tuple[np.ndarray, ...]:
        """``(item, cell, hits)``: common q-grams counted in cells of ``band`` diagonals.

        ``at`` are the q-grams' positions. Hits are expanded in pieces, so a q-gram that is
        everywhere needs no more memory.
        """
        begin = np.searchsorted(self.hashes, grams, "left")
        count = np.searchsorted(self.hashes, grams, "right") - begin
        at, begin, count = at[count > 0], begin[count > 0], count[count > 0]
        if not len(at):
            return at, at, at
        # Diagonals start at minus the longest item.
        width = (int(at[-1]) + self.lead) // band + 2
        keys, counts, ends, done = [], [], np.cumsum(count), 0
        while done < len(at):
            so_far = ends[done - 1] if done else 0
            until = max(done + 1, int(np.searchsorted(ends, so_far + PIECE, "right")))
            n = count[done:until]
            which = np.arange(n.sum()) + np.repeat(begin[done:until] - np.cumsum(n) + n, n)
            diagonal = np.repeat(at[done:until], n) - self.places[which] + self.lead
            key = self.owners[which] * width + diagonal // band
            found, times = np.unique(key, return_counts=True)
            keys.append(found)
            counts.append(times)
            done = until
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts)).astype(np.int64)
        return key // width, key % width, total

    def candidates(self, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """``(item, first diagonal)`` of the bands that reach the bound of some window.

        A band is a cell and the next one, and bands overlap by a cell.
        """
        band = self.band
        item, cell, hits = self.cells(at, grams, band)
        if not len(item):
            return np.zeros((0, 2), np.int64)
        # Cells are in order of item and cell; the next one is the next row, if any.
        follows = np.append((item[1:] == item[:-1]) & (cell[1:] == cell[:-1] + 1), False)
        after = np.where(follows, np.append(hits[1:], 0), 0)
        preceded = np.append(False, follows[:-1])
        bound = self.least[item]
        own = hits + after >= bound
        # A band that starts at the empty cell before.
        before = (hits >= bound) & ~preceded
        items = np.concatenate([item[own], item[before]])
        first = np.concatenate([cell[own], cell[before] - 1]) * band - self.lead
        return np.stack([items, first], axis=1)

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text ``(item id, windows, edits, start in the text, start in the item)``.

        Texts are searched together, up to ``BATCH_CHARS`` characters at once; a longer
        text is cut into pieces that overlap by more than the longest item.
        """
        found: list[dict[int, tuple]] = [{} for _ in texts]
        batch, held = [], 0
        for row, text in enumerate(texts):
            points = code_points(normalised(text))
            overlap = 2 * (self.lead + 2 * self.band)
            step = BATCH_CHARS + overlap
            for begin in range(0, max(1, len(points) - overlap), step):
                piece = points[begin : begin + step + overlap]
                batch.append((row, begin, piece))
                held += len(piece)
                if held >= BATCH_CHARS:
                    self._search_batch(batch, found)
                    batch, held = [], 0
        self._search_batch(batch, found)
        return [
            [(self.ids[i], len(starts), *best) for i, (best, starts) in sorted(own.items())]
            for own in found
        ]

    def _search_batch(self, batch: list[tuple], found: list[dict[int, tuple]]) -> None:
        match, stop = self.match, np.array([0xFFFFFFFF], np.uint32)
        if not batch or not self.ids:
            return
        joined = np.concatenate([x for _, _, piece in batch for x in (piece, stop)])
        grams = gram_hashes(joined, match.q)
        sizes = np.array([len(piece) + 1 for _, _, piece in batch])
        starts = np.cumsum(sizes) - sizes
        at = np.nonzero(self.present[grams >> np.uint64(64 - TABLE_BITS)])[0]
        # Positions are moved apart, so that no diagonal belongs to two texts.
        apart = self.lead + 4 * self.band
        text_of = np.searchsorted(starts, at, "right") - 1
        moved = starts + np.arange(len(starts)) * apart
        pairs = self.candidates(at + text_of * apart, grams[at])
        owner = np.searchsorted(moved - self.lead - 2 * self.band, pairs[:, 1], "right") - 1
        aligned: dict[int, list[tuple]] = {}
        for (item, diagonal), k in zip(pairs.tolist(), owner.tolist(), strict=True):
            piece = batch[k][2]
            own = grams[starts[k] : starts[k] + max(0, len(piece) - match.q + 1)]
            place = diagonal - int(moved[k])
            size, exact, rest = self.compare(piece, own, item, place)
            for start, on in exact:
                note(batch[k], found, item, on, start, 0)
            aligned.setdefault(size, []).extend((k, item, place, start) for start in rest)
        width = 2 * self.band
        for size, jobs in aligned.items():
            for some in range(0, len(jobs), ALIGNED):
                part = jobs[some : some + ALIGNED]
                windows = np.stack([self.points[i][s : s + size] for _, i, _, s in part])
                regions = [cut_out(batch[k][2], s + d, size + width) for k, _, d, s in part]
                edits = banded_edits(windows, np.stack(regions), width).tolist()
                for (k, item, place, start), n in zip(part, edits, strict=True):
                    if n <= match.edits(size):
                        note(batch[k], found, item, place, start, n)

    def compare(
        self, points: np.ndarray, grams: np.ndarray, item: int, diagonal: int
    ) -> tuple[int, list[tuple[int, int]], list[int]]:
        """``(window size, (start, diagonal) of equal windows, starts of windows to align)``.

        The hits of the band are counted window by window; a window below the bound is in
        neither list.
        """
        match, own = self.match, self.points[item]
        width = 2 * self.band
        own_grams = self.grams[item]
        windows = match.windows(len(own))
        first = np.array([s for s, _ in windows])
        size = windows[0][1]
        last = first + size - match.q + 1
        shared = np.zeros(len(windows), np.int64)
        exact: dict[int, int] = {}
        for d in range(diagonal, diagonal + width):
            low, high = max(0, -d), min(len(own_grams), len(grams) - d)
            if low < high:
                same = own_grams[low:high] == grams[low + d : high + d]
                if same.any():
                    sums = np.zeros(len(own_grams) + 1, np.int64)
                    sums[low + 1 : high + 1] = np.cumsum(same)
                    sums[high + 1 :] = sums[high]
                    here = sums[last] - sums[first]
                    shared += here
                    # All q-grams in a row are equal: compared once more, without hashes.
                    for k in np.nonzero(here == size - match.q + 1)[0].tolist():
                        a = first[k]
                        if (own[a : a + size] == points[a + d : a + d + size]).all():
                            exact.setdefault(int(a), d)
        rest = [s for s in first[shared >= match.needed(size)].tolist() if s not in exact]
        return size, list(exact.items()), rest


def note(
    piece: tuple, found: list[dict[int, tuple]], item: int, diagonal: int, start: int, edits: int
) -> None:
    """Keep the best place of an item in a text, and the windows that were found."""
    row, begin, _ = piece
    place = (edits, begin + max(0, start + diagonal), start)
    best, windows = found[row].get(item, (place, set()))
    found[row][item] = (min(best, place), windows | {start})


def cut_out(points: np.ndarray, begin: int, size: int) -> np.ndarray:
    """``points[begin : begin + size]``; outside the text stands what no item has."""
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    low, high = max(0, begin), min(len(points), begin + size)
    if low < high:
        out[low - begin : high - begin] = points[low:high]
    return out


def banded_edits(windows: np.ndarray, regions: np.ndarray, width: int) -> np.ndarray:
    """Least edits of each window against any part of its region, on ``width`` diagonals.

    Row ``i`` of the alignment compares character ``i`` of a window with the characters
    ``i .. i + width - 1`` of its region.
    """
    across = np.arange(width)
    row = np.zeros((len(windows), width), np.int64)
    for i in range(windows.shape[1]):
        new = row + (regions[:, i : i + width] != windows[:, i][:, None])
        # A character of the item that the text lacks: from the next diagonal.
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        # Characters that only the text has: along the row, one edit a diagonal.
        row = np.minimum.accumulate(new - across, axis=1) + across
    return row.min(axis=1)


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, match: Match, block_chars: int):
    """Broadcast indexes over blocks of the benchmark; the driver holds one at a time."""
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select(id_col, text_col).toLocalIterator()
    items = ((r[0], normalised(r[1])) for r in rows)
    for block in blocks_of(items, lambda r: len(r[1]), block_chars):
        yield context.broadcast(ItemIndex(block, match))


def find_contained(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    match: Match = MATCH,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(id, item, windows, edits, text_start, item_start)`` per row and item contained in it.

    Every block of the benchmark is one pass over the documents, whose rows are united.
    """
    schema = (
        f"{column_types(docs, [id_col])}, {column_types(benchmark, [item_id_col])},"
        " windows long, edits long, text_start long, item_start long"
    )
    found = None
    for index in _indexes(benchmark, item_id_col, item_text_col, match, block_chars):

        def start(index=index) -> Callable:
            def search(keys, texts):
                found = zip(keys, index.value.search(texts), strict=True)
                return [(key, *m) for key, matches in found for m in matches]

            return search

        part = map_slices(docs.select(id_col, text_col), start, schema)
        found = part if found is None else found.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_contained(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    match: Match = MATCH,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all columns; no shuffle."""
    for index in _indexes(benchmark, item_id_col, item_text_col, match, block_chars):

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    found = index.value.search(texts.slice(at, SLICE_ROWS).to_pylist())
                    clean = pa.array([not m for m in found], pa.bool_())
                    yield batch.slice(at, SLICE_ROWS).filter(clean)

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
