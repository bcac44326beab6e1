"""Conversation prefix trie: counts per shared prefix of turns, by adaptive radix trees.

A turn (role and text) gets an id of fixed width: the first 16 bytes of a SHA-256, read as
a big-endian number. A conversation's key is the ids of its turns, one after another, so
equal prefixes of turns are equal prefixes of bytes and keys sort like sequences of ids.

* Distinct keys are dealt by ranges to tasks, so a first turn that very many conversations
  share is split like any other. Equal conversations are one key before that.
* A task puts its sorted keys, a bounded number at a time, into an adaptive radix tree:
  nodes for up to 4, 16, 48 and 256 next bytes that grow as needed, and compressed paths.
  Nodes are emitted at byte depths that are whole turns only, also inside compressed paths.
* A node is final if all its members are in one tree. Others are prefixes of a tree's first
  or last key, hence few; their parts are added up. Where two trees meet, nodes on both
  sides are counted twice; the difference is another part, a number per shared turn.
* Ids of equal conversations are joined in sorted pieces of bounded size and hashed in one
  pass over the pieces, so no list of them is ever held.

Defined cases: a null role or text is an empty one; turns are ordered by number (nulls
first), equal numbers by id; rows without a conversation id take no part; repeated rows are
repeated turns; conversations without turns belong to the root only; an empty table gives
no rows; other columns are not looked at, whatever their names. One conversation's ids (not
its texts) have to fit into a row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitorlens.llm.common import cut
from visitorlens.operators.scale import hot_key_join

ID_BYTES = 16
# Keys, and bytes of keys, that one tree holds.
TREE_KEYS = 8192
TREE_BYTES = 8 << 20
# Ids in one piece of a list of equal conversations.
PIECE_IDS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = (
    "kind string, conv long, depth int, digest binary, parent long, parent_digest binary, "
    "n_convs long, n_children long, n_leaves long, saved long, ends string, "
    "first binary, last binary, first_sizes array<int>, last_sizes array<int>"
)


# --- The tree --------------------------------------------------------------------------


class SmallLayout:
    """Up to 4, then up to 16 next bytes, sorted."""

    def __init__(self):
        self.limit, self.bytes, self.nodes = 4, [], []

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node: Node):
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.bytes) == self.limit:
            if self.limit == 16:
                return grown(self, IndexedLayout()).put(byte, node)
            self.limit = 16
        self.nodes.insert(at, node)
        insort(self.bytes, byte)
        return self

    def in_order(self):
        return zip(self.bytes, self.nodes, strict=True)


class IndexedLayout:
    """Up to 48 next bytes: a table of 256 places into a short list of nodes."""

    def __init__(self):
        self.places, self.nodes = bytearray(256), []

    def get(self, byte: int):
        place = self.places[byte]
        return self.nodes[place - 1] if place else None

    def put(self, byte: int, node: Node):
        place = self.places[byte]
        if place:
            self.nodes[place - 1] = node
        elif len(self.nodes) == 48:
            return grown(self, FullLayout()).put(byte, node)
        else:
            self.nodes.append(node)
            self.places[byte] = len(self.nodes)
        return self

    def in_order(self):
        return ((b, self.nodes[p - 1]) for b, p in enumerate(self.places) if p)


class FullLayout:
    """A node for each of the 256 bytes."""

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node: Node):
        self.nodes[byte] = node
        return self

    def in_order(self):
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


def grown(old, new):
    for byte, node in old.in_order():
        new.put(byte, node)
    return new


class Node:
    """A compressed path, the value of the key that ends with it, and what comes next."""

    __slots__ = ("ends", "least", "n_convs", "next", "path", "sizes", "stats", "value")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.next = path, value, SmallLayout()


class RadixTree:
    """Adaptive radix tree over byte strings; a key may be a prefix of another."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.next.get(key[at])
            if child is None:
                node.next = node.next.put(key[at], Node(key[at:], value))
                return
            path = child.path
            if not key.startswith(path, at):
                split = shared_length(path, key, at)
                above = Node(path[:split])
                above.next = above.next.put(path[split], child)
                child.path = path[split:]
                node.next = node.next.put(key[at], above)
                child = above
            node, at = child, at + len(child.path)
        node.value = value

    def path_to(self, key: bytes) -> set[int]:
        """Identities of the nodes from the root to a key that is in the tree."""
        node, at, met = self.root, 0, {id(self.root)}
        while at < len(key):
            node = node.next.get(key[at])
            met.add(id(node))
            at += len(node.path)
        return met


def shared_length(path: bytes, key: bytes, at: int) -> int:
    """How many bytes ``path`` and ``key`` from ``at`` on have in common; by halving."""
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if path[:middle] == key[at : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


# --- Nodes of the trie from one tree ------------------------------------------------------


def digests(key: bytes) -> list[bytes]:
    """Digest of every prefix of whole turns, the empty one first."""
    running = hashlib.sha256()
    out = [running.digest()[:ID_BYTES]]
    for at in range(0, len(key), ID_BYTES):
        running.update(key[at : at + ID_BYTES])
        out.append(running.digest()[:ID_BYTES])
    return out


def tree_nodes(tree: RadixTree, first: bytes, last: bytes) -> Iterator[tuple]:
    """Rows of ``NODES`` for every whole-turn depth of the tree; parts where a border is near.

    A key's value is ``(n_convs, least id, sizes of its texts, hash of its ids)``.
    """
    order, stack = [], [(tree.root, 0)]
    while stack:
        node, end = stack.pop()
        order.append((node, end))
        for _, child in node.next.in_order():
            stack.append((child, end + len(child.path)))
    # Children come after their parent in this order: upwards by going backwards.
    for node, end in reversed(order):
        if node.value is None:
            node.n_convs, node.least, node.sizes, node.ends = 0, None, (), None
        else:
            node.n_convs, node.least, node.sizes, node.ends = node.value
        tops = leaves = saved = 0
        for _, child in node.next.in_order():
            node.n_convs += child.n_convs
            node.least = child.least if node.least is None else min(node.least, child.least)
            if len(child.sizes) > len(node.sizes):
                node.sizes = child.sizes
            t, n, s = child.stats[-1]
            tops, leaves, saved = tops + t, leaves + n, saved + s
        # ``stats`` from the deepest place upwards: children, leaves and saved below it.
        node.stats = [(tops, leaves, saved)]
        begin = end - len(node.path)
        for place in range(end - end % ID_BYTES, max(begin, 0), -ID_BYTES):
            leaves = leaves if tops else 1
            saved += (node.n_convs - 1) * node.sizes[place // ID_BYTES - 1]
            tops = 1
            node.stats.append((tops, leaves, saved))
    near_first, near_last = tree.path_to(first), tree.path_to(last)
    marks_first, marks_last = digests(first), digests(last)
    stack = [(tree.root, 0, None, None)]
    while stack:
        node, end, parent, parent_mark = stack.pop()
        marks = marks_first if id(node) in near_first else marks_last if id(node) in near_last else None
        begin = end - len(node.path)
        places = range(end - end % ID_BYTES, max(begin, 0), -ID_BYTES)
        steps = list(zip(places, node.stats, node.stats[1:], strict=False))
        if node is tree.root:
            tops, leaves, saved = node.stats[0]
            steps = [(0, node.stats[0], (1, leaves if tops else 1, saved))]
        for place, below, own in reversed(steps):
            depth = place // ID_BYTES
            mark = marks[depth] if marks else None
            ends = node.ends if place == end else None
            yield (
                "part" if mark else "node", node.least, depth, mark, parent, parent_mark,
                node.n_convs, below[0], own[1], own[2], ends, None, None, None, None,
            )
            parent, parent_mark = (None, mark) if mark else (node.least, None)
        for _, child in node.next.in_order():
            stack.append((child, end + len(child.path), parent, parent_mark))


def border_parts(last: bytes, first: bytes, sizes: list[int]) -> Iterator[tuple]:
    """What two neighbouring trees count twice: nodes that the keys on both sides share."""
    shared = shared_length(last, first, 0) // ID_BYTES
    marks = digests(last[: shared * ID_BYTES])
    twice = 0
    leaf = -1 if len(last) == shared * ID_BYTES else 0
    for depth in range(shared, -1, -1):
        twice += sizes[depth - 1] if depth else 0
        children = -1 if depth < shared else 0
        yield (
            "part", None, depth, marks[depth], None, marks[depth - 1] if depth else None,
            0, children, leaf, twice, None, None, None, None, None,
        )


def with_trees(tree_keys: int, tree_bytes: int):
    """Task function from sorted ``(key, sizes, n_convs, least, ends)`` to rows of ``NODES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_type = pa.schema(
            [
                ("kind", pa.string()), ("conv", pa.int64()), ("depth", pa.int32()),
                ("digest", pa.binary()), ("parent", pa.int64()), ("parent_digest", pa.binary()),
                ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                ("saved", pa.int64()), ("ends", pa.string()), ("first", pa.binary()),
                ("last", pa.binary()), ("first_sizes", pa.list_(pa.int32())),
                ("last_sizes", pa.list_(pa.int32())),
            ]
        )

        def packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            while block := list(islice(rows, 4096)):
                named = [dict(zip(out_type.names, row, strict=True)) for row in block]
                yield pa.RecordBatch.from_pylist(named, out_type)

        def rows() -> Iterator[tuple]:
            begin = previous = None
            tree, held, size, first, last = RadixTree(), 0, 0, b"", b""
            sizes: list[int] = []
            for batch in batches:
                for key, lengths, n, least, ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if held and (held >= tree_keys or size >= tree_bytes):
                        yield from tree_nodes(tree, first, last)
                        yield from border_parts(last, key, sizes)
                        tree, held, size = RadixTree(), 0, 0
                    if begin is None:
                        begin = (key, lengths)
                    if not held:
                        first = key
                    tree.insert(key, (n, least, lengths, ends))
                    last, sizes = key, lengths
                    held, size = held + 1, size + len(key)
                    previous = key
            if previous is not None:
                yield from tree_nodes(tree, first, last)
                yield ("border", *[None] * 10, begin[0], last, begin[1], sizes)

        yield from packed(rows())

    return run


def across_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["depth", "digest", "parent_digest", "n_children", "n_leaves", "saved"]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    for batch in batches:
        rows = []
        for last, first, sizes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for part in border_parts(last, first, sizes):
                rows.append(dict(zip(names, (part[2], part[3], part[5], *part[7:10]), strict=True)))
        yield pa.RecordBatch.from_pylist(rows, schema)


# --- Conversations as keys ----------------------------------------------------------------


def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal id of a turn; the role's length keeps role and text apart."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.left(F.sha2(said, 256), F.lit(2 * ID_BYTES))


def conversation_turns(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(conv, turns array<struct<turn, id, size>>)``: ids and lengths instead of texts."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role_col, text_col))
    turn = F.struct(
        F.col(turn_col).alias("turn"), turn_id(role, text).alias("id"), F.length(text).alias("size")
    )
    thin = rows.select(F.col(conv_col).alias("conv"), turn.alias("turn")).filter("conv IS NOT NULL")
    return thin.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def with_shared_starts(chats: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin like the first of their group of ids, for trials.

    The first ``crc32(id) % most`` turns come from conversation ``id - id % group``.
    """
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    of = (F.col("conv") - F.col("conv") % group).alias("of")
    grouped = chats.select("conv", of, "turns", head.alias("head")).repartition("of")
    heads = chats.filter(F.col("conv") % group == 0)
    heads = heads.select(F.col("conv").alias("of"), F.slice("turns", 1, most).alias("first_turns"))
    own = F.slice("turns", F.col("head") + 1, F.size("turns"))
    start = F.slice(F.coalesce("first_turns", F.array()), F.lit(1), F.col("head"))
    return grouped.join(heads, "of", "left").select("conv", F.concat(start, own).alias("turns"))


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of ids of every run of equal ``mark`` in ``(mark, conv)``, joined by commas."""
    schema = pa.schema([("mark", pa.binary()), ("conv", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    mark, ids, out = None, [], []

    def close():
        if ids:
            out.append({"mark": mark, "conv": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))})
            ids.clear()

    for batch in batches:
        for m, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if m != mark or len(ids) >= PIECE_IDS:
                close()
                mark = m
            ids.append(conv)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    close()
    yield pa.RecordBatch.from_pylist(out, schema)


def hashed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(conv, n, ends)`` of every run of equal ``mark``: least id, count, hash of all ids."""
    schema = pa.schema([("conv", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    mark = least = running = None
    total, out = 0, []

    def close():
        if running is not None:
            out.append({"conv": least, "n": total, "ends": running.hexdigest()})

    for batch in batches:
        for m, conv, n, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if running is None or m != mark:
                close()
                mark, least, total, running = m, conv, 0, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
            total += n
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    close()
    yield pa.RecordBatch.from_pylist(out, schema)


def distinct_keys(chats: DataFrame) -> DataFrame:
    """``(key, sizes, n_convs, least, ends)`` for every distinct sequence of turns."""
    hexes = F.array_join(F.transform("turns", lambda t: t["id"]), "")
    keyed = chats.select(
        "conv",
        F.unhex(hexes).alias("key"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
        F.unhex(F.left(F.sha2(hexes, 256), F.lit(2 * ID_BYTES))).alias("mark"),
    )
    keyed = cut(keyed)
    # Ranges of (mark, conv) split the ids of a conversation that very many are equal to.
    dealt = keyed.select("mark", "conv").repartitionByRange("mark", "conv")
    pieces = dealt.sortWithinPartitions("mark", "conv").mapInArrow(
        hashed_ids, "mark binary, conv long, n long, ids string"
    )
    pieces = pieces.repartition("mark").sortWithinPartitions("mark", "conv")
    ends = pieces.mapInArrow(hashed_pieces, "conv long, n long, ends string")
    # The conversation with the least id stands for its equals, so this join has unique keys.
    return keyed.join(ends, "conv").select(
        "key", "sizes", F.col("n").alias("n_convs"), F.col("conv").alias("least"), "ends"
    )


# --- The trie -----------------------------------------------------------------------------


def prefix_trie(chats: DataFrame, tree_keys: int = TREE_KEYS, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """One row per node of the trie over ``(conv, turns array<struct<turn, id, size>>)``.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256)``; ``conv_id`` is the least member, so id and depth name the node.
    """
    keys = cut(distinct_keys(chats))
    dealt = keys.repartitionByRange("key").sortWithinPartitions("key")
    made = cut(dealt.mapInArrow(with_trees(tree_keys, tree_bytes), NODES))
    # One row per task that had keys: this window is bounded by the number of partitions.
    following = Window.orderBy("first")
    borders = made.filter("kind = 'border'").select(
        "last", F.lead("first").over(following).alias("next"), "last_sizes"
    )
    twice = borders.filter("next IS NOT NULL").mapInArrow(
        across_tasks,
        "depth int, digest binary, parent_digest binary, n_children long, n_leaves long, saved long",
    )
    parts = made.filter("kind = 'part'").unionByName(
        twice.withColumns({"kind": F.lit("part"), "n_convs": F.lit(0)}), allowMissingColumns=True
    )
    open_nodes = cut(
        parts.groupBy("digest", "depth", "parent_digest").agg(
            F.min("conv").alias("conv"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
            F.max("ends").alias("ends"),
        )
    )
    # A closed node under an open one takes its parent's id from it; the open node knows
    # how many children it has, so one with very many of them is sent to them.
    parents = open_nodes.filter("n_children > 0").select(
        F.col("digest").alias("parent_digest"), F.col("conv").alias("above"), F.col("n_children").alias("children")
    )
    columns = ["conv", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    closed = made.filter("kind = 'node'")
    inside = closed.filter("parent_digest IS NULL").select(*columns, F.col("parent").alias("above"))
    below = closed.filter("parent_digest IS NOT NULL").select("parent_digest", *columns)
    below = below.unionByName(open_nodes.filter("depth > 0").select("parent_digest", *columns))
    below = hot_key_join(below, parents, "parent_digest", "children").select(*columns, "above")
    root = open_nodes.filter("depth = 0").select(*columns, F.lit(None).cast("long").alias("above"))
    return inside.unionByName(below).unionByName(root).select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
