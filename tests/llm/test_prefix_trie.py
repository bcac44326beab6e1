import hashlib
import random
import zlib

import pytest

from visitorlens.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string"


def built(rows):
    """Conversations as lists of turns, in the order of their numbers, then ids."""
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by.setdefault(conv, []).append((turn is not None, turn or 0, mark, role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in by.items()}


def shared(chats):
    out = {}
    for c, turns in chats.items():
        head = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = chats.get(base, [])[:head] + turns[head:]
    return out


def plain(chats):
    """Every prefix of every conversation in a dictionary."""
    members, below, ends = {}, {}, {}
    for c, turns in chats.items():
        turns = tuple(turns)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                below.setdefault(turns[: d - 1], set()).add(turns[:d])
        ends.setdefault(turns, []).append(c)
    leaves, saved, out = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        nodes = below.get(p, ())
        leaves[p] = sum(leaves[q] for q in nodes) or 1
        saved[p] = sum(saved[q] for q in nodes) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        above = min(members[p[:-1]]) if p else None
        out[min(members[p]), len(p)] = (above, len(members[p]), len(nodes), leaves[p], saved[p], digest)
    return out


def nodes(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {r[:2]: r[2:] for r in rows}


def frame(spark, rows, parts=1):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA).repartition(parts)


def chatter(seed=3, n=400):
    """Few different turns, so that conversations share beginnings and are often equal."""
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 2, 3, 5, 9])):
            text = rng.choice(["a", "b", "é😀", "", None, "long " * 30])
            out.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", None]) if t else "user", text if t else "hi"))
    return out


@pytest.mark.parametrize("settings", [{}, {"tree_keys": 1}, {"tree_keys": 4}, {"tree_bytes": 200}])
def test_equals_brute_force(spark, settings):
    rows = chatter()
    turns = pt.conversation_turns(frame(spark, rows, 5))
    assert nodes(pt.prefix_trie(turns, **settings)) == plain(built(rows))


def test_shared_starts(spark):
    rows = chatter(5, 330) + [(-7, 0, "user", "x"), (-107, 1, "user", "y"), (100_050, 0, "user", "z")]
    turns = pt.with_shared_starts(pt.conversation_turns(frame(spark, rows)))
    assert nodes(pt.prefix_trie(turns, tree_keys=16)) == plain(shared(built(rows)))


def test_equal_conversations_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE_IDS", 10)
    rows = [(c, t, "user", f"t{t}") for c in range(500) for t in range(3 if c % 5 else 2)]
    turns = pt.conversation_turns(frame(spark, rows, 4))
    assert nodes(pt.prefix_trie(turns)) == plain(built(rows))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "x"), (1, None, None, None), (1, None, "", ""), (2, 0, "user", "x" * 100_000),
        (3, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, "use", "rx"), (9, 5, "user", "x"), (9, -5, "user", "x"),
    ]
    turns = pt.conversation_turns(frame(spark, rows))
    assert nodes(pt.prefix_trie(turns)) == plain(built(rows))
    assert pt.prefix_trie(pt.conversation_turns(frame(spark, []))).count() == 0
    assert pt.prefix_trie(pt.with_shared_starts(pt.conversation_turns(frame(spark, [])))).count() == 0
    only_empty = spark.createDataFrame([(5, []), (3, [])], "conv long, turns array<struct<turn: long, id: string, size: int>>")
    assert nodes(pt.prefix_trie(only_empty)) == plain({5: [], 3: []})


def test_a_very_long_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c, n in ((0, 3000), (1, 2999), (2, 1500)) for t in range(n)]
    turns = pt.conversation_turns(frame(spark, rows))
    assert nodes(pt.prefix_trie(turns, tree_keys=2)) == plain(built(rows))


def test_tree_layouts_grow():
    tree = pt.RadixTree()
    kinds = []
    for byte in range(256):
        tree.insert(bytes([7, 7, byte, 1]), byte)
        kinds.append(type(tree.root.next.get(7).next).__name__ if byte else "")
    assert [kinds.index(k) for k in ("SmallLayout", "IndexedLayout", "FullLayout")] == [1, 16, 48]
    assert tree.root.next.get(7).path == b"\x07\x07"
    assert [b for b, _ in tree.root.next.get(7).next.in_order()] == list(range(256))
    tree.insert(b"\x07", "above")
    node = tree.root.next.get(7)
    assert (node.path, node.value, node.next.get(7).path) == (b"\x07", "above", b"\x07")
