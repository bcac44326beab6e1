import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from visitorlens.llm import simhash as sh


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, bits=4):
    """Least id reachable over all pairs; rows are (id, fp)."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= bits and find(a) != find(b):
                root[find(b)] = find(a)
    least = {}
    for key, f in rows:
        r = find(f)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return {f: least.get(find(f)) for f in fps}


TEXTS = [None, "", " \n\t", "One", "one two three", "ONE two Three four", "É x y Z w", "a\x1cb c d e f", "x " * 30_000, "KK sſ a b c d"]


def test_fingerprints_as_stated():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["a", "B", "é", " ", "\n", " ", "dd "]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for text in texts:
        assert sh.fingerprint(text) == plain_fingerprint(text), repr(text)[:80]


def spread_out(rng, n):
    """Fingerprints in chains and dense groups, with distances around the limit."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            out.append(x)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 4, 5, 6])):
                x ^= 1 << b
            if rng.random() < 0.2:
                x = rng.choice(out)
    return out[:n]


@pytest.mark.parametrize("blocks, tile", [(6, 4096), (7, 4096), (6, 12), (5, 100)])
def test_components_as_brute_force(spark, blocks, tile):
    rng = random.Random(blocks + tile)
    fps = spread_out(rng, 700) + [0, 0, 1, 3, 2**64 - 1]
    # One crowded key: the same bits but for the last twelve.
    fps += [(0x123456789ABCD << 12) | rng.getrandbits(12) for _ in range(150)]
    ids = [None if i % 11 == 0 else i // 2 for i in range(len(fps))]
    rng.shuffle(ids)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fp long")
    want = plain_components(list(zip(ids, fps)))
    got = sh.with_components(df, blocks=blocks, tile_rows=tile).collect()
    assert Counter((r.fp % 2**64, r.component_id) for r in got) == Counter(want.items())


def test_every_pair_meets_in_some_key():
    rng = random.Random(3)
    table = sh.PivotTable()
    for _ in range(500):
        x = y = rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        a, b = table.keys(np.array([x, y], np.uint64))
        assert (a == b).any()
        c = table.coordinates(np.array([x, y], np.uint64)).astype(int)
        assert abs(c[0] - c[1]).max() <= 4


def test_documents(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = list(enumerate(TEXTS))
    for i in range(40):
        base = rng.choices(words, k=rng.randint(3, 300))
        for j in range(rng.choice([1, 1, 3])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((100 + i * 3 + j, " ".join(copy if j else base)))
    rows += rows[-5:] + [(None, rows[20][1]), (None, "only here without an id")]
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, component_id string, row int")
    plain = [(k, plain_fingerprint(t)) for k, t in rows]
    of = plain_components(plain)
    got = sh.near_duplicates(docs).collect()
    assert Counter(map(tuple, got)) == Counter((k, f"{f:016x}", of[f]) for k, f in plain)
    kept = sh.keep_one(docs).collect()
    groups = {}
    for (k, _), (_, f) in zip(rows, plain):
        groups.setdefault(of[f] if of[f] is not None else f"none {f}", []).append(k)
    assert Counter(r.doc_id for r in kept) == Counter(g if not str(g).startswith("none") else None for g in groups)
    assert sh.keep_one(docs).columns == docs.columns
    assert sh.near_duplicates(docs.limit(0)).count() == 0 and sh.keep_one(docs.limit(0)).count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = ["_row_hash_1", "_row_hash_2", "fp", "root", "least"]
    docs = spark.createDataFrame([(i, f"a{i // 2} text of its own number {i // 2} here and b{i // 2}", *names) for i in range(6)], ["doc_id", "text", *names])
    got = sh.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"a{i // 2} text of its own number {i // 2} here and b{i // 2}", *names) for i in (0, 2, 4)]


def test_dense_group_gives_a_forest(spark):
    fps = [(0x123456789ABCD << 12) | i for i in range(256)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    # All of them meet in ten keys at most; each key adds no more links than a forest has.
    keys = sh.PivotTable().keys(np.array(fps, np.uint64))
    most = sum(len(keys) - len(set(column)) for column in keys.T.tolist())
    assert 255 <= sh.find_links(df).count() <= most
