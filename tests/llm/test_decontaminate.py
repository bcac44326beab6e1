import random

import numpy as np
import pytest

from visitorlens.llm import decontaminate as dc


def plain_edits(window, text):
    """Least edits of a window against any region of a text, over all cells."""
    text = np.array([ord(c) for c in text], np.int64)
    across = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for c in window:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != ord(c)))
        row = np.minimum.accumulate(new - across) + across
    return int(row.min())


def plain(text, items, match):
    text = dc.normalised(text)
    out = []
    for key, item in items:
        item = dc.normalised(item)
        good = [
            n
            for s, size in match.windows(len(item))
            if (n := plain_edits(item[s : s + size], text)) <= match.edits(size)
        ]
        if good:
            out.append((key, len(good), min(good)))
    return out


def planted(rng, letters, item, edits):
    cut = rng.choice([0, 0, len(item) // 3])
    out = list(item[cut:])
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice(letters)]
    return "".join(out)


@pytest.mark.parametrize("letters, match", [("abcd é", dc.MATCH), ("ab ", dc.MATCH), ("abcdefgh", dc.Match(q=6, window=50, step=7, max_error=0.1, min_chars=30))])
def test_windows_as_brute_force(letters, match):
    rng = random.Random(len(letters))
    word = lambda n: "".join(rng.choices(letters, k=n))
    items = [(i, word(rng.choice([20, 39, 40, 55, 67, 80, 81, 130, 260]))) for i in range(24)]
    items = [(i, t) for i, t in items if dc.normalised(t)]
    texts = [None, "", " ", "a"]
    for _ in range(60):
        item = rng.choice(items)[1]
        texts.append(word(rng.randint(0, 200)) + planted(rng, letters, item, rng.choice([0, 1, 3, 5, 8])) + word(rng.randint(0, 200)))
    texts += [items[3][1], items[5][1].upper(), items[6][1].replace(" ", "\n\t ")]
    index = dc.ItemIndex([(k, dc.normalised(t)) for k, t in items], match)
    got = index.search(texts)
    for text, found in zip(texts, got, strict=True):
        assert [m[:3] for m in found] == plain(text, items, match), text
    assert sum(map(bool, got)) > 20


def test_long_texts_are_searched_whole(monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefg hij", k=n))
    items = [(1, dc.normalised(word(200))), (2, dc.normalised(word(90)))]
    texts = [word(3000)[: rng.randrange(3000)] + " " + items[k % 2][1] + " " + word(rng.randrange(4000)) for k in range(40)]
    index = dc.ItemIndex(items)
    want = index.search(texts)
    assert all(want[k][0][0] == items[k % 2][0] and want[k][0][2] == 0 for k in range(40))
    for text, found in zip(texts, want, strict=True):
        assert dc.normalised(text)[found[0][3] :].startswith(dict(items)[found[0][0]][found[0][4] :][:80])
    for chars in (100, 700, 5000):
        monkeypatch.setattr(dc, "BATCH_CHARS", chars)
        assert index.search(texts) == want
    monkeypatch.setattr(dc, "PIECE", 3)
    assert index.search(texts) == want


def test_tables(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefghijk ", k=n))
    items = [(i if i else None, word(120), 1) for i in range(9)] + [(50, None, 1), (51, "short", 1)]
    clean = [(i, word(400), "t") for i in range(20)]
    rows = clean + [(100 + i, word(50) + " " + items[i % 9][1] + " " + word(90), "t") for i in range(12)]
    rows += [rows[-1], (None, items[1][1], "t"), (200, None, "t"), (201, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    for chars in (10**6, 200):
        found = dc.find_contained(docs, bench.withColumnRenamed("item_id", "item"), item_id_col="item", block_chars=chars).collect()
        want = sorted([(100 + i, items[i % 9][0]) for i in range(12)] + [(111, items[2][0]), (None, items[1][0])], key=repr)
        assert sorted([(r.doc_id, r.item) for r in found], key=repr) == want
        kept = dc.drop_contained(docs, bench, block_chars=chars)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted([*clean, (200, None, "t"), (201, "", "t")], key=repr)
    assert dc.find_contained(docs, bench.limit(0).withColumnRenamed("item_id", "item"), item_id_col="item").count() == 0
    assert dc.drop_contained(docs, bench.limit(0)).count() == docs.count()
    assert dc.drop_contained(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("edits", [0, 6])
def test_short_passages_from_anywhere_inside_an_item(edits):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcdefghijklm", k=n))
    item = word(300)
    index = dc.ItemIndex([(1, item)])
    for start in range(0, 220, 7):
        passage = list(item[start : start + 80])
        for at in range(5, 5 + 12 * edits, 12):
            passage[at] = "Z"
        found = index.search([word(60) + "".join(passage) + word(60)])[0]
        assert found and found[0][2] <= edits, start
    assert not index.search([word(60) + item[100:160] + word(60)])[0]


def test_parameters_must_leave_a_bound():
    with pytest.raises(ValueError):
        dc.Match(q=12, max_error=0.1)
