import random
import re

from visitorlens.llm import licenses as lc


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_places(text):
    words = plain_words(text)
    return sorted(
        (i, label)
        for phrase, label in lc.PHRASES
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )


def plain_notices(text, templates, threshold):
    """Every block of every template, counted anew."""
    words, best = plain_words(text), {}
    for label, template in templates.items():
        of = plain_words(template)
        size = len(of) + max(1, len(of) // 4)
        blocks = [words[i : i + size] for i in range(max(1, len(words) - size + 1))]
        share = max(len(set(of) & set(b)) for b in blocks) / len(set(of))
        if share >= threshold:
            best[label] = share
    return sorted(best.items())


def texts():
    rng = random.Random(5)
    vocabulary = sorted({w for t in lc.TEMPLATES.values() for w in plain_words(t)}) + ["é1", "x", "zz"]
    out = [None, "", "\n\n", "CC\nBY", "mit License, MIT LICENSE", "by by cc by", "K cc by"]
    for _ in range(120):
        template = plain_words(rng.choice(list(lc.TEMPLATES.values())))
        words = [w for w in template if rng.random() < rng.choice([0.7, 0.85, 0.95])]
        words = rng.choices(vocabulary, k=rng.randint(0, 9)) + words + rng.choices(vocabulary, k=5)
        out.append("".join(w + rng.choice([" ", " ", " ", "\n", ", "]) for w in words))
    return out


def test_all_pairs_as_brute_force(spark):
    rows = [(i if i % 9 else None, t, 1) for i, t in enumerate(texts())] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = lc.scan_licenses(docs).collect()
    want = [
        (i, len(plain_words(t)), plain_places(t), plain_notices(t, lc.TEMPLATES, lc.THRESHOLD))
        for i, t, _ in rows
    ]
    plain = [(r.doc_id, r.n_words, [tuple(p) for p in r.places], [tuple(n) for n in r.notices]) for r in got]
    assert plain == want
    assert sum(bool(r.notices) for r in got) > 40


def test_notices_across_line_ends_but_not_scattered_words(spark):
    notice = "This work is licensed under a Creative Commons\nAttribution 4.0 International License"
    filler = " ".join(f"w{i}" for i in range(300))
    scattered = "released " + filler + " under " + filler + " the " + filler + " license"
    rows = [(1, f"{filler} {notice} {filler}"), (2, scattered), (3, notice * 2), (4, f"{filler}\nReleased under\nthe MIT\nLicense")]
    got = lc.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    labels = {r.doc_id: [n.label for n in r.notices] for r in got}
    assert "cc-by-4.0-notice" in labels[1] and "cc-by-4.0-notice" in labels[3]
    assert labels[2] == [] and labels[4] == ["mit-notice"]


def test_report(spark):
    docs = spark.createDataFrame(
        [(1, "A.\nLicensed under CC BY-NC 4.0.\nMIT license"), (2, None)], "doc_id long, text string"
    )
    a, b = lc.license_report(lc.scan_licenses(docs)).collect()
    assert tuple(a) == (1, 10, 2, 3, 8, "cc-by,mit", "cc-by,cc-by-nc-4.0-notice,mit", 1.0)
    assert tuple(b) == (2, 0, 0, None, None, "", "", 0.0)
    assert lc.scan_licenses(docs.limit(0)).count() == 0
