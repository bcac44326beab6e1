import math
import random
import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from visitorlens.llm import quality_rules as qr


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(qr.SYMBOLS, text)), len(lines) - len(set(lines)), len(covered), failed)


def texts():
    rng = random.Random(4)
    out = [None, "", " \t\n\x0b\x0c\r", "\n\n", "a b", "a b c", "a b c a b c", "a a a a", " x y", "😀 é #|<>\x1c x",
           "x\n x\nx\r\nx\n \n \n"]
    for _ in range(150):
        vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 30, 1000]))] + ["#", "é"]
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t ", "  "]) for w in rng.choices(vocabulary, k=rng.randint(0, 200))))
    return out + ["long " * 60_000, " ".join(f"u{i}" for i in range(40_000))]


def test_base_counts_as_brute_force(spark):
    rows = [(i if i % 9 else None, t, None, True) for i, t in enumerate(texts())] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (77777, 0)], "doc_id long, quality int")
    got = qr.quality_report(qr.judge_quality(docs, labels)).collect()
    assert Counter((r.doc_id, *tuple(r)[1:7]) for r in got) == Counter((i, *plain(t)) for i, t, _, _ in rows)
    assert all(r.kept != r.base_failed for r in got)
    assert qr.judge_quality(docs.limit(0), labels).count() == 0
    assert qr.keep_good(docs, labels.limit(0)).columns == docs.columns


def exact_tail(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_binomial_tail_is_exact(spark):
    cases = [(0, 1), (0, 10), (3, 700), (0, 600), (5, 1000), (9, 1000), (30, 4000)]
    df = spark.createDataFrame([(float(k), float(n)) for k, n in cases], "k double, n double")
    got = [r[0] for r in df.select(qr.binomial_tail(F.col("k"), F.col("n"), 0.01)).collect()]
    for (k, n), value in zip(cases, got, strict=True):
        assert math.isclose(value, exact_tail(k, n, 0.01), rel_tol=1e-9), (k, n)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "stratum string, good boolean, holdout boolean, a int, b int")


def plain_cutoffs(rows, loss, risk, weight):
    """Families, gains, p-values and Holm's procedure over plain lists."""
    tested = []
    for s in {r[0] for r in rows}:
        tuning = [r for r in rows if r[0] == s and not r[2]]
        held = [r for r in rows if r[0] == s and r[2] and r[1]]
        best = None
        for level in qr.LEVELS:
            vector = []
            for at in (3, 4):
                good = [r[at] for r in tuning if r[1]]
                edge = max((c for c in {r[at] for r in tuning} if sum(g >= c for g in good) > level * len(good)), default=0)
                above = sorted({r[at] for r in tuning if not r[1] and r[at] > edge})
                begin = above[min(math.ceil(len(above) / 10), len(above) - 1)] if above else None
                vector.append(None if begin is None else (edge + 2 + begin) // 2)

            def rejects(r, vector=vector):
                return any(c is not None and r[at] >= c for at, c in zip((3, 4), vector))

            gain = sum((1 if not r[1] else -weight) for r in tuning if rejects(r))
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, vector, sum(map(rejects, held))
        if best and held:
            n, k = len(held), best[2]
            tested.append((exact_tail(k, n, loss) if k < n * loss else 1.0, s, best[1]))
    out, left = {}, len(tested)
    for p, s, vector in sorted(tested, key=lambda t: t[0]):
        if p * left > risk:
            break
        out[s] = vector
        left -= 1
    return out


def test_cutoffs_as_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for s, n in (("en", 3000), (None, 1500), ("small", 240), ("few", 40), ("clean", 300)):
        for _ in range(n):
            good = rng.random() < 0.8 or s == "clean"
            a = min(1000, int(rng.expovariate(1 / 5))) if good else rng.randint(0, 1000)
            b = rng.randint(0, 1000) if s != "small" else (rng.randint(0, 300) if good else rng.randint(200, 1000))
            rows.append((s, good, rng.random() < 0.5, a, b))
    got = qr.choose_cutoffs(labelled(spark, rows), ["a", "b"], good_weight=5)
    want = plain_cutoffs(rows, qr.MAX_LOSS, qr.RISK, 5)
    assert {r.stratum: r.cutoffs for r in got.collect()} == want
    # Few labels certify nothing, and without bad documents nothing is to be gained.
    assert set(want) == {"en", None, "small"}


def test_a_stratum_needs_as_many_labels_as_stated(spark):
    def certified(n):
        rows = [("s", True, True, 0, 0)] * n + [("s", True, False, 0, 0)] * 20 + [("s", False, False, 900, 0)] * 20
        return qr.choose_cutoffs(labelled(spark, rows), ["a", "b"]).count()

    assert [certified(n) for n in (58, 59)] == [0, 1]


def test_columns_of_any_name_pass_through(spark):
    names = ["_words", "_of", "_cutoffs", "_counts", "_kept", "_failed", "_spaced", "_Lines", "a.b"]
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", *names)], ["doc_id", "text", "lang", *names])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in qr.keep_good(docs, labels).collect()] == [(1, text, "en", *names)]
    judged = qr.judge_quality(docs, labels, carry=["doc_id", "_words"])
    assert judged.columns == ["doc_id", "_words", *qr.RESULTS] and judged.first()["_words"] == "_words"


def test_labels_sent_or_joined_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")

    def kept(**settings):
        return {r.doc_id: r._kept for r in qr.judge_quality(docs, labels, **settings).select("doc_id", "_kept").collect()}

    want = kept()
    monkeypatch.setattr(qr, "BROADCAST_LABELS", 0)
    assert kept() == kept(carry=["doc_id"]) == want


def test_false_rejection_stays_below_the_limit(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(6000):
        good = i % 4 != 0
        text = " ".join(rng.choices(words, k=60))
        if not good:
            text = re.sub(r"(w\d+)", r"\1###", text)
        docs.append((i, text, "en" if i % 2 else None))
        if i < 5000:
            labels.append((i, int(good)))
    got = qr.judge_quality(
        spark.createDataFrame(docs, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    ).select("doc_id", "_kept").collect()
    kept = {r.doc_id: r._kept for r in got}
    good = [kept[i] for i in range(6000) if i % 4 != 0]
    assert good.count(False) <= qr.MAX_LOSS * len(good)
    assert not any(kept[i] for i in range(0, 6000, 4))
