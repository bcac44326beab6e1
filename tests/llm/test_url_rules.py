import random

from visitorlens.llm import url_rules as ur

RULES = [("org", "/", "allow"), ("a.org", "/es/", "block"), ("a.org", "/en/1", "block"), ("com", "/fr/", "allow")]


def plain(url, rules, default="allow"):
    host, path = ur.split_url(url)
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return (host, path, *(best[2:] if best else (None, default)))


def test_split_url():
    assert ur.split_url(None) == ("", "")
    assert ur.split_url("no scheme/x") == ("", "")
    assert ur.split_url("http://A.Org") == ("a.org", "")
    assert ur.split_url("x://y://z/p?q#r") == ("y:", "//z/p")
    assert ur.split_url("http://h?a/b") == ("h", "")
    assert ur.split_url("http://É.ORG/Q#/x") == ("É.org", "/Q")


def test_every_case_as_brute_force(spark):
    rng = random.Random(3)
    labels, segments = ["a", "b", "org", "com", ""], ["", "es", "en", "1", "12", "e"]
    urls = [None, "", "http://", "http://a.org/en/123"] + [
        "http://"
        + ".".join(rng.choices(labels, k=rng.randint(1, 4)))
        + "".join("/" + s for s in rng.choices(segments, k=rng.randint(0, 4)))
        for _ in range(400)
    ]
    rules = RULES + [
        (".".join(rng.choices(labels[:4], k=rng.randint(1, 3))), "/" + "/".join(rng.choices(segments, k=rng.randint(1, 3))), rng.choice(["allow", "block"]))
        for _ in range(60)
    ]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    # page_id repeated and null; a column named like an output column is left out.
    rows = [(i // 2 if i % 7 else None, u, "x") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    want = sorted([(i, *plain(u, rules)) for i, u, _ in rows], key=repr)
    for chars in (10**6, 200):  # one block, many blocks
        got = ur.judge_urls(pages, table, block_chars=chars)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_block_wins_over_an_equal_allow_rule(spark):
    pages = spark.createDataFrame([(1, "http://x.y/")], "page_id long, url string")
    for order in (["allow", "block"], ["block", "allow"]):
        rules = spark.createDataFrame([("y", "/", v) for v in order], "host string, path string, verdict string")
        for chars in (1, 100):
            assert ur.judge_urls(pages, rules, block_chars=chars).first().verdict == "block"


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://x.y/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert ur.judge_urls(pages, rules, default="block").first().verdict == "block"
    assert ur.judge_urls(pages.limit(0), rules).count() == 0
