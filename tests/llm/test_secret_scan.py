import hashlib
import random
import re
import time

from visitorlens.llm import secret_scan as ss


def plain_base(text):
    """The patterns as stated: match, then drop what is too short."""
    assign = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]


def test_base_spans_as_stated():
    rng = random.Random(1)
    pieces = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "ſecret", "toKen", ":", "=", " ", '"', "'", "\n", "AKIA",
              "AKIAAKIA", "abcdef0123456789", "ABCDEF0123", "x", "é", "😀", "+/_", "0" * 11]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert sorted(ss.base_spans(text)) == sorted(plain_base(text)), text


def added(text):
    return [(k, text[a:b]) for k, a, b in ss.find_spans(text) if k not in ss.BASE_KINDS]


def test_pairs_constants_and_scores():
    assert added('db_password = "hunter2hunter2"') == [("named", "hunter2hunter2")]
    assert added("{'privateKey' => 'aB3dE5gH7jK9'}") == [("named", "aB3dE5gH7jK9")]
    assert added('k = "zX81kk20Qp"\nother = 3\nclient_secret = k') == [("flow", "zX81kk20Qp")]
    # Through several names, a chained assignment, a use before the definition.
    assert added('a = "zX81kk20Qp"; b = a; API_KEY: b') == [("flow", "zX81kk20Qp")]
    assert added('pwd = other = "zX81kk20Qp"') == [("flow", "zX81kk20Qp")]
    assert added('token = late\nlate = "zX81kk20Qp"') == [("flow", "zX81kk20Qp")]
    # The last assignment before the use counts.
    assert added('k = "old1old1old1"\nk = "new2new2new2"\ntoken = k\nk = "x3x3x3x3x3"') == [("flow", "new2new2new2")]
    # Rings, placeholders, prose, names that aren't sensitive.
    for text in ["password = a\na = b\nb = a", 'password = "changeme123"', "the token: something", 'title = "zX81kk20Qp"',
                 "password == zX81kk20Qp", 'password = "${DB_PASS}"', "password =", 'password = "', ""]:
        assert added(text) == [], text


def plain_assigned(lines):
    """Assignments, one a line, followed by looking at every line again for each name."""
    found, at, starts = set(), 0, []
    for name, shown in lines:
        starts.append(at + len(name) + 3)
        at += len(name) + 3 + len(shown) + 1
    for i, (name, _) in enumerate(lines):
        weight = ss.name_weight(name)
        if not weight:
            continue
        line, seen = i, []
        while line is not None and line not in seen:
            seen.append(line)
            shown = lines[line][1]
            defined = [k for k, (other, _) in enumerate(lines) if other == shown]
            earlier = [k for k in defined if k < line]
            follow = (earlier[-1] if earlier else defined[0]) if defined else None
            if follow is None:
                quoted = shown[0] in "\"'"
                literal = shown.strip("\"'")
                if weight * ss.literal_strength(literal, quoted) >= ss.MIN_SCORE:
                    begin = starts[line] + quoted
                    found.add(("named" if line == i else "flow", begin, begin + len(literal)))
            line = follow
    return found


def test_named_and_flow_spans_as_brute_force():
    rng = random.Random(11)
    names = ["k", "a", "b", "password", "api_key", "clientSecret", "title", "token", "db_pwd"]
    literals = ['"zX81kk20Qp"', "'hunter2hunter2'", '"changeme123"', "zX81kk20Qp77", "12345678901", '"two words here1"', '"short1"']
    kinds = set()
    for _ in range(1500):
        lines = [(rng.choice(names), rng.choice(names if rng.random() < 0.6 else literals)) for _ in range(rng.randint(1, 9))]
        text = "\n".join(f"{name} = {shown}" for name, shown in lines)
        want = plain_assigned(lines)
        assert set(ss.assigned_spans(text)) == want, text
        kinds |= {k for k, _, _ in want}
    assert kinds == {"named", "flow"}


def test_long_chains_of_constants_take_linear_time():
    def seconds(n):
        lines = [f"token{i} = token{i + 1}" for i in range(n)] + [f"token{n} = 'zX81kk20Qp'"]
        began = time.perf_counter()
        spans = ss.find_spans("\n".join(lines))
        assert [s[0] for s in spans if s[0] != "assign"] == ["named"] or {s[0] for s in spans} >= {"flow"}
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16_000) < 3
    ring = "\n".join([f"token{i} = token{i + 1}" for i in range(3000)] + ["token3000 = token0"])
    assert added(ring) == []


def test_table(spark):
    long_text = "word " * 50_000 + "password=abcdefabcdef0123456789"
    rows = [(1, None, "x"), (2, "", "x"), (None, "token: AAAAAAAAAAAAAA", "x"), (3, long_text, "x"), (3, long_text, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = ss.secret_report(ss.scan_secrets(docs)).collect()
    want = []
    for key, text, _ in rows:
        spans = sorted(plain_base(text or ""), key=lambda s: (s[1], ss.KINDS.index(s[0])))
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(s[0] == k for s in spans) for k in ss.BASE_KINDS]
        want.append((key, *counts, hashlib.sha256(said.encode()).hexdigest()))
    assert [tuple(r)[:5] for r in got] == want
    assert got[3].spans.startswith("assign:250000:") and "hex:250009:" in got[3].spans and "named:250009:" in got[3].spans
    assert ss.scan_secrets(docs.limit(0)).count() == 0
