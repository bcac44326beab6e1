import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from visitorlens.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, conv string, mark string"
BODY = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = BODY.findall(text)
        if not visible:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, most_inserts=6):
    """Every sequence of edits of growing cost: the least audit of the first cost that fits."""
    marks = faults(rows)
    best = None

    def walk(at, state, cost, audit, out, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if at == len(rows) and state in ("", "a"):
            found = (cost, audit, "\n".join(out))
            best = min(best or found, found, key=lambda f: f[:2])
        made = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[made]
        if inserts < most_inserts:
            walk(at, made, cost + 2, audit + "I", [*out, f"{name}:"], inserts + 1)
        if at < len(rows):
            _, role, text = rows[at]
            walk(at + 1, state, cost + 3, audit + "D", out, inserts)
            if marks[at] not in ("blank", "duplicate"):
                extra = marks[at] == "truncated"
                initial = role[:1]
                if initial == made or (state == "" and initial == "s"):
                    walk(at + 1, initial, cost + extra, audit + "K", [*out, f"{role}:{text}"], inserts)
                walk(at + 1, made, cost + 2 + extra, audit + "R", [*out, f"{name}:{text}"], inserts)

    walk(0, "", 0, "", [], 0)
    return best


def plain(rows, repair=cheapest):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks = faults(own)
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, said = repair(own)
        out[conv] = (
            gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(said.encode()).hexdigest(),
        )
    return out


def report(spark, rows, damage=False):
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)
    if damage:
        repaired = tr.repair_conversations(tr.damaged(df), present=F.col("present"))
    else:
        repaired = tr.repair_conversations(df)
    got = [tuple(r) for r in tr.repair_report(repaired).collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def test_all_short_conversations(spark):
    kinds = [("system", "s."), ("user", "u."), ("assistant", "a?"), ("tool", "cut"), ("user", " \n")]
    rows = []
    for conv, chosen in enumerate(p for n in (1, 2, 3, 4) for p in product(kinds, repeat=n)):
        # Texts differ by row, or they would all be duplicates.
        rows += [(conv, t, role, text if text.isspace() else f"{t}{text}") for t, (role, text) in enumerate(chosen)]
    assert report(spark, rows) == plain(rows)


def random_rows(seed, n):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "sudo"])
            text = rng.choice(["One.", "two", "Three!\t", "", None, "four?", "é😀.", "\x0b"])
            out.append((conv if conv else None, rng.choice([turn, turn, turn, turn * 3, None]), role, text))
    return out


def test_random_conversations(spark):
    rows = random_rows(1, 150)
    assert report(spark, rows) == plain(rows)


def test_damage(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Text {c} {t % 4}. End!") for c in range(400) for t in range(c % 9 + 1)]
    rows += [(None, None, None, "x."), (5, None, "user", None)]
    hit, empty = [], set()
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        hit += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        empty.add(c)
    want = plain(hit)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = report(spark, rows, damage=True)
    assert got == {c: want.get(c, nothing) for c in empty}
    assert nothing in got.values()


def test_empty_and_very_long(spark):
    assert report(spark, []) == {}
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(4000)]
    rows += [(2, t, "user", f"{t}.") for t in range(1500)] + [(3, 0, "user", "x" * 500_000 + ".")]
    got = report(spark, rows)
    assert got[1][4:7] == (0, 0, "K" * 4000)
    # Turns of one role by turns: each second one is given the other role.
    assert got[2][5] == 1500 and len(got[2][6]) == 1500
    assert got[3][5:7] == (2, "KI")


def least_suffix(codes):
    """Least audits by strings: of every node the least of its optimal arcs' strings."""
    costs = tr.costs_to_go(codes)
    best = {}
    for at in range(len(codes), -1, -1):
        for state in sorted(range(4), key=lambda s: costs[at][s]):
            options = [""] if at == len(codes) and costs[at][state] == 0 else []
            if at < len(codes):
                options += [e + best[at + 1, to] for c, to, e, _ in tr.CODES[codes[at]][state] if c + costs[at + 1][to] == costs[at][state]]
            options += [e + best[at, to] for c, to, e, _ in tr.INSERTS[state] if c + costs[at][to] == costs[at][state]]
            best[at, state] = min(options)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_ranks_order_all_nodes_by_their_least_audit(seed):
    rng = random.Random(seed)
    codes = "".join(rng.choice("xsuaSUA-=") for _ in range(40))
    costs = tr.costs_to_go(codes)
    arcs = sorted([(0, 0, 0, None, None), *tr.optimal_arcs(codes, costs, 1)], key=lambda a: a[0])
    import numpy as np

    rank = tr.audit_ranks(*(np.array([a[i] for a in arcs], np.int64) for i in range(3)), 200)
    want = least_suffix(codes)
    nodes = sorted(want, key=lambda k: rank[1 + k[0] * 4 + k[1]])
    audits = [want[k] for k in nodes]
    assert audits == sorted(audits)
    assert tr.repair_codes([codes])[0]["audit"] == want[0, 0]
