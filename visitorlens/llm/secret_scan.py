"""Secret scan: base patterns, and assignments of literals to sensitive names.

Base spans are the matches of three patterns. Beyond them the text is lexed into
name-literal pairs (``name = "literal"``, ``name: literal``, ``"name" => 'literal'`` and
the like). A bare value that is itself the name of an assigned literal is a constant; it
is followed to its literal, through any number of names. A literal is reported when a
sensitive name takes it and it looks like a credential:

* ``named``: the literal stands in the assignment to the sensitive name;
* ``flow``: it was assigned to another name, whose value the sensitive name takes.

Spans are code-point offsets, end exclusive: of the whole match for base patterns, of
the literal without quotes for the others.

Defined cases: a null text is an empty one and has no spans; repeated rows stay
repeated; an empty table gives no rows; of several assignments to a constant the last
one before its use counts, or else the first one after it; names that refer to each other in a ring
have no literal; columns other than the two named are not looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitorlens.llm.common import column_types, map_rows

# Base patterns with the shortest match that counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
KINDS = ["assign", "access", "hex", "named", "flow"]
BASE_KINDS = KINDS[:3]

# How strongly a part of a name says that its value is secret. Two parts that only
# together say so are one entry.
NAME_WEIGHTS = {
    ("password",): 1.0,
    ("passwd",): 1.0,
    ("passphrase",): 1.0,
    ("pwd",): 0.9,
    ("secret",): 1.0,
    ("token",): 0.9,
    ("apikey",): 1.0,
    ("api", "key"): 1.0,
    ("access", "key"): 1.0,
    ("private", "key"): 1.0,
    ("signing", "key"): 0.9,
    ("encryption", "key"): 0.9,
    ("credential",): 0.9,
    ("credentials",): 0.9,
    ("auth",): 0.7,
}
# Values that documentation puts where a secret would stand.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "****", "dummy", "redacted")
MIN_LITERAL, MIN_SCORE = 8, 0.5

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A run of fewer characters can't hold a longer one, so the length can be in the pattern.
_ACCESS = re.compile(f"AKIA[A-Z0-9]{{{ACCESS_CHARS - 4},}}")
_HEX = re.compile(f"[0-9a-f]{{{HEX_CHARS},}}")
_PAIR = re.compile(
    r"""(?<![\w.$-])(?:(["'])(?P<quoted>[A-Za-z_$][\w.$-]*)\1|(?P<name>[A-Za-z_$][\w.$-]*))"""
    r"""[ \t]*(?::=|=>|=(?![=~])|:(?![:/]))[ \t]*"""
    r"""(?:"(?P<double>(?:[^"\\\n]|\\.)*)"|'(?P<single>(?:[^'\\\n]|\\.)*)'"""
    # A bare value isn't consumed, as in ``a = b = "literal"`` it is a name, too.
    r"""|(?=(?P<bare>[^\s"',;(){}\[\]<>=]+)))""",
    re.ASCII,
)
_NAME = re.compile(r"[A-Za-z_$][\w.$-]*", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns, each kind from left to right without overlaps."""
    spans = []
    if "=" in text or ":" in text:
        spans += [
            ("assign", m.start(), m.end())
            for m in _ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= ASSIGN_CHARS
        ]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return spans + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = set(zip(parts, parts[1:], strict=False)) | {(p,) for p in parts}
    return max((NAME_WEIGHTS[p] for p in pairs if p in NAME_WEIGHTS), default=0.0)


def literal_strength(literal: str, quoted: bool) -> float:
    """0 to 1: how much a value looks like a credential rather than prose or a placeholder."""
    low = literal.lower()
    if len(literal) < MIN_LITERAL or " " in literal or any(p in low for p in PLACEHOLDERS):
        return 0.0
    if literal.startswith(("$", "%", "{", "<")) or "://" in literal:
        return 0.0
    letters = any(map(str.isalpha, literal))
    mixed = literal != low and literal != literal.upper()
    # A bare value with letters only is a word; a quoted one may be, unless its case is mixed.
    if not any(map(str.isdigit, literal)) and not (quoted and mixed) or not letters:
        return 0.0
    counts = Counter(literal).values()
    bits = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts)
    return min(1.0, bits / 3.0)


def assigned_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of literals that sensitive names take directly or by way of constants."""
    if "=" not in text and ":" not in text:
        return []
    pairs = []
    for m in _PAIR.finditer(text):
        kind = m.lastgroup
        pairs.append((m["quoted"] or m["name"], kind, *m.span(kind)))
    weights = [name_weight(p[0]) for p in pairs]
    if not any(weights):
        return []
    defined: dict[str, list[int]] = {}
    for i, pair in enumerate(pairs):
        defined.setdefault(pair[0], []).append(i)

    known: dict[int, int | None] = {}

    def literal_of(i: int) -> int | None:
        """The pair whose literal the value of pair ``i`` is, or None in a ring.

        Every pair leads to one other at most, so what is found holds for all on the way.
        """
        way = []
        while i not in known:
            known[i] = None  # what a ring comes back to
            way.append(i)
            _, kind, start, end = pairs[i]
            value = text[start:end]
            places = defined.get(value) if kind == "bare" and _NAME.fullmatch(value) else None
            if not places:
                known[i] = i
                break
            before = bisect_left(places, i)
            i = places[before - 1] if before else places[0]
        for passed in way:
            known[passed] = known[i]
        return known[i]

    spans = set()
    for i, weight in enumerate(weights):
        source = literal_of(i) if weight else None
        if source is None:
            continue
        _, kind, start, end = pairs[source]
        if weight * literal_strength(text[start:end], kind != "bare") >= MIN_SCORE:
            spans.add(("named" if source == i else "flow", start, end))
    return list(spans)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed, then end."""
    if not text:
        return []
    spans = base_spans(text) + assigned_spans(text)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans array<kind, start, end>)`` for every row, from whole texts."""

    def start() -> Callable:
        return lambda key, text: [(key, find_spans(text))]

    schema = (
        column_types(docs, [id_col])
        + ", spans array<struct<kind: string, start: long, end: long>>"
    )
    return map_rows(docs.select(id_col, text_col), start, schema)


def secret_report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans as text."""

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
        for kind in BASE_KINDS
    ]
    return scanned.select(
        id_col,
        *counts,
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
