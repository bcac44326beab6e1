"""Conversation structure repair: the cheapest edits, and of those the least by their initials.

A row has at most one fault, the first of: blank (no visible character), duplicate (same
role and text as an earlier row), truncated (the last visible character ends no sentence).
A conversation is repaired when its role initials fit ``(s?(ua)+)?``. Edits are Keep,
Rerole (to user or assistant), Delete (the only one for blank and duplicate rows) and
Insert (an empty user or assistant turn); undeleted truncated rows cost extra.

* A cost DP runs backwards over nodes ``(row, state of the grammar)``. Arcs on a cheapest
  path are optimal arcs; an audit is the string of their initials.
* Nodes are ranked by prefix doubling: first by their least initial, then by their least
  audits of 2, 4, 8, ... letters: the rank of ``2k`` letters is the rank of ``k`` followed
  by the least rank of ``k`` among the nodes where a least audit of ``k`` letters ends.
* Each node's next node is the target of its least (initial, final rank). Pointers of
  2, 4, 8, ... steps are made from it by doubling, and the least path is read through them.

Spark gathers and judges the rows; Python sees one letter a row, in Arrow batches.

Defined cases: a null role, text, turn or id counts as one space in texts and damage; null
ids are one conversation with a null id; rows are ordered by turn (nulls first), then
role, then text; repeated rows are duplicates of their first; the initial of an empty role
is empty; an empty table gives no rows; other columns are not looked at, whatever their
names. A conversation is one value of the result, so it has to fit into a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What edits cost, and a truncated row that stays.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
# The grammar of initials as a state machine.
MOVES = {
    "start": {"s": "system", "u": "user"},
    "system": {"u": "user"},
    "user": {"a": "assistant"},
    "assistant": {"u": "user"},
}
FINAL = ("start", "assistant")
MADE = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"

STATES = list(MOVES)
EDITS = "cost long, audit string, edits array<struct<edit: string, at: int, role: string>>"
# Rows whose graphs are ranked together.
RANKED_ROWS = 20_000


def row_arcs(code: str) -> list[list[tuple[int, int, str, str | None]]]:
    """For each state the edits of a row: ``(cost, next state, initial, new role)``.

    ``code`` is ``x`` for a row that must go, else its role's initial, in upper case if
    truncated; an initial that the grammar doesn't have is ``-``, or ``=`` if truncated.
    """
    extra = TRUNCATED if code.isupper() or code == "=" else 0
    out = []
    for number, state in enumerate(STATES):
        arcs = [(COSTS["D"], number, "D", None)]
        if code != "x":
            for initial, then in MOVES[state].items():
                if initial == code.lower():
                    arcs.append((COSTS["K"] + extra, STATES.index(then), "K", None))
                if initial in MADE:
                    arcs.append((COSTS["R"] + extra, STATES.index(then), "R", MADE[initial]))
        out.append(arcs)
    return out


CODES = {code: row_arcs(code) for code in "xsuaSUA-="}
INSERTS = [
    [(COSTS["I"], STATES.index(then), "I", MADE[x]) for x, then in MOVES[s].items() if x in MADE]
    for s in STATES
]
INITIALS = {letter: rank for rank, letter in enumerate(sorted(COSTS), start=1)}


def costs_to_go(codes: str) -> list[list[int]]:
    """Cost from every node to the end; one list of states per row, and one after the last."""
    after = [0 if s in FINAL else 10**9 for s in STATES]
    layers = []
    for code in [None, *reversed(codes)]:
        if code is None:
            cost = after
        else:
            cost = [min(c + after[to] for c, to, _, _ in arcs) for arcs in CODES[code]]
        changed = True
        while changed:  # insertions stay in the layer; they cost, so this ends
            new = [
                min(own, *(c + cost[to] for c, to, _, _ in arcs))
                for own, arcs in zip(cost, INSERTS, strict=True)
            ]
            changed, cost = new != cost, new
        layers.append(cost)
        after = cost
    return layers[::-1]


def optimal_arcs(codes: str, costs: list[list[int]], first: int) -> list[tuple]:
    """``(node, target, initial, row, role)`` of every arc on a cheapest path; 0 is the end."""
    n = len(STATES)
    arcs = []
    for at, layer in enumerate(costs):
        for state, cost in enumerate(layer):
            node = first + at * n + state
            if at < len(codes):
                for c, to, edit, role in CODES[codes[at]][state]:
                    if c + costs[at + 1][to] == cost:
                        arcs.append((node, first + (at + 1) * n + to, INITIALS[edit], at, role))
            for c, to, edit, role in INSERTS[state]:
                if c + layer[to] == cost:
                    arcs.append((node, first + at * n + to, INITIALS[edit], None, role))
            if cost == 0 and at == len(codes):
                arcs.append((node, 0, 0, None, None))
    return arcs


def audit_ranks(source: np.ndarray, target: np.ndarray, letter: np.ndarray, longest: int) -> np.ndarray:
    """Rank of every node's least audit among all nodes; arcs are sorted by ``source``.

    Node 0 is the end and has an arc to itself, with the least letter. Every node has arcs.
    """
    starts = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
    rank = np.minimum.reduceat(letter, starts)
    kept = letter == rank[source]
    source, target = source[kept], target[kept]
    steps = 1
    while steps < longest:
        starts = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
        sizes = np.diff(np.append(starts, len(source)))
        then = np.minimum.reduceat(rank[target], starts)
        kept = rank[target] == then[source]
        # Where the audits of twice as many letters end: at the ends of the kept ends.
        source, middle = source[kept], target[kept]
        counts = sizes[middle]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        ends = target[np.repeat(starts[middle], counts) + within]
        pairs = np.unique(np.repeat(source, counts) * np.int64(len(rank)) + ends)
        _, rank = np.unique(rank * np.int64(len(rank) + 8) + then, return_inverse=True)
        source, target = np.divmod(pairs, np.int64(len(rank)))
        steps *= 2
    return rank


def repair_codes(conversations: list[str]) -> list[dict]:
    """Cost, audit and edits of every conversation, given one letter a row."""
    n = len(STATES)
    arcs, firsts, costs, first = [(0, 0, 0, None, None)], [], [], 1
    for codes in conversations:
        layers = costs_to_go(codes)
        arcs += optimal_arcs(codes, layers, first)
        firsts.append(first)
        costs.append(layers[0][0])
        first += n * len(layers)
    # An audit takes a letter for every row and no more insertions than its cost allows.
    lengths = [len(c) + cost // COSTS["I"] + 1 for c, cost in zip(conversations, costs, strict=True)]
    arcs.sort(key=lambda a: a[0])
    source, target, letter = (np.array([a[i] for a in arcs], np.int64) for i in range(3))
    rank = audit_ranks(source, target, letter, max(lengths, default=1))
    order = np.lexsort((rank[target], letter, source))
    least = order[np.flatnonzero(np.append(True, source[order][1:] != source[order][:-1]))]
    jumps = [target[least]]
    while 2 ** len(jumps) < max(lengths, default=1):
        jumps.append(jumps[-1][jumps[-1]])
    out = []
    for start, cost, length in zip(firsts, costs, lengths, strict=True):
        path = np.array([start])
        for jump in jumps:
            if len(path) >= length:
                break
            path = np.append(path, jump[path])
        chosen = [arcs[i] for i in least[path[path > 0]].tolist()]
        edits = [
            {"edit": "DIKR"[initial - 1], "at": at, "role": role}
            for _, _, initial, at, role in chosen
            if initial
        ]
        out.append({"cost": cost, "audit": "".join(e["edit"] for e in edits), "edits": edits})
    return out


def least_edits(codes: pa.Array) -> pa.Array:
    """The repair of every conversation; graphs of bounded size are ranked together."""
    done, block, held = [], [], 0
    for value in codes.to_pylist():
        block.append(value)
        held += len(value) + 1
        if held >= RANKED_ROWS:
            done += repair_codes(block)
            block, held = [], 0
    done += repair_codes(block)
    edit = pa.struct([("edit", pa.string()), ("at", pa.int32()), ("role", pa.string())])
    kind = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(edit))])
    return pa.array(done, kind)


def row_codes(turns: Column) -> Column:
    """One letter a row: what ``row_arcs`` reads."""

    def code(t: Column) -> Column:
        known = F.when(t["initial"].isin("s", "u", "a"), t["initial"])
        truncated = F.coalesce(F.upper(known), F.lit("="))
        return (
            F.when(t["fault"].isin("blank", "duplicate"), "x")
            .when(t["fault"] == "truncated", truncated)
            .otherwise(F.coalesce(known, F.lit("-")))
        )

    return F.array_join(F.transform(turns, code), "")


def repair_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """``(conv, turns, cost, audit, edits, repaired, gaps, blank, duplicate, truncated, illegal)``.

    ``turns`` are the rows with their faults, ``repaired`` is ``array<struct<role, text>>``.
    Rows that are not ``present`` only name their conversation. Rows are shuffled once.
    """
    present = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    given = rows.select(
        F.col(conv_col).alias("conv"),
        present.alias("present"),
        F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"),
    )
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    given = given.withColumn("mark", mark).repartition("conv")
    earlier = Window.partitionBy("conv", "present", "mark").orderBy("turn")
    seen = F.row_number().over(earlier) > 1
    body = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(body == "", "blank")
        .when(seen, "duplicate")
        .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    row = F.struct("turn", "role", "text", fault.alias("fault"), F.left("role", F.lit(1)).alias("initial"))
    # Rows that are not present are null here, and not collected.
    judged = given.select("conv", F.when(F.col("present"), row).alias("row"))
    chats = judged.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    chats = chats.withColumn("least", F.arrow_udf(least_edits, EDITS)(row_codes(F.col("turns"))))

    def count(name: str) -> Column:
        return F.size(F.filter("turns", lambda t: t["fault"] == name)).cast("long").alias(name)

    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda x: x.isNotNull())
    initials = F.transform("turns", lambda t: t["initial"])
    last = F.greatest(F.size("turns") - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(initials, F.lit(1), last), F.slice(initials, F.lit(2), last), lambda a, b: F.concat(a, b)
    )
    kept = F.filter("least.edits", lambda e: e["edit"] != "D")
    repaired = F.transform(
        kept,
        lambda e: F.struct(
            F.coalesce(e["role"], F.get("turns", e["at"])["role"]).alias("role"),
            F.coalesce(F.get("turns", e["at"])["text"], F.lit("")).alias("text"),
        ),
    )
    span = F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))
    return chats.select(
        F.col("conv").alias(conv_col),
        "turns",
        "least.cost",
        "least.audit",
        "least.edits",
        repaired.alias("repaired"),
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        count("blank"),
        count("duplicate"),
        count("truncated"),
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, present)``: rows with reproducible faults, for trials.

    ``crc32`` of id and turn, modulo 20: 0 drops the row (it stays with ``present``
    false), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 sets its role.
    """
    named = F.concat_ws(
        ":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    )
    kind = F.crc32(named.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def repair_report(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts, cost and audit of every conversation, and a digest of the repaired one."""
    said = F.array_join(
        F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"
    )
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return repaired.select(conv_col, *counts, F.sha2(said, 256).alias("repaired_sha256"))
