"""URL filter: allow and block rules in a trie over reversed host labels and path segments.

A rule ``(host, path, verdict)`` fits a URL whose host is the rule's host or a subdomain
of it and whose path starts with the rule's path. The longest fitting rule (host and
path characters together, then the longer host) decides; of an allow and a block rule
that are equal, block decides.

Defined cases: a null URL or one without ``://`` has an empty host and path; a URL that
no rule fits gets ``default`` and a null rule; rules with a null are left out; repeated
rows stay repeated rows; columns other than the kept ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from visitorlens.llm.common import ascii_lower, blocks_of, column_types, map_rows

# Characters of rules in one broadcast trie; more rules are judged in several passes.
BLOCK_CHARS = 8_000_000

# A trie node is [children by key, what hangs at the node].
Node = list


def split_url(url: str | None) -> tuple[str, str]:
    """``(host, path)``: host between ``://`` and the next of ``/?#``, path up to ``?`` or ``#``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    rest = rest.split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return ascii_lower(host), slash + path


def build_trie(rules: Iterable[tuple[str, str, str]]) -> Node:
    """Host trie from the last label on; a host node holds a path trie.

    All but the last segment of a rule's path must equal the URL's segments and are
    edges; the last one may be the beginning of a segment and is kept at the node.
    """
    root: Node = [{}, None]
    for host, path, verdict in rules:
        host = ascii_lower(host)
        node = root
        for label in reversed(host.split(".")):
            node = node[0].setdefault(label, [{}, None])
        if node[1] is None:
            node[1] = [{}, {}]
        *whole, beginning = path.split("/")
        place = node[1]
        for segment in whole:
            place = place[0].setdefault(segment, [{}, {}])
        if place[1].get(beginning, ("", ""))[1] != "block":
            place[1][beginning] = (host + path, verdict)
    return root


def longest_match(trie: Node, host: str, path: str) -> tuple[int, int, str, str] | None:
    """``(length, host length, rule, verdict)`` of the longest fitting rule."""
    best = None
    segments = path.split("/")
    node, matched = trie, -1
    for label in reversed(host.split(".")):
        node = node[0].get(label)
        if node is None:
            break
        matched += len(label) + 1
        place = node[1]
        for segment in segments:
            if place is None:
                break
            ends = place[1]
            for end in range(min(len(segment), max(map(len, ends), default=-1)), -1, -1):
                found = ends.get(segment[:end])
                if found:
                    best = max(best or (0, 0), (len(found[0]), matched, *found))
                    break
            place = place[0].get(segment)
    return best


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    keep: Sequence[str] = ("page_id",),
    default: str = "allow",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(*keep, host, path, rule, verdict)`` per row of ``pages``.

    ``rules`` has ``host, path, verdict``. The driver holds one block of ``block_chars``
    at a time; every block is one more narrow pass over the URLs, which keeps the best
    rule so far, so any number of rules gives the same result.
    """
    context = pages.sparkSession.sparkContext
    keys = list(keep)
    schema = column_types(pages, keys) + ", host string, path string, rule string, verdict string"

    def first():
        return lambda *row: [(*row[:-1], *split_url(row[-1]), None, None)]

    judged = map_rows(pages.select(*keys, url_col), first, schema)
    wanted = rules.select("host", "path", "verdict").dropna().toLocalIterator()
    for block in blocks_of(wanted, lambda r: len(r.host) + len(r.path), block_chars):
        trie = context.broadcast(build_trie(map(tuple, block)))

        def better(trie=trie):
            def judge(*row):
                *kept, host, path, rule, verdict = row
                best = longest_match(trie.value, host, path)
                if best and rule is not None:
                    # The rule so far: its host ends at the first slash, or at its end.
                    before = (len(rule), len(rule.partition("/")[0]), rule, verdict)
                    best = max(best, before)
                return [(*kept, host, path, *best[2:])] if best else [row]

            return judge

        judged = map_rows(judged, better, schema)
    return judged.fillna({"verdict": default})
