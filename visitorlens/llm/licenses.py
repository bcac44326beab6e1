"""License scan: exact set-similarity join between text blocks and license templates.

The *blocks* of a template of ``n`` words are all runs of ``n`` words and a stated slack that
stand one after another in the text, across line ends (``block_words``). A block *meets*
the template when it holds at least ``threshold`` of its distinct words; scattered words
do not. All such pairs are found, with the filters of a prefix join:

* words are ordered globally by the number of documents that hold them, rarest first;
* prefix: to reach the overlap ``o``, a block must hold one of the template's
  ``size - o + 1`` rarest words, so only blocks around such a word are looked at;
* length: where fewer than ``o`` template words stand around it, no block can reach it;
* position: the rarest word around it bounds the overlap by what follows it in the order.

What is left is counted by one walk over the template's words around the prefix words.

Beside that, the places of given phrases are counted exactly.

Defined cases: a null text is an empty one: no words, no labels, score 0; repeated rows
stay repeated; ties in document frequency are ordered by the word; an empty table gives
no rows; columns other than the two named are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitorlens.llm.common import column_types, map_rows

# Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Notices that licenses ask to be put into a work, by label.
TEMPLATES = {
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the"
    " terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification,"
    " are permitted provided that the following conditions are met",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0"
    " International License",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-program-notice": "This program is free software: you can redistribute it and/or modify it"
    " under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose"
    " with or without fee is hereby granted, provided that the above copyright notice and this"
    " permission notice appear in all copies",
    "mit-notice": "Released under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy"
    " of this software and associated documentation files, to deal in the software without"
    " restriction, including without limitation the rights to use, copy, modify, merge, publish,"
    " distribute, sublicense, and/or sell copies of the software",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License,"
    " v. 2.0. If a copy of the MPL was not distributed with this file",
}
THRESHOLD = 0.8

# Bytes outside words become spaces, A-Z become a-z; bytes of letters beyond ASCII are word
# characters.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words (runs of ASCII letters and digits and of all other code points)."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def block_words(template_words: int) -> int:
    """Words of a block: those of the template and a quarter more, one at least."""
    return template_words + max(1, template_words // 4)


@dataclass
class TemplateIndex:
    """Templates as word lists in the global order, and their prefixes."""

    labels: list[str]
    order: list[dict[bytes, int]]  # place of each distinct word of a template in the order
    need: list[int]
    span: list[int]
    prefixes: dict[bytes, list[int]]  # prefix word -> templates

    @classmethod
    def build(
        cls, templates: Mapping[str, str], frequency: Mapping[bytes, int], threshold: float
    ) -> TemplateIndex:
        labels = sorted(templates)
        lists = [words_of(templates[label]) for label in labels]
        ordered = [sorted(set(words), key=lambda w: (frequency.get(w, 0), w)) for words in lists]
        # A tolerance keeps 0.8 * 5 from becoming more than 4.
        need = [max(1, math.ceil(threshold * len(words) - 1e-9)) for words in ordered]
        prefixes: dict[bytes, list[int]] = {}
        for t, words in enumerate(ordered):
            for word in words[: len(words) - need[t] + 1]:
                prefixes.setdefault(word, []).append(t)
        order = [{w: at for at, w in enumerate(words)} for words in ordered]
        return cls(labels, order, need, [block_words(len(words)) for words in lists], prefixes)

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Best containment by label over all blocks that meet the label's template."""
        marked: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            for t in self.prefixes.get(word, ()):
                marked.setdefault(t, []).append(at)
        best = {}
        for t, places in marked.items():
            common = max(self.overlap(words, t, *ends) for ends in around(places, self.span[t], len(words)))
            if common >= self.need[t]:
                best[self.labels[t]] = common / len(self.order[t])
        return best

    def overlap(self, words: list[bytes], t: int, begin: int, end: int) -> int:
        """Most distinct words of template ``t`` in any of its blocks between two places.

        0 if the length or the position filter shows that no block can have enough.
        """
        order, need, span = self.order[t], self.need[t], self.span[t]
        found = [(at, w) for at, w in enumerate(words[begin:end], begin) if w in order]
        present = {w for _, w in found}
        if min(len(present), len(order) - min(map(order.__getitem__, present))) < need:
            return 0
        held: Counter[bytes] = Counter()
        best = first = distinct = 0
        for at, word in found:
            distinct += not held[word]
            held[word] += 1
            while found[first][0] <= at - span:
                held[found[first][1]] -= 1
                distinct -= not held[found[first][1]]
                first += 1
            best = max(best, distinct)
        return best


def around(places: list[int], span: int, n: int) -> Iterable[tuple[int, int]]:
    """The parts of a text of ``n`` words that blocks around some places lie in, put together."""
    begin = end = None
    for at in places:
        if end is not None and at - span + 1 > end:
            yield begin, end
            begin = None
        begin = max(0, at - span + 1) if begin is None else begin
        end = min(n, at + span)
    if begin is not None:
        yield begin, end


def phrase_places(words: list[bytes], phrases: Sequence[tuple[list[bytes], str]]) -> list[tuple]:
    """``(start, label)`` of every place where a phrase's words stand one after another."""
    places = []
    present = set(words)
    for phrase, label in phrases:
        if not present.issuperset(phrase):
            continue
        at = -1
        for _ in range(words.count(phrase[-1])):
            at = words.index(phrase[-1], at + 1)
            start = at - len(phrase) + 1
            if start >= 0 and words[start : at + 1] == phrase:
                places.append((start, label))
    return places


def word_frequency(docs: DataFrame, text_col: str, vocabulary: Iterable[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a small ``vocabulary`` stands, over all documents."""
    wanted = frozenset(vocabulary)

    def start() -> Callable:
        return lambda text: [(w.decode(),) for w in wanted.intersection(words_of(text))]

    found = map_rows(docs.select(text_col), start, "word string")
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.word.encode(): r.n for r in counted}


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(id, n_words, places array<start, label>, notices array<label, containment>)`` per row.

    The templates are passed by the caller as a mapping, so what is sent to the tasks is
    as large as that mapping, not as the corpus.
    """
    vocabulary = {w for text in templates.values() for w in words_of(text)}
    index = TemplateIndex.build(templates, word_frequency(docs, text_col, vocabulary), threshold)
    split = [(words_of(phrase), label) for phrase, label in phrases]

    def start() -> Callable:
        marks = index.prefixes.keys()

        def scan(key, text):
            words = words_of(text)
            notices = {} if marks.isdisjoint(words) else index.matches(words)
            return [(key, len(words), sorted(phrase_places(words, split)), sorted(notices.items()))]

        return scan

    schema = (
        column_types(docs, [id_col]) + ", n_words long,"
        " places array<struct<start: long, label: string>>,"
        " notices array<struct<label: string, containment: double>>"
    )
    return map_rows(docs.select(id_col, text_col), start, schema)


def license_report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of counts, labels and the best containment for each scanned row."""
    base = F.sort_array(F.array_distinct(F.transform("places", lambda p: p["label"])))
    notices = F.transform("notices", lambda n: n["label"])
    starts = F.transform("places", lambda p: p["start"])
    return scanned.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, notices)), ",").alias("labels"),
        F.coalesce(
            F.array_max(F.transform("notices", lambda n: n["containment"])), F.lit(0.0)
        ).alias("score"),
    )
