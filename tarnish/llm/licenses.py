"""Operator 9: license scan by an exact set-similarity join of text blocks with license templates.

Templates are the query set and are small; all text blocks stream past them. Words are put in one
global order, rarest first, by how many documents of the corpus hold them. If a block shares enough
words with a template then it shares one of the template's first, rare ones (prefix filter); a block
must be long enough (length filter), and from the place of the first shared word enough words must be
left (position filter). What passes is counted exactly. Short notices of different licenses share most of
their words, so of the templates found a block is labelled by those whose deciding words it has.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.text import alnum_words, encoded, map_rows, without

# Phrases that name a license, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Sentences of notices and licenses as their publishers print them, and their labels.
TEMPLATES = (
    ("agpl", "licensed under the GNU Affero General Public License, version 3"),
    ("all-rights-reserved", "Copyright. All rights reserved. No part of this work may be reproduced without permission"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc0", "CC0 1.0 Universal public domain dedication"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")
BLOCK = "array<struct<label:string,line:int,first:int,words:int,containment:double>>"


class TemplateIndex:
    """Templates with their words in the global order, and an index of their prefixes."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.threshold = threshold
        self.rank = {w: k for k, w in enumerate(sorted({w for _, t in templates for w in alnum_words(t)}, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates: list[tuple[str, frozenset[bytes], int]] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for label, text in templates:
            words = sorted(set(alnum_words(text)), key=self.rank.__getitem__)
            if not words:
                continue
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            for place, word in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(word, []).append((len(self.templates), place))
            self.templates.append((label, frozenset(words), need))
        self.deciding = [self._deciding(k) for k in range(len(self.templates))]

    def _deciding(self, k: int) -> tuple[frozenset[bytes], int]:
        """Words of a template that tell it from templates of other labels, and how many of them a block needs.

        Where the words of another template would do for this one, all that it has besides them are needed. If
        no more than two words are used by its own label alone, they name the license and are needed too;
        of more of them the threshold's share is.
        """
        label, words, need = self.templates[k]
        others = [w for name, w, _ in self.templates if name != label]
        own = words - frozenset().union(*others)
        told = frozenset().union(*(words - w for w in others if len(words & w) >= need))
        if told or len(own) <= 2:
            return told | (own if len(own) <= 2 else frozenset()), len(told | (own if len(own) <= 2 else frozenset()))
        return own, math.ceil(self.threshold * len(own) - 1e-9)

    def decide(self, block: list[bytes]) -> list[tuple[str, float]]:
        """Of the templates that the block holds, those whose deciding words it has too.

        A template goes if all its words, or all but words that every notice may use, are in another found
        template that has deciding words of its own.
        """
        words = set(block)
        found = [(k, share) for k, share in self._search(block) if len(words & self.deciding[k][0]) >= self.deciding[k][1]]
        out = []
        for k, share in found:
            label, mine, _ = self.templates[k]
            rivals = [j for j, _ in found if self.templates[j][0] != label]
            inside = any(mine < self.templates[j][1] for j in rivals)
            nameless = not self.deciding[k][0] and any(
                self.deciding[j][0] and len(mine & self.templates[j][1]) >= (2 * self.threshold - 1) * len(mine) for j in rivals
            )
            if not inside and not nameless:
                out.append((label, share))
        return out

    def search(self, block: list[bytes]) -> list[tuple[str, float]]:
        """Every template of which the block holds at least the threshold's share: (label, share)."""
        return [(self.templates[k][0], share) for k, share in self._search(block)]

    def _search(self, block: list[bytes]) -> list[tuple[int, float]]:
        words = set(block)
        known = sorted((w for w in words if w in self.rank), key=self.rank.__getitem__)
        found, seen = [], set()
        for at, word in enumerate(known):
            for k, place in self.prefix.get(word, ()):
                if k in seen:
                    continue
                seen.add(k)
                _, template, need = self.templates[k]
                # Words before this place are rarer; none of the template's is in the block, or the
                # template had been seen. So at most what follows here, on both sides, can be shared.
                if len(words) >= need and min(len(template) - place, len(known) - at) >= need:
                    shared = len(template & words)
                    if shared >= need:
                        found.append((k, shared / len(template)))
        return found


def places(words: list[bytes], present: set[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    """Where the words of a phrase stand one after the other."""
    if not present.issuperset(phrase):
        return []
    n, found, at = len(phrase), [], -1
    rare = min(range(n), key=lambda k: words.count(phrase[k]))
    try:
        while True:
            at = words.index(phrase[rare], at + 1)
            if at >= rare and tuple(words[at - rare : at - rare + n]) == phrase:
                found.append(at - rare)
    except ValueError:
        return found


def _document_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many texts each template word is; at most one row for each of them leaves a batch."""

    def make():
        def work(rows):
            counts = Counter(w for t in rows["text"] if t for w in vocabulary.intersection(alnum_words(t)))
            return {"word": [w.decode() for w in counts], "n": list(counts.values())}

        return work

    counted = map_rows(docs.select("text"), make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = 0.8,
    window: int | None = None,
    max_template_words: int = 100_000,
    with_text: bool = True,
) -> DataFrame:
    """`docs` with the license phrases and the template matches of every text.

    Added: `n_words`; `n_base`, the places where a phrase stands; `first_word` and `last_word`, its
    smallest and largest start, else null; `base_labels`, the labels of found phrases, and `labels`
    with those of templates too, both distinct, sorted and comma-joined; `score`, 1 with a phrase,
    else the largest share of a template that a block holds, 0 without a match; `blocks`, the matches.
    A block is a line, or for longer lines each window of `window` words (64, or twice the longest template
    if that is more), a new one every half window;
    the words of the whole text are cut into such windows too (`line` is null for them, and `first`
    counts from the start of the text), so that notices wrapped over lines are found. So each template
    of up to half a window lies whole in some block. A block matches if it holds at
    least `threshold` of a template's different words and those that tell the license from its likes. Null and empty texts have no words. Repeated
    rows are scanned each for itself; an empty table gives an empty table; columns named like the
    added ones are replaced. Templates of over `max_template_words` words in all are refused.
    """
    window = window or max(64, 2 * max((len(alnum_words(t)) for _, t in templates), default=0))
    vocabulary = frozenset(w for _, t in templates for w in alnum_words(t))
    if sum(len(t.split()) for _, t in templates) > max_template_words:
        raise ValueError("too many template words for one index")
    rows = without(docs, ADDED)
    index = TemplateIndex(templates, _document_frequency(rows, vocabulary), threshold)
    base = [(tuple(alnum_words(p)), label) for p, label in phrases]
    kinds = ("long", "long", "long", "long", "string", "string", "double", BLOCK)
    carried = [c for c in rows.columns if with_text or c != "text"]
    target = rows.withColumns({c: F.lit(None).cast(k) for c, k in zip(ADDED, kinds, strict=True)})
    schema = target.select(*[F.col(f"`{c}`") for c in carried], *ADDED).schema

    def make():
        def work(columns):
            n = len(columns["text"])
            out = {c: columns[c] for c in carried} | {c: [None] * n for c in ADDED}
            for k, text in enumerate(columns["text"]):
                words = alnum_words(text)
                present = set(words)
                starts, labels = [], set()
                for phrase, label in base:
                    if at := places(words, present, phrase):
                        starts += at
                        labels.add(label)
                blocks = _match(index, text, window) if not index.prefix.keys().isdisjoint(present) else []
                out["n_words"][k], out["n_base"][k] = len(words), len(starts)
                out["first_word"][k], out["last_word"][k] = (min(starts), max(starts)) if starts else (None, None)
                out["base_labels"][k] = ",".join(sorted(labels))
                out["labels"][k] = ",".join(sorted(labels | {b["label"] for b in blocks}))
                out["score"][k] = 1.0 if starts else max((b["containment"] for b in blocks), default=0.0)
                out["blocks"][k] = blocks
            return out

        return work

    return map_rows(rows, make, schema)


def _match(index: TemplateIndex, text: str, window: int) -> list[dict]:
    lines = [alnum_words(line) for line in encoded(text).decode().split("\n")]
    # The text as a whole comes last; where one line has all words, its windows are those of the text.
    parts = list(enumerate(lines))
    if sum(map(bool, lines)) > 1:
        parts.append((None, [w for words in lines for w in words]))
    found = []
    for number, words in parts:
        for first in range(0, max(1, len(words) - window // 2), window // 2):
            block = words[first : first + window]
            for label, share in index.decide(block):
                found.append({"label": label, "line": number, "first": first, "words": len(block), "containment": share})
    return found
