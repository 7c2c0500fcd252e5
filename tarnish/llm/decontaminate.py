"""Operator 6: benchmark decontamination with a generalised suffix automaton over words.

The benchmark is the query set. It is cut into blocks of bounded size; each block becomes one
automaton that every task builds from a broadcast of that block's words, and all documents stream
through it. Several blocks are several passes over the same row, without a shuffle in between.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.text import alnum_words, map_rows, without

ADDED = ("n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated", "clean_text")
MASK = (1 << 20) - 1


class SuffixAutomaton:
    """All substrings of several word sequences, with the items that hold each window of `window` words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        own: dict[int, set[str]] = {}
        whole: dict[int, set[str]] = {}
        pairs: set[int] = set()
        self.shortest = min((min(window, len(words)) for _, words in items), default=window)
        for item, words in items:
            state, path = 0, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            for word in path:
                state = self._extend(state, word)
                own.setdefault(state, set()).add(item)
            if len(path) < window:
                whole.setdefault(state, set()).add(item)
            pairs.update(zip(path, path[1:], strict=False))
        self.bitmap = np.zeros(MASK + 1, bool)
        for a, b in pairs:
            self.bitmap[(a * 1_000_003 + b) & MASK] = True
        self._collect(own, whole)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if (known := nxt[last].get(word)) is not None:
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        new = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            known = nxt[at][word]
            link[new] = known if length[known] == length[at] + 1 else self._split(at, word, known)
        return new

    def _split(self, at: int, word: int, known: int) -> int:
        copy = len(self.len)
        self.next.append(dict(self.next[known]))
        self.len.append(self.len[at] + 1)
        self.link.append(self.link[known])
        self.link[known] = copy
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _collect(self, own: dict[int, set[str]], whole: dict[int, set[str]]) -> None:
        """Items behind each state that stands for a window; short items that end at each state."""
        n, window = len(self.len), self.window
        # The state of a match's last `window` words: the ancestor whose lengths include `window`.
        self.state_of_window = [-1] * n
        self.holders: dict[int, set[str]] = {}
        self.ends: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * n
        for state in sorted(range(n), key=self.len.__getitem__):
            if state == 0:
                continue
            up = self.link[state]
            if self.len[state] >= window:
                self.state_of_window[state] = state if self.len[up] < window else self.state_of_window[up]
            self.ends[state] = self.ends[up]
            if state in whole:
                self.ends[state] += ((self.len[state], frozenset(whole[state])),)
        for state, items in own.items():
            # Every state on the way up to the window's state ends at the same place.
            if (target := self.state_of_window[state]) >= 0:
                self.holders.setdefault(target, set()).update(items)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [from, to) of words inside any occurring window, and the items that have one."""
        n = len(words)
        if n < self.shortest or not self.ids:
            return [], set()
        get = self.ids.get
        path = np.fromiter((get(w, 0) for w in words), np.int64, n)
        # Long matches need item words, and item pairs of words, all the way; others are passed over.
        if self.shortest > 1:
            good = self.bitmap[(path[:-1] * 1_000_003 + path[1:]) & MASK] & (path[:-1] > 0) & (path[1:] > 0)
        else:
            good = path > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2] + (self.shortest > 1)
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for start, stop in zip(starts, stops, strict=True):
            if stop - start >= self.shortest:
                self._stream(path[start:stop].tolist(), int(start), spans, found)
        return merged(spans), found

    def _stream(self, path: list[int], start: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        nxt, link, length, window = self.next, self.link, self.len, self.window
        state = matched = 0
        for i, word in enumerate(path, start + 1):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if (to := nxt[state].get(word)) is None:
                state = matched = 0
                continue
            state, matched = to, matched + 1
            if matched >= window:
                spans.append((i - window, i))
                found |= self.holders[self.state_of_window[state]]
            for size, items in self.ends[state]:
                if size <= matched:
                    spans.append((i - size, i))
                    found |= items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the characters from the first to the last word of each span."""
    places = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*kept, text[at:]])


_built: dict[str, SuffixAutomaton] = {}


def blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The benchmark in parts of about `block_words` words: the most that one automaton has to hold."""
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), "text"
    )
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / (6 * block_words)))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    words_per_hit: int = 20,
    block_words: int = 200_000,
    with_text: bool = True,
) -> DataFrame:
    """`docs` with what of them occurs in `benchmark` (item_id, text).

    Words are lower-case runs of letters and digits. A window is `window` consecutive words of an
    item, or a whole shorter item. Added: `n_words`; `n_hit`, the words inside any occurrence of a
    window; `n_items` and `item_ids` (text, sorted), the items whose windows occur; `spans`, the hit
    word ranges; `contaminated`, whether there is at least one hit word in `words_per_hit` words;
    `clean_text`, the text without its hit spans. Null texts are empty: no words, not contaminated.
    Items without an id or a word are ignored, repeated items count once by id. An empty benchmark
    finds nothing, an empty table gives an empty table. Columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    out = without(docs, ADDED)
    span = "array<struct<first:int,stop:int>>"
    fields = out.schema
    out = out.withColumns({"n_words": F.lit(None).cast("long"), "spans": F.lit(None).cast(span), "item_ids": F.lit(None).cast("array<string>"), "clean_text": F.lit(None).cast("string")})
    schema = out.schema
    parts = blocks(benchmark, block_words)
    for number, part in enumerate(parts):
        items = [(r["item_id"], words) for r in part.collect() if (words := alnum_words(r["text"]))]
        out = map_rows(out, _pass(spark.sparkContext.broadcast(items), window, number == len(parts) - 1), schema)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["first"]))
    ids = F.array_sort(F.array_distinct("item_ids"))
    out = out.withColumns({"n_hit": hits, "item_ids": ids}).withColumns(
        {"n_items": F.size("item_ids").cast("long"), "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * words_per_hit >= F.col("n_words"))}
    )
    names = [f.name for f in fields if with_text or f.name != "text"]
    return out.select(*[F.col(f"`{c}`") for c in names], *[c for c in ADDED if with_text or c != "clean_text"])


def _pass(shared, window: int, last: bool):
    key = uuid.uuid4().hex

    def make():
        if key not in _built:
            _built.clear()
            _built[key] = SuffixAutomaton(shared.value, window)
        automaton = _built[key]

        def work(rows):
            for k, text in enumerate(rows["text"]):
                words = alnum_words(text)
                spans, found = automaton.match(words)
                spans = merged(spans + [(s["first"], s["stop"]) for s in rows["spans"][k] or ()])
                rows["n_words"][k] = len(words)
                rows["spans"][k] = [{"first": a, "stop": b} for a, b in spans]
                rows["item_ids"][k] = [*found, *(rows["item_ids"][k] or ())]
                if last:
                    rows["clean_text"][k] = remove_spans(text, spans) if spans else text
            return rows

        return work

    return make
