"""Operator 3: cost-balanced packing of tokenised documents into sequences.

Every task tokenises its documents and packs them in blocks of bounded size, so nothing is shuffled
and only lengths and token ids of one block are held. Documents longer than a sequence fill whole
sequences; what is left of them and all shorter documents are dealt, longest first, to the sequence
with the lowest estimated cost that still has room.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnish.llm.text import map_rows

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
        T.StructField("cost", T.DoubleType()),
    ]
)
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


class Tokenizer:
    """Byte-level BPE ids of a text as little-endian 32-bit numbers.

    Special tokens are cut out first and stand for their own ids. Texts are encoded whole: a cache of words
    costs more than the words that it saves, and memory besides.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = {word: np.array([number], "<u4").tobytes() for word, number in (special or {}).items()}
        # Of two that start at one place the longer one counts.
        self.cuts = re.compile("(" + "|".join(re.escape(w) for w in sorted(self.special, key=len, reverse=True)) + ")") if special else None

    def ids(self, text: str) -> bytes:
        if self.cuts and any(word in text for word in self.special):
            return b"".join(self.special.get(part) or self._ids(part) for part in self.cuts.split(text) if part)
        return self._ids(text)

    def _ids(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()


def special_tokens(tokenizer_path: str) -> dict[str, int]:
    """Words that a tokenizer file adds to its vocabulary, with their ids."""
    with open(tokenizer_path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file).get("added_tokens", ())}


def deal(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of at most `size` tokens.

    Longest first, each goes whole to the lowest-cost sequence with room for it; where none has, it is
    cut to fill the lowest-cost sequences with any room. There are just enough sequences for all tokens.
    """
    total = int(lengths.sum())
    n = -(-total // size)
    cost, room, used, pieces = np.zeros(n), np.full(n, size), np.zeros(n, int), []
    if n:
        room[n - 1] = total - (n - 1) * size  # the remainder: all other sequences become full
    for k in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[k])
        while left:
            fits = room >= left
            s = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            take = min(left, int(room[s]))
            pieces.append((k, start, take, s, int(used[s])))
            room[s] -= take
            used[s] += take
            cost[s] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return pieces


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    end_id: int = 0,
    size: int = 1024,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    block_docs: int = 8192,
    with_ids: bool = False,
    special: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of `size` tokens; `ids` with `with_ids`.

    A document is the ids of its text, where words of `special` stand for their ids, then `end_id`; a null text is empty, so it is `end_id` alone.
    Each id lies in one piece; pieces of a sequence follow each other from offset 0. `cost` is the
    piece's estimated cost, linear plus quadratic in its length. All sequences are full but at most
    one for each block of `block_docs` documents of a task. Repeated rows are packed each for itself,
    a null doc_id stays null, other columns are not used. An empty table gives an empty table.
    """
    schema = T.StructType([*PIECE.fields, IDS]) if with_ids else PIECE
    make = lambda: _Packer(Tokenizer(ranks_path, pattern, special), end_id, size, linear, quadratic, block_docs, with_ids)
    return map_rows(docs.select("doc_id", "text"), make, schema, 500)


class _Packer:
    def __init__(self, tokenizer, end_id, size, linear, quadratic, block_docs, with_ids):
        self.tokenizer, self.size, self.block_docs, self.with_ids = tokenizer, size, block_docs, with_ids
        self.end, self.weights = np.array([end_id], "<u4").tobytes(), (linear, quadratic)
        self.next = TaskContext.get().partitionId() << 32
        self.tails: list[tuple[int | None, int, int, bytes]] = []  # document, tokens before, tokens in all, ids

    def __call__(self, rows):
        out: list[tuple] = []
        for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
            ids = (self.tokenizer.ids(text) if text else b"") + self.end
            total = len(ids) // 4
            full = total - total % self.size
            for start in range(0, full, self.size):
                self._add(out, doc, start, ids[4 * start : 4 * (start + self.size)], total, self.next, 0)
                self.next += 1
            if total > full:
                self.tails.append((doc, full, total, ids[4 * full :]))
        if len(self.tails) >= self.block_docs:
            self._deal(out)
        return self._columns(out)

    def flush(self):
        out: list[tuple] = []
        self._deal(out)
        return self._columns(out)

    def _deal(self, out):
        lengths = np.array([len(t[3]) // 4 for t in self.tails], int)
        last = -1
        for k, start, length, sequence, offset in deal(lengths, self.size, *self.weights):
            doc, before, total, ids = self.tails[k]
            self._add(out, doc, before + start, ids[4 * start : 4 * (start + length)], total, self.next + sequence, offset)
            last = max(last, sequence)
        self.next += last + 1
        self.tails = []

    def _add(self, out, doc, start, ids, total, sequence, offset):
        n = len(ids) // 4
        cost = self.weights[0] * n + self.weights[1] * n * n
        out.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, cost, np.frombuffer(ids, "<u4") if self.with_ids else None))

    def _columns(self, out):
        names = [f.name for f in PIECE] + ["ids"]
        return dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else None
