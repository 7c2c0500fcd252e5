"""Operator 4: quality rules from the fertility of public tokenisers.

Every word is cut by two public vocabularies: a sentence-piece one with byte fallback and a
byte-level one. Characters per token, the share of byte-fallback tokens and the entropy of the tokens
of a text are measured; histograms of all texts by language or script give bands, and texts outside are
rejected. Words of a batch are numbered, so tokens, repeats and entropies are counted in numpy.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.text import encoded, map_rows
from tarnish.session import stage

# The symbols that the rule counts.
SYMBOLS = b"#*$%&|<>"
MEASURES = ("chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy")
# Lowest and highest value of the scale on which a measure is binned: logarithms of the first two, shares as they are.
SCALES = ((-2.0, 3.0), (-2.0, 3.0), (0.0, 1.0), (0.0, 1.0))
BINS = 2500
LEAST = (0.03, 0.03, 0.05, 0.05)  # the least reach of a band on its scale
CACHE = 200_000
WORD_BITS = 21  # three word numbers below fit a 64-bit number
OWNER_BITS = 32
LANGUAGE = re.compile(r"[a-z]{2,3}")


# The scripts that the first byte of a character in UTF-8 tells apart.
SCRIPTS = {
    "latin": (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)), "greek": (0xCE, 0xCF), "cyrillic": range(0xD0, 0xD4),
    "hebrew": (0xD6, 0xD7), "arabic": range(0xD8, 0xDC), "indic": (0xE0,), "kana": (0xE3,), "han": range(0xE4, 0xEA), "hangul": range(0xEA, 0xEE),
    "other": (0xE1, 0xE2, *range(0xF0, 0xF5)),
}


def script_of(data: bytes) -> str:
    """The script that most letters of a text belong to; `latin` without any."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return max(SCRIPTS, key=lambda s: int(counts[list(SCRIPTS[s])].sum()))


class Vocabularies:
    """Numbers for words, and the tokens of each word by both vocabularies; emptied between batches when full."""

    def __init__(self, piece_path: str, ranks_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.size = self.pieces.get_piece_size()
        self.is_fallback = np.array([self.pieces.is_byte(k) for k in range(self.size)])
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.first = np.zeros(1, np.int64)  # where the pieces of each word start
        self.flat = np.zeros(0, np.int64)
        self.fallback = np.zeros(0, np.int64)
        self.level = np.zeros(0, np.int64)

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The numbers of the words of each text; new words are cut by both vocabularies."""
        if len(self.number) > CACHE:
            self._clear()
        number = self.number
        new = list({w for words in texts for w in words if w not in number})
        if new:
            plain = [w.decode() for w in new]
            cut = self.pieces.encode(plain, num_threads=1)
            level = np.array([len(self.encode(" " + w)) for w in plain], np.int64)
            lengths = np.array([len(c) for c in cut], np.int64)
            flat = np.fromiter((i for c in cut for i in c), np.int64, int(lengths.sum()))
            ends = np.concatenate([[0], np.cumsum(self.is_fallback[flat])])
            stops = np.cumsum(lengths)
            for k, w in enumerate(new, len(number)):
                number[w] = k
            self.first = np.concatenate([self.first, self.first[-1] + stops])
            self.flat = np.concatenate([self.flat, flat])
            self.fallback = np.concatenate([self.fallback, ends[stops] - ends[stops - lengths]])
            self.level = np.concatenate([self.level, level])
        return [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]


def base_counts(data: bytes, words: np.ndarray) -> tuple[int, int, int, int]:
    """Characters in words, symbols, repeated lines, words in windows of three that come again; `words` are numbers."""
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    chars = len(data.translate(None, bytes(range(0x80, 0xC0)))) - spaces
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    repeated = 0
    if b"\n" in data:
        lines = [line for line in data.split(b"\n") if line and not line.isspace()]
        repeated = len(lines) - len(set(lines))
    covered = 0
    if len(words) > 2:
        if words.max() >> WORD_BITS:  # more words than fit: number those of this text first, then pairs of them
            words = np.unique(words, return_inverse=True)[1]
            pairs = np.unique((words[:-1] << 31) | words[1:], return_inverse=True)[1]
            windows = (pairs[:-1] << 31) | words[2:]
        else:
            windows = (words[:-2] << 2 * WORD_BITS) | (words[1:-1] << WORD_BITS) | words[2:]
        order = np.sort(windows)
        if (order[1:] == order[:-1]).any():
            often = np.isin(windows, order[1:][order[1:] == order[:-1]])
            marks = np.zeros(len(words), bool)
            for k in range(3):
                marks[k : len(words) - 2 + k] |= often
            covered = int(marks.sum())
    return chars, symbols, repeated, covered


def measures(texts: list[np.ndarray], chars: np.ndarray, tokens: Vocabularies) -> np.ndarray:
    """One row for each text: characters per token of both vocabularies, byte-fallback share, entropy of pieces over its maximum."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    words = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    # Each different word of a text once, with its number of places.
    key, places = np.unique((owner << OWNER_BITS) | words, return_counts=True)
    owner, words = key >> OWNER_BITS, key & (1 << OWNER_BITS) - 1
    count = lambda of: np.bincount(owner, of * places, len(texts))
    lengths = tokens.first[words + 1] - tokens.first[words]
    pieces, fallback, level = count(lengths), count(tokens.fallback[words]), count(tokens.level[words])
    each = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(each)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + tokens.first[words][each]
    by_piece, back = np.unique(owner[each] * tokens.size + tokens.flat[at], return_inverse=True)
    n = np.bincount(back, places[each], len(by_piece))
    share = n / pieces[by_piece // tokens.size]
    entropy = np.bincount(by_piece // tokens.size, -share * np.log(share), len(texts))
    many = pieces > 1
    entropy = np.where(many, np.minimum(entropy / np.log(np.where(many, pieces, 2)), 1.0), 1.0)
    one = lambda x: np.maximum(x, 1)
    return np.stack([chars / one(pieces), chars / one(level), fallback / one(pieces), entropy], 1)


def tokenizer_rules(
    docs: DataFrame,
    piece_path: str,
    ranks_path: str,
    pattern: str,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    spread: float = 2.5,
    prior_texts: int = 20,
) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, measures, base_failed, kept).

    Words lie between ASCII white space. `base_failed`: fewer than `min_words` words, or more than
    `max_repeat_percent` of them in windows of three that occur again. `kept` is false if that holds, or
    if a measure lies outside the band of the text's group: `spread` times the distance between the
    quartiles beyond them, characters per token on a logarithmic scale. So junk in under a quarter of a group's texts
    cannot take the band to itself. A group is a language (column `lang`; two or three letters), else the
    script of most letters. The quartiles of a language weigh those of its script as `prior_texts` texts of
    its own, so a rare language has the band of its script and a common one its own, without a switch.
    Texts that fail the base rules do not count for bands. A null or empty text has no words and fails.
    Repeated rows are judged each for itself; an empty table gives an empty table.
    """
    names = {c.lower() for c in docs.columns}
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in names else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))
    counted = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "

    def make():
        tokens = Vocabularies(piece_path, ranks_path, pattern)
        columns = [c.split()[0] for c in counted.strip(", ").split(", ")]

        def work(batch):
            texts = [encoded(t) for t in batch["text"]]
            words = tokens.numbers([t.split() for t in texts])
            base = [base_counts(t, w) for t, w in zip(texts, words, strict=True)]
            measured = measures(words, np.array([b[0] for b in base]), tokens)
            langs = [code.lower() if LANGUAGE.fullmatch(code.lower()) else "" for code in batch["lang"]]
            out = [batch["doc_id"], langs, [script_of(t) for t in texts], [len(w) for w in words], *map(list, zip(*base, strict=True))]
            return dict(zip(columns, out, strict=True)) | {m: measured[:, k].tolist() for k, m in enumerate(MEASURES)}

        return work

    table = stage(map_rows(rows, make, counted + ", ".join(f"{m} double" for m in MEASURES), 500))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    table = table.withColumn("base_failed", failed)
    limits = bands(table.filter("not base_failed"), spread, prior_texts)
    everything = [(-np.inf, np.inf)] * len(MEASURES)

    def judge(batches):
        for batch in batches:
            inside = ~batch["base_failed"].to_numpy(bool)
            bounds = [limits.get(code or script, everything) for code, script in zip(batch["lang"], batch["script"], strict=True)]
            for k, name in enumerate(MEASURES):
                value = scaled(batch[name].to_numpy(float), k)
                inside &= (value >= np.array([b[k][0] for b in bounds])) & (value <= np.array([b[k][1] for b in bounds]))
            yield batch.assign(kept=inside)

    judged = table.mapInPandas(judge, table.schema.simpleString()[7:-1].replace(":", " ") + ", kept boolean")
    return judged.drop("script")


def scaled(value: np.ndarray, k: int) -> np.ndarray:
    """Measure k on the scale of its bands."""
    low, high = SCALES[k]
    return np.clip(np.log(np.maximum(value, 1e-9)) if low < 0 else value, low, high)


def bands(table: DataFrame, spread: float, prior_texts: int) -> dict[str, list[tuple[float, float]]]:
    """By language and script: lowest and highest scaled value of each measure, from exact histograms.

    At most one row for each language, script, measure and bin comes to the driver: languages are two or
    three letters, so there are under 19,000 of them.
    """
    cells = []
    for k, m in enumerate(MEASURES):
        low, high = SCALES[k]
        value = F.log(F.greatest(F.col(m), F.lit(1e-9))) if low < 0 else F.col(m)
        place = F.least(F.greatest(F.floor((value - low) / (high - low) * BINS), F.lit(0)), F.lit(BINS - 1))
        cells.append(F.struct(F.lit(k).alias("measure"), place.cast("int").alias("bin")))
    counts = table.select("lang", "script", F.explode(F.array(*cells)).alias("c")).groupBy("lang", "script", "c.measure", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    grid: dict[str, np.ndarray] = {}
    home: dict[str, dict[str, int]] = {}
    for r in counts.collect():
        for group in {r["lang"] or r["script"], r["script"]}:
            grid.setdefault(group, np.zeros((len(MEASURES), BINS)))[r["measure"], r["bin"]] += r["n"]
        if r["lang"] and r["measure"] == 0:
            scripts = home.setdefault(r["lang"], {})
            scripts[r["script"]] = scripts.get(r["script"], 0) + r["n"]
    limits = {}
    for group, own in grid.items():
        prior = grid[max(home[group], key=lambda s: (home[group][s], s))] if group in home else own
        limits[group] = [band(own[k], prior[k], k, spread, prior_texts) for k in range(len(MEASURES))]
    return limits


def quartiles(histogram: np.ndarray) -> np.ndarray:
    """Lower end of the bin of the first quartile, upper end of the bin of the third, in bins."""
    total = histogram.cumsum()
    return np.array([np.searchsorted(total, max(0.25 * total[-1], 0.5)), np.searchsorted(total, max(0.75 * total[-1], 0.5)) + 1], float)


def band(own: np.ndarray, prior: np.ndarray, k: int, spread: float, prior_texts: int) -> tuple[float, float]:
    """`spread` quartile distances beyond the quartiles, no less than the measure's least reach."""
    n = own.sum()
    low, high = (n * quartiles(own) + prior_texts * quartiles(prior)) / (n + prior_texts)
    start, stop = SCALES[k]
    step = (stop - start) / BINS
    reach = max(spread * (high - low) * step, LEAST[k])
    return start + low * step - reach, start + high * step + reach
