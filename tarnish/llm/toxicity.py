"""Operator 5: toxicity by weak supervision.

Many voters look at a text: lexicon words and word beginnings mined from a bounded sample of labelled
rows, a seed lexicon, and patterns. A generative label model estimates from the votes on all texts,
mostly unlabelled, how accurate every voter is and which voters repeat each other, and gives each
text a posterior. A linear classifier over the votes and their density is then fitted to the posteriors.
The texts are read twice: once to mine the sample, once to vote; the rest works on vote patterns.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.gram import summed
from tarnish.llm.text import fold, map_rows
from tarnish.session import stage

# Words that are insults in any context, the seed lexicon.
SEEDS = (
    "asshole bastard bitch clown crap cretin damn disgusting dumb fool idiot imbecile jerk loser moron pathetic scum shit "
    "stupid trash ugly vermin worthless "
    "abschaum arschloch dummkopf scheisse trottel versager widerlich "
    "basura estúpido idiota imbécil maldito mierda "
    "abruti connard crétin débile merde salaud"
).split()
PREFIXES = (3, 4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
FLUSH = 50_000  # of a task: its memory stays with the worker, also for later stages
PATTERNS = 5  # voters on the whole text, after the lexicon voters


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_features(words: set[str]) -> set[str]:
    """Whole words (`=word`), beginnings of longer words (`^begin`) and of two or more of them (`2begin`)."""
    begins = Counter(w[:n] for n in PREFIXES for w in words if len(w) > n)
    found = {"=" + w for w in words if len(w) <= 32}
    found.update("^" + b for b in begins)
    found.update("2" + b for b, n in begins.items() if n > 1)
    return found


def mine(sample: DataFrame, size: int, least: int, precision: float) -> list[str]:
    """The word features that best mark label 1 in `sample` (text, y), none of them inside another."""

    def make():
        return _Counts()

    counts = map_rows(sample.select("text", "y"), make, "feature string, hits long, misses long", 200)
    counts = counts.groupBy("feature").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    share = (F.col("hits") + 0.5) / (F.col("hits") + F.col("misses") + 1)
    strong = counts.filter((F.col("hits") >= least) & (share >= precision))
    ranked = strong.withColumn("evidence", F.col("hits") * F.log(share / (1 - share)))
    ranked = ranked.orderBy(F.desc("evidence"), F.desc(F.length("feature")), "feature").limit(50 * size)
    chosen: list[str] = []
    for row in ranked.collect():
        word = row["feature"]
        # Of features of a kind that begin each other, the one with most evidence speaks for all.
        same = (c[1:] for c in chosen if (c[0] == "2") == (word[0] == "2"))
        if not any(word[1:].startswith(c) or c.startswith(word[1:]) for c in same):
            chosen.append(word)
        if len(chosen) == size:
            break
    return chosen


class _Counts:
    """Documents with and without the label by feature; partial counts leave when there are many."""

    def __init__(self):
        self.hits, self.misses = Counter(), Counter()

    def __call__(self, rows):
        for text, y in zip(rows["text"], rows["y"], strict=True):
            (self.hits if y >= 0.5 else self.misses).update(word_features(set(words_of(text))))
        return self.flush() if len(self.hits) + len(self.misses) > FLUSH else None

    def flush(self):
        names = list(self.hits.keys() | self.misses.keys())
        out = {"feature": names, "hits": [self.hits[n] for n in names], "misses": [self.misses[n] for n in names]}
        self.hits, self.misses = Counter(), Counter()
        return out


class Voters:
    """Counts of every lexicon voter in a text, and votes of the patterns."""

    def __init__(self, lexicon: list[str]):
        self.whole = {w[1:]: k for k, w in enumerate(lexicon) if w[0] == "="}
        self.begin = {w[1:]: k for k, w in enumerate(lexicon) if w[0] == "^"}
        self.twice = {w[1:]: k for k, w in enumerate(lexicon) if w[0] == "2"}
        self.seeds, self.n = set(SEEDS), len(lexicon)

    def __call__(self, text: str | None) -> tuple[list[int], float]:
        """Voters that fire, in order, and hits among 100 words."""
        words = words_of(text)
        fired: set[int] = set()
        hits = seeds = 0
        begun: Counter[int] = Counter()
        for word, n in Counter(words).items():
            found = {self.whole.get(word)}
            for k in PREFIXES:
                if len(word) > k:
                    found.add(self.begin.get(begin := word[:k]))
                    if (pair := self.twice.get(begin)) is not None:
                        begun[pair] += 1
            found.discard(None)
            fired |= found
            seeds += n * (word in self.seeds)
            hits += n * bool(found or word in self.seeds)
        fired.update(k for k, n in begun.items() if n > 1)
        density = 100 * hits / max(1, len(words))
        letters = sum(map(len, words))
        upper = sum(map(str.isupper, text)) if text and density else 0
        patterns = (seeds > 0, hits > 1, hits > 3, density >= 1, 2 * upper > letters > 0)
        return sorted(fired) + [self.n + k for k, p in enumerate(patterns) if p], density


def label_model(patterns: DataFrame, n_voters: int, prior: float, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """(weight if a voter fires, weight if not, prior log odds) of a generative model of the votes.

    Expectation-maximisation over `patterns` (votes, n), all different vote patterns with their
    number of texts. Voters are given their class, except for pairs that fire together within class 1
    more than chance would have it: a voter's evidence is divided by how many such voters it repeats.
    """
    fire = np.array([0.3 / 8, 0.002])  # firing shares in class 1 and 0 to start with: firing speaks for class 1
    rates = np.tile(fire[:, None], n_voters)
    share, repeats = prior, np.ones(n_voters)
    for _ in range(rounds):
        logs, offs = np.log(rates[0] / rates[1]) / repeats, np.log((1 - rates[0]) / (1 - rates[1])) / repeats
        bias = float(np.log(share / (1 - share)))

        def expect(batch: pd.DataFrame, logs=logs, offs=offs, bias=bias) -> dict[int, np.ndarray]:
            if not len(batch):
                return {}
            x, n = dense(batch["votes"], n_voters), batch["n"].to_numpy(float)
            p = posterior(x, logs, offs, bias)
            pair = (x * (n * p)[:, None]).T @ x
            return {0: np.vstack([pair, x.T @ (n * (1 - p)), np.full(n_voters, n @ p), np.full(n_voters, n.sum())])}

        got = summed(patterns, expect).get(0)
        if got is None:
            break
        pair, off, toxic, total = got[:n_voters], got[n_voters], got[n_voters + 1, 0], got[n_voters + 2, 0]
        rates = np.stack([(np.diag(pair) + 0.5) / (toxic + 1), (off + 0.02) / (total - toxic + 1)])
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        share = float(np.clip(toxic / max(total, 1), 1e-4, 0.5))
        repeats = 1 + correlated(pair, toxic)
    logs, offs = np.log(rates[0] / rates[1]) / repeats, np.log((1 - rates[0]) / (1 - rates[1])) / repeats
    return logs, offs, float(np.log(share / (1 - share)))


def correlated(pair: np.ndarray, toxic: float) -> np.ndarray:
    """For each voter the summed positive correlations with the others, given class 1."""
    p = np.clip(np.diag(pair) / max(toxic, 1e-9), 1e-9, 1 - 1e-9)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    phi = (pair / max(toxic, 1e-9) - np.outer(p, p)) / spread
    np.fill_diagonal(phi, 0)
    return np.where(phi > 0.3, np.minimum(phi, 1), 0).sum(axis=1)


def dense(votes: pd.Series, n_voters: int) -> np.ndarray:
    x = np.zeros((len(votes), n_voters))
    for k, fired in enumerate(votes):
        x[k, np.asarray(fired, int)] = 1
    return x


def posterior(x: np.ndarray, logs: np.ndarray, offs: np.ndarray, bias: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(bias + x @ logs + (1 - x) @ offs, -30, 30)))


def design(votes: pd.Series, density: pd.Series, n_voters: int) -> np.ndarray:
    """Constant, votes, and how dense and how many they are."""
    x = dense(votes, n_voters)
    extra = np.column_stack([np.log1p(density.to_numpy(float)), np.log1p(x.sum(axis=1))])
    return np.hstack([np.ones((len(x), 1)), x, extra])


class ToxicityModel:
    """Voters, label model and linear classifier; a few thousand numbers."""

    def __init__(self, lexicon: list[str], model: tuple[np.ndarray, np.ndarray, float], weights: np.ndarray):
        self.lexicon, self.model, self.weights = lexicon, model, weights
        self.n_voters = len(lexicon) + PATTERNS

    def scores(self, votes: pd.Series, density: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the classifier and of the label model."""
        x = design(votes, density.clip(upper=50).round(1), self.n_voters)
        value = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
        return value, posterior(x[:, 1 : 1 + self.n_voters], *self.model)

    def keep_clean(self, docs: DataFrame, threshold: float = 0.7) -> DataFrame:
        """The rows of `docs` whose text scores below `threshold`, as they are and in one pass."""

        def make():
            voters = Voters(self.lexicon)

            def work(rows):
                found = [voters(t) for t in rows["text"]]
                value, _ = self.scores(pd.Series([f[0] for f in found]), pd.Series([f[1] for f in found], dtype=float))
                clean = np.flatnonzero(value < threshold).tolist()
                return {c: [v[k] for k in clean] for c, v in rows.items()}

            return work

        return map_rows(docs, make, docs.schema)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out_fold: int = 1,
    n_folds: int = 3,
    max_labelled: int = 40_000,
    n_mined: int = 120,
    least: int = 4,
    precision: float = 0.6,
    newton_steps: int = 8,
) -> tuple[ToxicityModel, DataFrame]:
    """The model, and the votes on every row: (doc_id, votes, density, held_out); see `score_toxicity`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("y"))
    known = stage(known.filter(fold(F.col("doc_id"), n_folds) != held_out_fold))
    n_known, share = known.agg(F.count(F.lit(1)), F.avg("y")).first()
    keep = min(1.0, max_labelled / max(1, n_known))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(keep * (1 << 20)))
    # At most about `max_labelled` ids of 16 bytes: small enough to send to every task.
    sample = docs.join(F.broadcast(chosen), "doc_id")
    lexicon = mine(sample, n_mined, least, precision) if n_known else []
    lexicon += ["=" + s for s in SEEDS if "=" + s not in lexicon]
    n_voters = len(lexicon) + PATTERNS

    def make():
        voters = Voters(lexicon)

        def work(rows):
            found = [voters(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "votes": [f[0] for f in found], "density": [f[1] for f in found]}

        return work

    table = stage(map_rows(docs, make, "doc_id long, votes array<int>, density double"))
    table = table.withColumn("held_out", fold(F.col("doc_id"), n_folds) == held_out_fold)
    # Densities in steps, so that texts with the same votes can be counted together.
    steps = F.round(F.least("density", F.lit(50.0)), 1).alias("density")
    patterns = stage(table.filter("not held_out").groupBy("votes", steps).agg(F.count(F.lit(1)).alias("n")))
    prior = float(np.clip(share if share is not None else 0.05, 0.005, 0.5))
    model = label_model(patterns, n_voters, prior)
    return ToxicityModel(lexicon, model, _fit(patterns, n_voters, model, newton_steps)), table


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, label_model) for every row of `docs`.

    Voters are mined from labels (doc_id, toxic) outside the held-out fold, of at most about
    `max_labelled` documents chosen by a hash of their id; several labels of one document are averaged
    and null labels ignored. The label model and the classifier see the votes on all texts outside
    the held-out fold. Without usable labels only the seed lexicon and the patterns vote. Null and
    empty texts have no votes and are scored like any other. Repeated rows get the same score each;
    other columns are not used; an empty table gives an empty table.
    """
    model, table = fit_toxicity(docs, labels, **options)

    def score(batches):
        for batch in batches:
            value, posteriors = model.scores(batch["votes"], batch["density"])
            yield batch[["doc_id", "held_out"]].assign(score=value, predicted=(value >= threshold).astype(np.int32), label_model=posteriors)

    return table.mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int, label_model double")


def _fit(patterns: DataFrame, n_voters: int, model: tuple, steps: int, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression on the posteriors, by Newton steps over sums of all partitions."""
    size = n_voters + 3
    weights = np.zeros(size)
    for _ in range(steps):

        def products(batch: pd.DataFrame, weights=weights) -> dict[int, np.ndarray]:
            if not len(batch):
                return {}
            x, n = design(batch["votes"], batch["density"], n_voters), batch["n"].to_numpy(float)
            target = posterior(x[:, 1 : 1 + n_voters], *model)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            return {0: np.hstack([(x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x, (x.T @ (n * (target - p)))[:, None]])}

        got = summed(patterns, products).get(0)
        if got is None:
            break
        ridge = np.full(size, penalty)
        ridge[0] = 1e-6
        step = np.linalg.solve(got[:, :-1] + np.diag(ridge), got[:, -1] - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-3:
            break
    return weights
