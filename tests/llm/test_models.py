"""Trained operators: exact parts against plain Python, learned parts by held-out accuracy and odd rows."""

import math
import random
import re
from itertools import product

import numpy as np
import pytest

from tarnish.llm.fertility import BINS, Vocabularies, band, measures, script_of, tokenizer_rules
from tarnish.llm.frequent import least_count, most_frequent
from tarnish.llm.gram import summed
from tarnish.llm import maxent
from tarnish.llm.maxent import CLASSES, Vocabulary, Weights, contexts, log_classes, score_texts, tokens
from tarnish.llm.quality import isotonic, score_quality, statistics
from tarnish.llm.toxicity import correlated, fit_toxicity, score_toxicity
from tarnish.llm.urls import SEEDS, Segmenter, host_of, judge_urls, path_of
from tests.llm import plain

public = pytest.importorskip("public_tokenizers")


def auc(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts of which some are junk and some hold insults, with labels for most of them."""
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for doc in range(400):
        text = rng.choices(words, k=rng.randint(40, 90))
        junk, toxic = rng.random() < 0.2, rng.random() < 0.15
        if junk:
            text = [w + rng.choice(("###", "$$$")) for w in text]
        if toxic:
            for word in rng.choices(["idiot", "scum", "qorvaal", "qorvast", "qorvink"], k=4):
                text.insert(rng.randrange(len(text)), word)
        docs.append((doc, " ".join(text)))
        labels.append((doc, int(not junk), int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "x" * 100_000), docs[0], (None, "null id")]
    labels += [(None, 1, 1), (5, None, None), labels[7], (99999, 1, 0)]
    return (
        spark.createDataFrame([(*d, "en", 2.0, 3) for d in docs], "doc_id long, text string, lang string, score double, held_out int").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        docs, labels,
    )


def held_out_pairs(got, labels, column, n, r):
    truth = {row[0]: row[column] for row in labels if row[0] is not None and row[column] is not None}
    for g in got:
        assert g["held_out"] == (plain.crc("" if g["doc_id"] is None else g["doc_id"], n) == r)
        assert 0 <= g["score"] <= 1 and not math.isnan(g["score"])
    return [(g["score"], truth[g["doc_id"]]) for g in got if g["held_out"] and g["doc_id"] in truth]


def test_quality(labelled, empty):
    docs, labels, made, truth = labelled
    got = score_quality(docs, labels).collect()
    assert len(got) == len(made) and all(g["predicted"] == (g["score"] >= 0.3) for g in got)
    assert auc(held_out_pairs(got, truth, 1, 5, 0)) > 0.95
    assert score_quality(empty, labels).count() == 0


def test_quality_without_labels(labelled):
    docs, labels, made, _ = labelled
    assert {r["score"] for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in score_quality(docs, labels.filter("quality = 1")).collect()} == {1.0}


def test_held_out_labels_do_not_matter(spark, labelled):
    docs, labels, _, truth = labelled
    turned = [(d, 1 - q if q is not None and d is not None and plain.crc(d, 5) == 0 else q) for d, q, _ in truth]
    a = score_quality(docs, labels)
    b = score_quality(docs, spark.createDataFrame(turned, "doc_id long, quality int"))
    order = lambda df: sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in df.collect())
    assert order(a) == order(b)


def test_isotonic():
    places, shares = isotonic(np.array([1.0, 1, 0, 2, 1]), np.array([0.0, 1, 0, 1, 1]))
    assert shares.tolist() == [0.0, 2 / 3, 1.0] and (np.diff(places) > 0).all()
    assert all(map(math.isfinite, statistics(None) + statistics("") + statistics("a" * 10**6)))


def test_toxicity(labelled, empty):
    docs, labels, made, truth = labelled
    got = score_toxicity(docs, labels).collect()
    assert len(got) == len(made) and all(g["predicted"] == (g["score"] >= 0.7) for g in got)
    pairs = held_out_pairs(got, truth, 2, 3, 1)
    assert auc(pairs) > 0.97 and sum((s >= 0.7) != bool(y) for s, y in pairs) <= 3
    assert score_toxicity(empty, labels).count() == 0
    assert score_toxicity(docs, labels.limit(0)).count() == len(made)


def test_toxicity_filter(labelled):
    docs, labels, _, _ = labelled
    model, _ = fit_toxicity(docs, labels)
    clean = sorted(r["doc_id"] or -1 for r in score_toxicity(docs, labels).filter("predicted = 0").collect())
    kept = model.keep_clean(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == clean


def test_repeated_voters_are_seen():
    same = np.array([[50.0, 50, 5], [50, 50, 5], [5, 5, 10]])
    assert correlated(same, 100).round(2).tolist() == [1.0, 1.0, 0.0]


def test_language_model(table, made, empty):
    got = {r["doc_id"]: r for r in score_texts(table, n_head=50).collect()}
    for doc, (n, known, total, base) in plain.base_scores(made).items():
        r = got[doc]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, plain.crc(doc, 10) == 0)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert score_texts(empty).count() == 0


def test_language_model_learns(spark):
    """Words that follow each other: the model beats the word counts on held-out texts by far."""
    rng = random.Random(7)
    groups = [[f"{c}{k}{e}" for k in range(20)] for c, e in (("a", "xxx"), ("b", "yyy"), ("c", "zzz"))]
    docs = []
    for doc in range(600):
        at = rng.randrange(3)
        text = []
        for _ in range(60):
            text.append(rng.choice(groups[at]))
            at = (at + 1) % 3
        docs.append((doc, " ".join(text)))
    got = [r for r in score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.25


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    vocabulary = Vocabulary([b""], ["abc"])
    words, starts = tokens(["one two abc", None, "two one"])
    ids = vocabulary(words)
    rows = contexts(vocabulary.hashes[ids], starts)
    assert (rows[:, 3] != rows[:, 4]).any() and (rows[:, 4] == rows[:, 5]).all() and len(words) == 8
    weights, bias = Weights(), rng.normal(size=CLASSES).astype(np.float32)
    bias -= np.log(np.exp(bias).sum())
    for part in weights.parts():
        part[:] = rng.normal(size=part.shape) / 9
    total = sum(10 ** log_classes(bias, weights, rows, np.full(rows.shape[1], c)) for c in range(CLASSES))
    assert np.allclose(total, 1, atol=1e-4)


def test_most_frequent(spark):
    counts = spark.createDataFrame([(str(k), k) for k in range(1, 200)], "word string, n long")
    assert set(most_frequent(counts, 10)) <= {str(k) for k in range(190, 200)} and len(most_frequent(counts, 10)) > 3
    assert least_count(counts, 1000) == 1 and most_frequent(counts.limit(0), 5) == {}


def test_sums_over_tasks(spark):
    df = spark.range(1000, numPartitions=7)
    got = summed(df, lambda b: {0: np.array([b["id"].sum(), len(b)], float)} if len(b) else {})
    assert got[0].tolist() == [499500, 1000] and summed(df.filter("id < 0"), lambda b: {}) == {}


URLS = [
    "http://x.net/a", "https://a.example.net/en/x?q", "http://example.com/de/", "http://badexample.com/de/", "http://org/fr/1", "HTTP://A.ORG/fr/2#z",
    "http://x.net", "http://x.org/en/", None, "", "no scheme", "a://b://c/d", "http://free-casino.example.com/x", "x://h\n/p\nq?z", "http://X.NET:80/a",
]
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def rule_for(host, path):
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len, default=None)


def test_urls(spark):
    pages = [(k, u, "<p>free casino example words<script>hidden</script></p>", "v") for k, u in enumerate(URLS)]
    pages += [pages[0], (None, "http://q.example.com/", None, "v")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")
    got = judge_urls(df).collect()
    assert len(got) == len(pages)
    for r in got:
        _, scheme, rest = (r["url"] or "").partition("://")
        host = re.split("[/?#]", rest)[0].translate(plain.FOLD) if scheme else ""
        path = re.split("[?#]", rest[len(host) :])[0] if scheme else ""
        rule = rule_for(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == RULES[rule] if rule else r["verdict"] in ("allow", "block")
    by = {r["url"]: r for r in got}
    assert by["http://free-casino.example.com/x"]["verdict"] == "block" and by["http://x.org/en/"]["verdict"] == "allow"
    assert judge_urls(df.limit(0)).count() == 0
    split = df.select(host_of(df.url), path_of(df.url)).count()
    assert split == len(pages)


def test_url_verdicts_do_not_depend_on_the_head(spark):
    """Rare words are joined, so a head of 3 words judges like one that holds all; company of seeds blocks."""
    rng = random.Random(2)
    plain_words = [f"{a}{b}" for a in ("garden", "river", "music", "school", "winter") for b in ("path", "stone", "book", "light")]
    urls = [f"http://{rng.choice(plain_words)}{rng.choice(plain_words)}.example.com/{rng.choice(plain_words)}" for _ in range(120)]
    urls += [f"http://casino{rng.choice(['velvet', 'diamond'])}.example.com/velvet/diamond{k}" for k in range(25)]
    urls += ["http://velvetdiamond.example.com/diamond/velvet/velvet", "http://gardenpath.example.com/riverstone"]
    html = " ".join(plain_words + ["velvet", "diamond", "casino", "garden", "path"])
    df = spark.createDataFrame([(k, u, html) for k, u in enumerate(urls)], "page_id long, url string, html string")
    few, many = ({r["page_id"]: r for r in judge_urls(df, max_words=n).collect()} for n in (3, 100_000))
    for k, r in many.items():
        assert (r["words"], r["verdict"]) == (few[k]["words"], few[k]["verdict"]) and r["log_odds"] == pytest.approx(few[k]["log_odds"])
    company, clean = many[len(urls) - 2], many[len(urls) - 1]
    assert company["verdict"] == "block" and not set(company["words"]) & set(SEEDS)
    assert clean["verdict"] == "allow" and sum(r["verdict"] == "block" for r in many.values()) == 26


def test_url_odds_by_plain_counts(spark):
    df = spark.createDataFrame([(k, f"http://{h}.test/", "free casino music river") for k, h in enumerate(["casino", "casinomusic", "river", "river", "music"])], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in judge_urls(df, seeds=("casino",)).collect()}
    words = [r["words"] for _, r in sorted(got.items())]
    bad, good = [w for ws in words if "casino" in ws for w in ws], [w for ws in words if "casino" not in ws for w in ws]
    size = len(set(bad + good)) + 2
    for k, ws in enumerate(words):
        want = math.log((2 + 1) / (3 + 1))
        for w in ws:
            want += math.log(0.5 * (bad.count(w) + 0.1) / (len(bad) + 0.1 * size) + 0.5 * (w == "casino"))
            want -= math.log((good.count(w) + 0.1) / (len(good) + 0.1 * size))
        assert got[k]["log_odds"] == pytest.approx(want)


def test_viterbi_finds_the_best_split():
    counts = {"ab": 20, "a": 5, "b": 3, "bc": 9, "c": 2, "abc": 1}
    segment = Segmenter(counts)
    for name in map("".join, product("abcz", repeat=4)):
        cost = lambda parts: sum(segment._log(p) for p in parts)
        splits = [[name[i:j] for i, j in zip((0, *cut), (*cut, 4), strict=True)] for n in range(4) for cut in _cuts(n)]
        assert cost(segment(name)) == pytest.approx(max(map(cost, splits)))


def _cuts(n):
    from itertools import combinations

    return combinations((1, 2, 3), n)


def test_tokenizer_rules(spark, table, made, empty):
    rules = lambda df, **k: tokenizer_rules(df, public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, **k)
    got = rules(table).collect()
    assert len(got) == len(made) and not any(r["kept"] and r["base_failed"] for r in got)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    normal = [(k, " ".join(random.Random(k).choices("the of and people water under house green letter small".split(), k=80)) + f" {k}", "en") for k in range(300)]
    strange = [(1000 + k, " ".join(chr(0x13000 + random.Random(j).randrange(900)) * 4 for j in range(60)), "en") for k in range(1)]
    out = {r["doc_id"]: r for r in rules(spark.createDataFrame(normal + strange, "doc_id long, text string, lang string"), max_repeat_percent=100).collect()}
    assert all(out[k]["kept"] for k, *_ in normal) and not out[1000]["kept"] and out[1000]["fallback_share"] > 0.5
    assert rules(empty).count() == 0


@pytest.mark.parametrize("percent", [1, 2, 5])
def test_junk_does_not_widen_its_band(percent):
    texts = 10_000
    values = np.zeros(BINS)
    values[0], values[int(0.94 * BINS)] = texts * (100 - percent) / 100, texts * percent / 100
    assert band(values, values, 2, 2.5, 20)[1] < 0.1
    lengths = np.bincount(np.clip(np.random.default_rng(1).normal(1400, 20, texts).astype(int), 0, BINS - 1), minlength=BINS).astype(float)
    lengths[1250] += texts * percent / 100
    low, high = band(lengths, lengths, 0, 2.5, 20)
    assert 1251 / BINS * 5 - 2 < low < 1340 / BINS * 5 - 2 and 1460 / BINS * 5 - 2 < high


def test_rare_languages_have_the_band_of_their_script():
    own, script = np.zeros(BINS), np.zeros(BINS)
    own[1000], script[1200], script[1400] = 1, 500, 500
    few = band(own, script, 0, 2.5, 20)
    assert few[0] < 1000 / BINS * 5 - 2 and few[1] > 1400 / BINS * 5 - 2
    widths = [np.diff(band(own * n, script, 0, 2.5, 20))[0] for n in (1, 10, 100, 10_000)]
    assert widths == sorted(widths, reverse=True)  # continuous in the number of texts
    assert [script_of(t.encode()) for t in ("abc ñ", "слово abc", "日本語", "", "\U00013000", "ελληνικά")] == ["latin", "cyrillic", "han", "latin", "other", "greek"]


def test_measures_are_those_of_whole_texts(made):
    """Numbered words and sums in numpy against counting the pieces of whole texts one by one."""
    from collections import Counter

    import sentencepiece

    tokens = Vocabularies(public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    texts = [" ".join(t.split()) for _, t in made if t and len(t) < 4000] + ["", "\U00013000\U00013001 x", "one"]
    for turn in range(2):
        words = tokens.numbers([t.encode().split() for t in texts])
        got = measures(words, np.array([sum(map(len, t.split())) for t in texts]), tokens)
        for text, row in zip(texts, got, strict=True):
            ids = model.encode(text)
            n, chars = len(ids), sum(map(len, text.split()))
            level = sum(len(tokens.encode(" " + w)) for w in text.split())
            share = [k / n for k in Counter(ids).values()]
            entropy = -sum(x * math.log(x) for x in share) / math.log(n) if n > 1 else 1.0
            want = (chars / max(1, n), chars / max(1, level), sum(model.is_byte(i) for i in ids) / max(1, n), entropy)
            assert row == pytest.approx(want)


def test_planted_junk_is_rejected(spark):
    words = "the of and people water under house green letter small river stone".split()
    normal = [(k, " ".join(random.Random(k).choices(words, k=80)) + f" {k}", "en") for k in range(2000)]
    junk = [(5000 + k, " ".join(chr(0x13000 + random.Random(60 * k + j).randrange(900)) * 4 for j in range(60)), "en") for k in range(60)]
    docs = spark.createDataFrame(normal + junk, "doc_id long, text string, lang string").repartition(4)
    rules = tokenizer_rules(docs, public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, max_repeat_percent=100)
    assert {r["doc_id"] for r in rules.collect() if r["kept"]} == set(range(2000))


def test_gradient_step_on_touched_rows():
    """Rows that no token of a chunk has stay as they are; the others get the step of the whole matrix."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(list(b"abcdef"), 2)) for _ in range(300)]
    vocabulary = Vocabulary([b"", b"ab"], ["cd"])
    ids = vocabulary(words)
    assert np.array_equal(ids, vocabulary(words)) and len(vocabulary.hashes) == len(set(words))
    rows = contexts(vocabulary.hashes[ids], np.array([0]))
    group = vocabulary.classes[ids] // maxent.IN_GROUP
    weights = Weights()
    assert weights.group.T.flags.c_contiguous and weights.inner.T.flags.c_contiguous
    trainer = maxent.Trainer(vocabulary, np.zeros(CLASSES, np.float32), weights, 0.25)
    want, squares = np.zeros((maxent.GROUPS, maxent.ROWS)), np.zeros(maxent.ROWS)
    for _ in range(2):
        error = np.exp(want[:, rows].sum(axis=1))
        error /= error.sum(axis=0)
        error[group, np.arange(len(group))] -= 1
        for start, size, r in zip(maxent.STARTS, maxent.SIZES, rows, strict=True):
            own = slice(start, start + size)
            gradient = np.stack([np.bincount(r - start, e, size) for e in error])
            squares[own] += np.square(gradient).mean(axis=0)
            want[:, own] -= 0.25 * gradient / np.sqrt(squares[own] + 1)
        trainer._step(weights.group, weights.group_squares, trainer.touched[0], np.zeros(maxent.GROUPS, np.float32), rows, group, 1)
    assert np.allclose(weights.group, want, atol=1e-4) and trainer.touched[0].sum() == 2 * 4 * len(words)
