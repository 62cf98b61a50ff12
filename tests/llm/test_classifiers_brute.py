"""The classifiers' numbers by plain loops over words and letters, and very long texts."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cladewise.llm import language, quality, toxicity

TEXTS = [
    None, "", "  ", "a", "The house, the house of letters!", "das ist ein haus; ein haus", "x" * 50, "la casa de papel 123 la casa", "!!! ??? 42", "ñandú über naïve ñandú", "one two\none two\n" * 30,
]


def test_word_vectors_by_loops(spark):
    """Each word adds the index vectors of up to two neighbours on each side, texts apart."""
    docs = spark.createDataFrame([(t,) for t in TEXTS * 2], "text string").repartition(3)
    places, signs = quality.index_places()
    total = defaultdict(lambda: np.zeros(quality.DIMENSIONS))
    for text in TEXTS * 2:
        w = [zlib.crc32(x.encode()) % quality.BUCKETS for x in re.findall(r"\w+|[^\w\s]+", text or "")]
        for i, own in enumerate(w):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(w):
                    for p in range(quality.PLACES):
                        total[own][places[p, w[j]]] += signs[p, w[j]]
    plain = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for b, v in total.items():
        plain[b] = v / max(np.linalg.norm(v), 1e-9)
    seen = plain.any(1)
    plain[seen] -= plain[seen].mean(0)
    plain /= np.maximum(np.linalg.norm(plain, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(docs), plain, atol=1e-4)


def test_quality_scores_by_loops(spark):
    """Pooling and the two layers, word by word and unit by unit."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("ba", "du", "ki") if i % 2 else ("zz", "9", "zz")) for _ in range(rng.randrange(1, 40)))) for i in range(200)] + [(1000 + k, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vectors, model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, vectors, model).collect()}
    for i, text in rows:
        w = [zlib.crc32(x.encode()) % quality.BUCKETS for x in re.findall(r"\w+|[^\w\s]+", text or "")]
        x = np.zeros(2 * quality.DIMENSIONS + 3)
        if w:
            n = len(w)
            mean = sum(vectors[b].astype(float) for b in w) / n
            spread = np.sqrt(np.maximum(sum(vectors[b].astype(float) ** 2 for b in w) / n - mean**2, 0))
            sure, share = n / (n + 8), np.array(list(Counter(w).values())) / n
            repeats = sum(a == b for a, b in zip(w, w[1:])) / (n - 1) if n > 1 else 0
            x = np.concatenate([sure * mean, sure * spread, [sure * np.sqrt((share**2).sum()), sure * repeats, np.log1p(n)]])
        z = np.clip((x - model["mu"]) / model["sd"], -6, 6)
        hidden = [np.tanh(sum(z[j] * model["a"][j, u] for j in range(len(z))) + model["b"][u]) for u in range(quality.HIDDEN)]
        logit = sum(h * c for h, c in zip(hidden, model["c"], strict=True)) + model["d"][0]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-logit / model["temperature"])), abs=2e-3)


def test_language_bundles_by_loops(spark):
    """Trigrams of letters: the product of the letters' vectors, each rotated by its place, summed and scaled."""
    one, table = np.random.default_rng(language.SEED).choice(np.array([-1, 1], np.int8), (language.SYMBOLS, language.DIMENSIONS)), language.symbols()

    def bundle(text):
        runs = re.split(r"0+", "".join(chr(int(table[ord(c)]) + 0x100) if table[ord(c)] else "0" for c in text or ""))
        letters = [ord(c) - 0x100 if c != " " else 0 for c in " " + " ".join(r for r in runs if r) + " "] if any(runs) else []
        total = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            total += np.roll(one[a], 2).astype(float) * np.roll(one[b], 1) * one[c]
        return total / (np.linalg.norm(total) or 1)

    for text, got in zip(TEXTS, language.bundles(TEXTS), strict=True):
        assert np.allclose(got, bundle(text), atol=1e-4)
    docs = spark.createDataFrame([(i, t, "de" if t and "haus" in t else "xx") for i, t in enumerate(TEXTS)] * 3, "doc_id long, text string, lang string")
    prototypes = language.fit_prototypes(docs)
    sums = {k: sum(bundle(t) for t in TEXTS if ("haus" in (t or "")) == (k == "de")) for k in ("de", "xx")}
    unit = lambda v: v / np.linalg.norm(v)
    mean = (unit(sums["de"]) + unit(sums["xx"])) / 2
    for k, v in sums.items():
        assert np.allclose(prototypes[k], unit(unit(v) - 0.5 * mean), atol=1e-3)
    out = language.identify(docs).collect()
    assert len(out) == 3 * len(TEXTS) and len({(r["doc_id"], r["lang_pred"], r["score"]) for r in out}) == len(TEXTS)


@pytest.mark.parametrize("run", [quality.classify, toxicity.classify])
def test_very_long_texts(spark, run):
    rng = random.Random(2)
    long = [" ".join(rng.choice(("ba", "du", "ki", "lo")) for _ in range(200_000)), "x" * 500_000, "\n".join("!?" for _ in range(100_000)), "a b " * 100_000]
    rows = [(i, f"word{i % 7} {'bad' if i % 2 else 'good'}") for i in range(40)] + [(100 + k, t) for k, t in enumerate(long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["score"] for r in run(docs, labels).collect()}
    assert len(out) == 44 and all(0 <= x <= 1 for x in out.values())


def test_language_of_a_very_long_text(spark):
    rows = [(i, "the house of letters and the other" if i % 2 else "das ist ein haus und noch eines", "en" if i % 2 else "de") for i in range(20)]
    rows += [(100, "the house of letters and the other " * 20_000, None), (101, "0" * 400_000, None)]
    out = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[100] == "en" and out[101] == "und"
