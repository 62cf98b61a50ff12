"""Held-out accuracy of the three classifiers, their splits and odd inputs."""

import random
import zlib

import numpy as np
import pytest

from cladewise.llm import language, quality, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def test_quality_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    out = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    assert all(r["held_out"] == held(i, 4, 2) for i, r in out.items())
    own = [i for i in y if held(i, 4, 2)]
    assert np.mean([out[i]["predicted"] == y[i] for i in own]) > 0.93


def test_language_on_held_out_rows(spark, corpus):
    docs, _ = corpus
    out = language.identify(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    own = [r for r in out if r["held_out"]]
    assert len(out) == len(lang) and np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in own]) > 0.97


def test_inserted_and_gapped_insults(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    insults = ["vexorum", "grudwit", "slimbock"]
    rows, marks = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if i % 5 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(insults))
        rows.append((i, " ".join(text) + "."))
        marks.append((i, int(i % 5 == 0)))
    tests = ["v.e.x.o.r.u.m", "g r u d w i t", "slimxbock", "VEXORUM!", "grudwiit", " ".join("ikjhvexorumaaponmlkjihgfedcbagrep")]
    rows += [(10_000 + k, f"{words[0]} {t} {words[1]}") for k, t in enumerate(tests)] + [(20_000, None), (20_001, ""), (20_002, " ".join(words[:60]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity.classify(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    own = [i for i, _ in marks if held(i, 3, 1)]
    assert np.mean([out[i]["predicted"] == int(i % 5 == 0) for i in own]) > 0.98
    assert [out[10_000 + k]["predicted"] for k in range(len(tests))] == [1] * len(tests)
    assert [out[20_000 + k]["predicted"] for k in range(3)] == [0, 0, 0]


def test_kernel_bound_hides_nothing():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdé.") for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    table = toxicity.kernel_table(words[:40])
    memory = toxicity._Memory(table)
    codes, direct = memory.look(words), toxicity.kernel(words, table)
    seen = memory.values[codes >> 2]
    alike = np.array([w.strip(toxicity._SIGNS).isalpha() or not w.strip(toxicity._SIGNS) for w in words])
    assert np.allclose(seen[alike], direct[alike], atol=1e-5)


def test_kernel_equals_the_plain_subsequence_kernel():
    """All triples of letters in order within ``SPAN`` places, weighted by the places they skip."""

    def triples(word):
        word, found = word.strip(toxicity._SIGNS), {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    t = tuple(int(toxicity._symbols()[ord(c)]) for c in (word[i], word[j], word[k]))
                    found[t] = found.get(t, 0) + toxicity.DECAY ** (k - i - 2)
        return found

    def plain(a, b):
        x, y = triples(a), triples(b)
        norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        value = sum(v * y.get(t, 0) for t, v in x.items()) / norm if norm else 0
        return value**toxicity.DEGREE if value >= toxicity.LEAST_LIKE else 0

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdé.x") for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    table = toxicity.kernel_table(words[:20])
    expected = np.array([[plain(w, l) for l in words[:20]] for w in words])
    assert np.allclose(toxicity.kernel(words, table), expected, atol=1e-4)


@pytest.mark.parametrize("run", [quality.classify, toxicity.classify])
def test_without_labels_or_rows(spark, run):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = run(docs, labels).collect()
    assert len(out) == 2 and all(0 <= r["score"] <= 1 for r in out)
    assert run(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("run", [quality.classify, toxicity.classify])
def test_repeated_rows_and_other_columns(spark, run):
    """Each row has its own result, equal for equal texts, whatever other columns are called."""
    rows = [(i, f"word{i % 7} other{i % 5} text {'bad' if i % 2 else 'good'}", 9, "x") for i in range(40)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, toxic string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    out = run(docs, labels).collect()
    assert len(out) == 160 and len({(r["doc_id"], r["score"]) for r in out}) == 40


def test_filter_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", 5, 6) for i in range(4)], "doc_id long, text string, score int, score_ int")
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and [tuple(r)[2:] for r in kept.collect()] == [(5, 6)] * 4


def test_language_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "123 !?", "en", 1), (3, "the house of letters", "en", 1), (4, "das ist ein haus", None, 1)], "doc_id long, text string, lang string, score int")
    out = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == "und" and out[1]["score"] == 0
    assert language.identify(docs.limit(0)).count() == 0
