"""Exact substring removal against a dictionary of all strings of the least size."""

import hashlib
from collections import defaultdict

import numpy as np

from cladewise.llm import substrings


def brute(texts, least):
    where = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - least + 1):
            where[t[i : i + least]].append((d, i))
    covered = [np.zeros(len(t), bool) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                covered[d][i : i + least] = True
    return covered


def compare(spark, texts, **parameters):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    out = {r["doc_id"]: r for r in substrings.remove_repeats(docs, **parameters).collect()}
    raw = [(t or "").encode() for t in texts]
    assert len(out) == len(texts)
    for d, (t, c) in enumerate(zip(raw, brute(raw, parameters.get("least", 400)), strict=True)):
        runs = int((np.diff(np.concatenate(([0], c.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~c])
        r = out[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(t), int(c.sum()), runs), d
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def texts(seed=0, n=60):
    rng = np.random.default_rng(seed)
    base = "".join(rng.choice(list("abcdé"), 6000))
    out = []
    for _ in range(n):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            if rng.random() < 0.5:
                a = int(rng.integers(0, 5000))
                parts.append(base[a : a + int(rng.integers(30, 900))])
            else:
                parts.append("".join(rng.choice(list("abcdefghij klmn"), int(rng.integers(1, 700)))))
        out.append("".join(parts))
    return [*out, out[3], out[5], None, "", "x" * 1000, "ab" * 500, out[7][:400], "a" * 399, "🙂" * 200]


def test_planted_passages(spark):
    compare(spark, texts())


def test_hot_anchors_in_blocks(spark):
    compare(spark, texts(1), least=40, gram=8, hot=3)


def test_corpus(spark, sf_dir):
    compare(spark, [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(empty).count() == 0
    twice = spark.createDataFrame([(None, "q" * 400), (None, "q" * 400), (None, "r" * 400)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substrings.remove_repeats(twice).collect()) == [0, 400, 400]


def test_repeated_rows_that_share_a_passage(spark):
    """A row for each row, whatever repeats and whichever ids are null."""
    rng = np.random.default_rng(5)
    a, b, shared = ("".join(rng.choice(list("abcdefgh "), k)) for k in (300, 200, 500))
    rows = [(1, a + shared), (1, a + shared), (2, shared + b), (None, a + shared), (None, b), (None, b), (3, b + "é" + shared)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out) == [
        (-1, 200, 0, 0), (-1, 200, 0, 0), (-1, 800, 800, 1), (1, 800, 800, 1), (1, 800, 800, 1), (2, 700, 500, 1), (3, 702, 500, 1),
    ]


def test_one_anchor_with_many_contexts_in_one_text(spark):
    """An anchor that a few texts have in many different places is dealt in blocks as well."""
    rng = np.random.default_rng(6)
    gram = "".join(rng.choice(list("abcdefgh"), 30))
    noise = lambda k: "".join(rng.choice(list("ijklmnop"), k))
    text = "".join(gram + noise(int(rng.integers(3, 40))) for _ in range(80))
    compare(spark, [text, text[700:1400] + noise(60), noise(90) + text[:300]], least=40, gram=8, hot=3)


def test_intervals_give_sorted_contexts_and_common_prefixes():
    """Order, prefixes by increasing value and repeated windows against plain comparisons."""
    rng = np.random.default_rng(8)
    least, gram = 12, 4
    for letters, n in ((1, 40), (2, 200), (3, 300), (26, 50), (2, 1), (2, 0)):
        group = rng.integers(0, max(1, n // 25), n)
        befores = [bytes(rng.integers(97, 97 + letters, int(rng.integers(0, least - gram + 1))).tolist()) for _ in range(n)]
        afters = [bytes(rng.integers(97, 97 + letters, int(rng.integers(gram, least + 1))).tolist()) for _ in range(n)]
        left, right = np.full((n, least - gram), 255, np.uint8), np.full((n, least), 255, np.uint8)
        for i, (x, y) in enumerate(zip(befores, afters, strict=True)):
            left[i, : len(x)], right[i, : len(y)] = list(x), list(y)
        order, shared = substrings.prefix_intervals(group, right, least)
        assert sorted(order.tolist()) == list(range(n))
        ranks = [(group[i], right[i].tolist()) for i in order]
        assert ranks == sorted(ranks)
        for k in range(1, n):
            i, j = order[k - 1], order[k]
            prefix = next((x for x in range(least) if x >= len(afters[i]) or x >= len(afters[j]) or afters[i][x] != afters[j][x]), least)
            assert shared[k] == (prefix if group[i] == group[j] else 0)
        found = substrings.repeated_windows(group, left, np.array([len(x) for x in befores], np.int32), right, least)
        windows = defaultdict(list)
        for i in range(n):
            for a in range(len(befores[i]) + 1):
                if a + len(afters[i]) >= least:
                    windows[group[i], a, befores[i][:a], afters[i][: least - a]].append(i)
        wanted = np.zeros_like(found)
        for (_, a, _, _), rows in windows.items():
            wanted[rows, a] = len(rows) > 1
        assert (found == wanted).all()


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Of one large partition too; the session's own setting is as it was afterwards."""
    kind, name = type(spark.range(0)), "spark.sql.execution.arrow.maxRecordsPerBatch"
    plain, had = kind.mapInArrow, spark.conf.get(name)

    def watched(self, func, *a, **b):
        def small(batches):
            def told():
                for batch in batches:
                    if batch.num_rows > 1000:
                        raise ValueError(f"{batch.num_rows} rows at once")
                    yield batch

            return func(told())

        return plain(self, small, *a, **b)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    docs = spark.range(0, 2500, 1, 1).selectExpr("id AS doc_id", "repeat(sha2(string(id % 2499), 256), 7) AS text")
    out = substrings.remove_repeats(docs).groupBy("n_removed").count().collect()
    assert int(had) > 1000 and spark.conf.get(name) == had
    assert sorted(map(tuple, out)) == [(0, 2498), (448, 2)]
