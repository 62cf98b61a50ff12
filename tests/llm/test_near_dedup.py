"""Near-duplicate components against all pairs of exact shingle sets."""

import random
import re

from cladewise.llm import near_dedup


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 4 >= 3 * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= 75 * (len(a) + len(b) - shared):
                    p, q = sorted((find(i), find(j)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def compare(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, n int")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, **options).collect()}
    expected = brute(rows)
    assert {i: v for i, v in out.items() if expected[i] != v} == {}
    assert len(out) == len(rows)


def family(rng, words, n, rate):
    vocabulary = [f"w{k}" for k in range(500)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base) for _ in range(n)]


def test_families_of_all_sizes(spark):
    rng = random.Random(1)
    texts = [None, "", " \t", "One two", "one TWO", "one two three", "É a b c d", "é a b c d"]
    for words, n in ((6, 40), (20, 80), (60, 90), (300, 40), (1500, 6)):
        for rate in (0.01, 0.03):
            texts += family(rng, words, n, rate)
    passage = " ".join(family(rng, 40, 1, 0))
    texts += [" ".join(family(rng, k % 7 + 1, 1, 0)) + " " + passage for k in range(60)]
    texts += [" ".join(family(rng, 150, 1, 0)) + " " + passage for k in range(80)]
    rng.shuffle(texts)
    compare(spark, list(enumerate(texts)))


def test_families_larger_than_a_block(spark):
    """Blocks of 7 nodes: families meet block by block, or by list where lists chain them."""
    rng = random.Random(2)
    texts = family(rng, 60, 120, 0.012) + family(rng, 60, 60, 0.03) + family(rng, 260, 50, 0.02)
    head, tail = (family(rng, 200, 1, 0)[0].split() for _ in range(2))
    texts += [" ".join(head[3 * k : 3 * k + 40] + tail[k : k + 3]) for k in range(50)]  # each like the next only
    rng.shuffle(texts)
    compare(spark, list(enumerate(texts)), most=7)


def test_exactly_the_threshold(spark):
    """Sets of 7 with 6 in common (6 / 8) are linked, of 6 with 5 in common (5 / 7) are not."""
    words = "a b c d e f g h i j k l m n o p q r s t u v".split()
    rows = [(1, " ".join(words[:11])), (2, " ".join(words[1:12])), (5, " ".join(words[12:22])), (6, " ".join(words[13:22] + ["z"]))]
    compare(spark, rows)


def test_texts_of_one_id_share_a_component(spark):
    rows = [(3, "a b c d e f g"), (7, "a b c d e f g"), (7, "p q r s t u v"), (9, "p q r s t u v"), (9, "w x")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(3, 3), (7, 3), (9, 3)} and len(out) == 5


def test_corpus(spark, sf_dir):
    compare(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (2, "z y x")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in out) == [
        (-1, -1, True), (-1, -1, True), (2, 2, True), (2, 2, True), (2, 2, True), (4, 2, False),
    ]
