"""Exact duplicates against a dictionary of normalised texts, with and without identifier collisions."""

import hashlib
import re
from collections import defaultdict

import pytest

from cladewise.llm import exact_dedup as ed

LONG = " ".join(f"word{i % 97} and{i % 13}" for i in range(3000))
ROWS = [
    (5, "a  b\tc"), (3, "a b c"), (9, "a b c "), (1, None), (2, ""), (4, " \n "), (6, LONG), (7, LONG + " "), (8, LONG.replace(" ", "  ")), (10, LONG + "x"),
    (11, "x" * 20000), (12, "x" * 20000), (13, "é🙂 " * 2000), (14, "a b c"),
]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("bits", [64, 6])
def test_groups(spark, bits):
    docs = spark.createDataFrame([(i, t, "r") for i, t in ROWS], "doc_id long, text string, recipe string")
    out = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in ed.duplicate_groups(docs, hash_bits=bits).collect()}
    assert out == brute(ROWS)


def test_chunks_tile_the_text(spark):
    df = spark.createDataFrame([(t,) for _, t in ROWS if t], "text string")
    for r in df.select("text", ed.chunks(df.text).alias("c")).collect():
        assert "".join(r["c"]) == r["text"]


def test_filter_nulls_and_empty(spark):
    schema = "doc_id long, text string, sha string"
    assert ed.duplicate_groups(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "q", "a"), (2, "q", "b"), (7, "q", "c"), (None, "z", "d")], schema)
    kept = ed.drop_exact_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["sha"]) for r in kept) == [(0, "z", "d"), (2, "q", "b")]
