"""Resampling against a plain computation, text by text, and what the draw is for."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladewise.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def buckets_of(text, longest, buckets):
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def plain(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    found = [(i, *buckets_of(t, longest, buckets)) for i, t in rows]
    s, t = Counter(x for *_, b in found for x in b), Counter(x for text in target for x in buckets_of(text, longest, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets)))) for k in range(buckets)]
    out = []
    for i, n, b in found:
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(b), weight, score, None, n])
    may = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def frames(spark, rows, target):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rank int, buckets string").repartition(3)
    return docs, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")


ODD = [None, "", "...", "A b C", "É Ünder ß 漢字 42 a-b_c d", "x\x00y\x1fz {a|b} ~", "word " * 4000, "z" * 30000, "one two three " * 9, "ONE two THREE " * 9]


@pytest.mark.parametrize("longest", [1, 3])
def test_odd_texts(spark, monkeypatch, longest):
    monkeypatch.setattr(resampling, "BYTES_AT_ONCE", 64)
    rows = [*enumerate(ODD), (None, "a null id " * 12), (8, ODD[8]), (8, ODD[8]), *((100 + k, f"one word{k} " * 15) for k in range(40))]
    target = ["one two three", None, "", "word3 word4 Ünder"]
    got = resampling.resample(*frames(spark, rows, target), percent=45, longest=longest, buckets=97)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, target, longest, 97, 45)


def test_corpus(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    rows, target = [(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in benchmark.collect()]
    got = resampling.resample(docs, benchmark)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, target)


def test_ties_go_to_smaller_ids(spark):
    scored = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(30).alias("n_words"), F.floor(F.col("id") / 30).alias("score"))
    got = {r["doc_id"]: r["rank"] for r in resampling.draw(scored, percent=25).collect()}
    assert {i: r for i, r in got.items() if r} == {**{90 + k: k + 1 for k in range(10)}, **{60 + k: 11 + k for k in range(15)}}


def test_draws_lean_to_the_target(spark):
    rows = [(k, ("alpha beta gamma delta " if k % 2 else "rho sigma tau phi ") * 6) for k in range(400)]
    got = resampling.resample(*frames(spark, rows, ["alpha beta gamma delta " * 50])).filter("rank is not null").collect()
    assert len(got) == 40 and sum(r["doc_id"] % 2 for r in got) >= 36


@pytest.mark.parametrize("rows, target", [([], ["a b"]), ([(1, "a " * 30)], []), ([], [])])
def test_empty_tables(spark, rows, target):
    assert sorted(map(tuple, resampling.resample(*frames(spark, rows, target)).collect())) == plain(rows, target)
