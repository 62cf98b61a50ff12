"""Packing against the vocabulary's own library, a gapless layout and the plan's rules."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.llm import packing
from cladewise.llm.queries import packed, tokenizer

ODD = [None, "", " ", "a", "  two  blanks ", "tab\tand\nlines\r\n", "it's <|endoftext|> here", "naïve ñandú über 漢字 🙂", "x" * 9000, "word " * 5000, " odd spaces\x1f ", "1234 56,78.9 !!!"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def check(spark, rows, reference):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, piece string, offset int")
    out = [r.asDict() for r in packed(docs).collect()]
    of = defaultdict(list)
    for r in out:
        of[r["doc_id"]].append(r)
    for i, text in rows:
        ids, at = reference(text), 0
        for k, r in enumerate(sorted(of[i], key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert k == 0 or r["length"] == 2048
            at += r["length"]
        assert at == len(ids)
        assert len(of[i]) == -(-len(ids) // 2048)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    return len(sequences), sum(r["length"] for r in out)


def test_odd_texts(spark, reference):
    check(spark, list(enumerate(ODD)), reference)


def test_corpus_is_packed_tightly(spark, sf_dir, reference):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sequences, tokens = check(spark, rows, reference)
    assert sequences <= -(-tokens // 2048) * 1.02 + 1


def test_hot_length_is_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 16)
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") < 400, 700).otherwise(300 + F.col("id")).cast("long").alias("length"))
    out = packing.assign_slots(pieces).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out) == 500


def test_plan_fills_rooms_best_first():
    plan = packing.best_fit_plan({6: 2, 4: 3, 3: 1}, 10)
    room = Counter()
    for length, _, n, first, offset in plan:
        for s in range(first, first + n):
            assert room[s] == offset
            room[s] += length
    assert len(room) == 3 and max(room.values()) <= 10


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
