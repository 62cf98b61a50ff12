"""Importance resampling towards a target distribution, on hashed n-grams of words.

A batch's texts are joined with a byte between them that is in no word, so that one pass of an expression finds
all words of all texts; each word's text is found by its place among the texts' ends, and
n-grams whose words are of two texts are masked before anything is counted.

Each bucket's gain compares how common it is in the target and in the corpus; a document's weight is the mean
gain of its features. Adding Gumbel noise made from a hash of the id and taking the highest sums draws
without replacement, by weight, in one pass, and the same rows at each run.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialize

BUCKETS, LONGEST = 10_000, 1
#: Documents with fewer words are never drawn; of the others, so many of a hundred are.
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
#: Bytes of joined texts that are read at once.
BYTES_AT_ONCE = 1 << 19

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def batch_features(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(number of words of each text, text of each feature, bucket of each feature)``, by text."""
    ends = np.fromiter(accumulate(len(t) + 1 for t in texts), np.int64, len(texts))
    found = list(_WORD.finditer(b"\0".join(texts).lower()))
    words = [m[0] for m in found]
    owner = np.searchsorted(ends, np.fromiter((m.start() for m in found), np.int64, len(found)), side="right")
    codes = list(map(zlib.crc32, words))
    of, bucket = [owner], [np.array(codes, np.int64) % buckets]
    for n in range(2, longest + 1):
        # Codes of runs of n words go on from those of n - 1.
        codes = [zlib.crc32(b" " + word, code) for code, word in zip(codes, words[n - 1 :], strict=False)]
        inside = owner[: len(codes)] == owner[n - 1 :]
        of.append(owner[: len(codes)][inside])
        bucket.append(np.array(codes, np.int64)[inside] % buckets)
    text, all_buckets = np.concatenate(of), np.concatenate(bucket)
    order = np.argsort(text, kind="stable")
    return np.bincount(owner, minlength=len(texts)), text[order], all_buckets[order].astype(np.int32)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, buckets)`` for each row: the bucket of each run of 1 to ``longest`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < BYTES_AT_ONCE):
                    stop, size = stop + 1, size + len(texts[stop])
                n_words, text, found = batch_features(texts[start:stop], longest, buckets)
                offsets = np.searchsorted(text, np.arange(stop - start + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(found))],
                    ["doc_id", "n_words", "buckets"],
                )
                start = stop

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, buckets array<int>"
    )


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows are in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on], pa.int64())], ["bucket", "n"])

    sums = found.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target and in the corpus, each count one higher."""
    s, t, n = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``; ``weight`` is the floored mean gain, 0 without features."""
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(2).value_lengths(), np.int64)
            ahead = np.append(0, np.cumsum(shared.value[np.asarray(batch.column(2).flatten(), np.int64)]))
            ends = np.cumsum(size)
            weight = np.where(size > 0, (ahead[ends] - ahead[ends - size]) // np.maximum(size, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"]
            )

    return found.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(id_column: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_column.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (written; with ``doc_id``, ``n_words``, ``score``) with ``rank`` of the highest scores, else null.

    Scores are whole thousandths of sums of a log ratio and of noise from 32 bits, so that some ten
    thousands of them differ at any number of rows: their histogram says how many rows are ahead of a score.
    """
    spark = scored.sparkSession
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    histogram = scored.filter(may).groupBy("score").agg(F.count("*").alias("n")).toArrow()
    score, n = np.asarray(histogram["score"], np.int64), np.asarray(histogram["n"], np.int64)
    order = np.argsort(-score)
    score, ahead = score[order], np.cumsum(n[order]) - n[order]
    drawn = int(n.sum()) * percent // 100
    on = ahead < drawn
    if not on.any():
        return scored.withColumn("rank", F.lit(None).cast("long"))
    places = spark.createDataFrame(list(zip(score[on].tolist(), ahead[on].tolist(), strict=True)), "score long, ahead long")
    high = may & (F.col("score") >= int(score[on][-1]))
    row = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    ranked = scored.filter(high).join(F.broadcast(places), "score").withColumn("rank", F.col("ahead") + row)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~F.coalesce(high, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(rest.columns).unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for each row of ``docs``.

    Null and empty texts have no features and weight 0. Rows with a null id count in the corpus but have no
    score and are not drawn. Repeated rows count and are drawn each. An empty target or corpus has
    no features, which leaves gains finite; other columns are ignored.
    """
    found = materialize(features(docs, longest=longest, buckets=buckets))
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target.select(F.lit(None).alias("doc_id"), "text"), longest=longest, buckets=buckets), buckets))
    scored = materialize(weights(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return draw(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
