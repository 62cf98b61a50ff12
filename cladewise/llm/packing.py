"""Best-fit packing planned over the histogram of lengths.

The driver sees one count per length (at most ``capacity`` of them), never documents. The plan is a
list of ranges "documents of this length with ranks r..r+n go to sequences s..s+n at this offset";
documents find their range by a join on their rank within their length.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CAPACITY, END_ID = 2048, 0
#: Rows that one window group or one join key of the ranking holds.
RANK_BLOCK = 512
#: Documents whose ids a Python worker holds at once.
DOCS_AT_ONCE = 128

#: Fixed value: the vocabulary's only special token; in a text it is one id, as everywhere.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(text: str, path: str, pattern: str) -> bytes:
    """Ids of a text as little-endian uint32, with the ranks in the file ``path``."""
    return _encoder(path, pattern).encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def token_pieces(
    docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``; ``ids`` is binary, little-endian uint32.

    A document is its ids and ``END_ID``; a null text is empty. Longer ones than ``capacity`` are
    cut into full pieces after a first one that may be shorter. Null ids are carried along; repeated
    rows are packed each; an empty table gives an empty result; other columns are ignored.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(at, DOCS_AT_ONCE)
                rows: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = encode(text or "", ranks_path, pattern) + end
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        stop = start + ((n - start) % capacity or capacity)
                        for column, x in zip(rows, (doc_id, piece, start, stop - start, ids[4 * start : 4 * stop]), strict=True):
                            column.append(x)
                        start, piece = stop, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: ``(length, first_rank, n, first_sequence, offset)`` rows.

    Sequences with equal room are handled as ranges, so the work follows the number of lengths, not
    of documents.
    """
    rooms: list[int] = []  # sorted; each has ranges of sequences with that much room
    ranges: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, n))

    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                n = -(-left // (capacity // length))
                put(capacity, sequences, n)
                sequences += n
                at = len(rooms) - 1
            room = rooms[at]
            first, n = ranges[room].pop()
            if not ranges[room]:
                del ranges[room], rooms[at]
            taken = min(n, left)
            put(room, first + taken, n - taken)
            put(room - length, first, taken)
            plan.append((length, rank, taken, first, capacity - room))
            rank, left = rank + taken, left - taken
    return plan


_PLAN = T.StructType([T.StructField(x, T.LongType()) for x in ("length", "first_rank", "n", "first_sequence", "offset")])


def assign_slots(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (already written: they are read twice) with ``sequence_id`` and ``offset``.

    Ranks are counted in blocks of about ``RANK_BLOCK`` rows, so that a length which many pieces
    share is not one window group; ties between repeated rows fall either way.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame([(k, max(1, n // RANK_BLOCK)) for k, n in counts.items()], "length long, blocks long")
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), _PLAN)

    dealt = pieces.join(F.broadcast(blocks), "length").withColumn(  # at most `capacity` rows
        "block", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("blocks"))
    )
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).select(
        "length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece")
    ranked = (
        dealt.withColumn("row", F.row_number().over(inside))
        .join(offsets, ["length", "block"])
        .withColumn("rank", F.col("ahead") + F.col("row") - 1)
        .withColumn("rank_block", F.floor(F.col("rank") / RANK_BLOCK))
    )
    slots = plan.withColumn(
        "rank_block",
        F.explode(F.sequence(F.floor(F.col("first_rank") / RANK_BLOCK), F.floor((F.col("first_rank") + F.col("n") - 1) / RANK_BLOCK))),
    ).select("length", "rank_block", "first_rank", "n", "first_sequence", "offset")
    joined = ranked.join(slots, ["length", "rank_block"]).filter(
        (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    )
    return joined.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank")).select(
        *pieces.columns, "sequence_id", "offset"
    )
