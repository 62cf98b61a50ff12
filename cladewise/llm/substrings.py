"""Exact substring deduplication: every byte inside a string of ``least`` bytes that starts elsewhere too.

1. Each window of ``least`` bytes has one anchor: the leftmost smallest hash of its ``GRAM``-byte
   grams. Equal windows have equal anchors at equal places, so only anchors that occur twice matter.
2. Around such anchors the bytes that a window may span, the anchor's context, are cut out and meet by
   anchor. Equal contexts, which copies have, are repeated whole and are told by their digests before.
3. An anchor's rows are one interval. Extending intervals breadth first, a byte at a time, by the
   Burrows-Wheeler column of the reversed contexts sorts the rows by what follows the anchor and gives
   neighbours' common prefixes by increasing value, up to ``least``. The column of preceding bytes of
   the rows so sorted is the transform of the anchored suffixes: intervals are extended backwards in
   the same way. An interval at level ``a`` shares ``a`` bytes before the anchor, two of its rows share
   the least prefix between them after it, and a window is repeated where the two reach ``least``.
   Intervals of one row and rows that can't reach it any more are dropped.

Different contexts are told apart byte by byte; 64-bit hashes only bring rows together, and what 128-bit
digests say is taken as it is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_rows, materialize, released

LEAST, GRAM = 400, 64
#: Bytes hashed at once, rows extended at once, rows of one anchor that one task holds, texts handed to Python at once.
SLICE, ROWS_AT_ONCE, HOT, TEXTS_AT_ONCE = 1 << 17, 6000, 50_000, 1000
_PAD = 255  # never a byte of UTF-8


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, powers of an odd base and of its inverse modulo 2^64."""
    rng, base = np.random.default_rng(3), 0x9E3779B97F4A7C15
    n = SLICE + LEAST + 1
    powers = lambda x: np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, x, np.uint64)))
    return rng.integers(0, 2**63, 256).astype(np.uint64), powers(base), powers(pow(base, -1, 2**64))


def anchors(data: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows of ``data``."""
    value, power, inverse = _tables()
    places, hashes = [], []
    for base in range(0, max(1, len(data) - least + 1), SLICE):
        d = data[base : base + SLICE + least - 1]
        n, w = len(d), least - gram + 1
        if n < least:
            break
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[d] * power[:n])))
        h = (total[gram:] - total[:-gram]) * inverse[: n - gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        at = np.arange(len(h), dtype=np.uint64)
        key = (h & ~np.uint64(0xFFFFFF)) | at
        blocks = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        blocks[: len(key)] = key
        blocks = blocks.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - least + 1
        least_key = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
        chosen = least_key[np.concatenate(([True], least_key[1:] != least_key[:-1]))]
        place = (chosen & np.uint64(0xFFFFFF)).astype(np.int64)
        places.append(place + base)
        hashes.append(h[place].view(np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _members(key: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by ``key``: whether a row starts an interval, and whether it has others in its own. A row
    whose context has ended is alone."""
    starts = np.ones(len(key), bool)
    starts[1:] = (key[1:] != key[:-1]) | ended[1:]
    return starts, ~(starts & np.append(starts[1:], True))


def prefix_intervals(group: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group and right context, and each row's common prefix with the row before it in its group.

    The rows of a group are one interval at first. A step extends all intervals of two rows or more by the byte that
    comes next (the preceding one of the reversed contexts, whose Burrows-Wheeler column it is); rows that part at
    level ``a`` have ``a`` bytes in common. So values come by increasing size, and what is together at ``least``
    is not told further.
    """
    columns = np.ascontiguousarray(right.T)
    order = np.argsort(group, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = group[order][1:] != group[order][:-1]
    shared = np.where(first, 0, least).astype(np.int32)
    at = np.flatnonzero(~first | np.append(~first[1:], False))
    interval = np.cumsum(first[at])
    for a in range(least):
        if not len(at):
            break
        byte = columns[a][order[at]]
        key = interval * 256 + byte
        if (key[1:] < key[:-1]).any():
            by = np.argsort(key, kind="stable")
            order[at], key, byte = order[at[by]], key[by], byte[by]
        starts, on = _members(key, byte == _PAD)
        parted = starts.copy()
        parted[:1] = False
        parted[1:] &= interval[1:] == interval[:-1]
        shared[at[parted]] = a
        at, interval = at[on], np.cumsum(starts)[on]
    return order, shared


def repeated_windows(
    group: np.ndarray, left: np.ndarray, before: np.ndarray, right: np.ndarray, least: int
) -> np.ndarray:
    """(rows, left width + 1) booleans: the window that starts ``a`` bytes before the row's anchor is
    also another row's of its group. ``left`` is read backwards from the anchor, ``before`` is its true
    size; ``right`` is filled up with ``_PAD``."""
    deep = left.shape[1]
    columns = np.ascontiguousarray(left.T)
    found = np.zeros((len(group), deep + 1), bool)
    rows, shared = prefix_intervals(group, right, least)
    first = np.ones(len(rows), bool)
    first[1:] = group[rows][1:] != group[rows][:-1]
    interval = np.cumsum(first)
    for a in range(deep + 1):
        if not len(rows):
            break
        best = np.maximum(shared, np.append(shared[1:], 0))
        found[rows[best >= least - a], a] = True
        if a == deep:
            break
        # Rows that have another byte before them and can still reach `least`.
        on = np.flatnonzero((before[rows] > a) & (best >= least - np.minimum(deep, before[rows])))
        if not len(on):
            break
        key = interval[on] * 256 + columns[a][rows[on]]
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            on, key = on[order], key[order]
        starts, together = _members(key, np.zeros(len(key), bool))
        on, starts = on[together], starts[together]
        inner = np.flatnonzero(~starts)
        next_shared = np.zeros(len(on), np.int32)
        # Neighbours now share the least of what lay between them.
        between = np.stack((on[inner - 1] + 1, on[inner] + 1), 1).ravel()
        next_shared[inner] = np.minimum.reduceat(np.append(shared, 0), between)[::2] if len(inner) else 0
        rows, interval, shared = rows[on], np.cumsum(starts), next_shared
    return found


def find_spans(texts: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``texts(key, body)`` have a binary ``key`` for each distinct ``body``; copies share it.

    Returns the distinct bodies that may hold repeats, ``(key, body)``, and ``(key, start, stop)``
    spans of theirs, which may overlap. Both are written tables.
    """
    deep = least - gram
    spark = texts.sparkSession

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place, h = anchors(np.frombuffer(body, np.uint8), least, gram)
                for at, anchor in zip(place.tolist(), h.tolist(), strict=True):
                    begin, stop = max(0, at - deep), min(len(body), at + least)
                    digest = hashlib.blake2b(body[begin:stop], digest_size=16, salt=(at - begin).to_bytes(8, "little")).digest()
                    rows.append((key, anchor, at, begin, stop, digest))
                if len(rows) > 20_000:
                    yield out(rows, names, types)
                    rows = []
            yield out(rows, names, types)

    def out(rows, names, types):
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    names = ["key", "anchor", "place", "begin", "stop", "context"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    long_ones = texts.filter(F.octet_length("body") >= least)
    marked = long_ones.select("key", "body").mapInArrow(mark, "key binary, anchor long, place long, begin long, stop long, context binary")
    with arrow_rows(spark, TEXTS_AT_ONCE):
        marked = materialize(marked)
    # Contexts that are somewhere else too, byte for byte around their anchor, are repeated whole; one
    # place stands for them among the others of the anchor.
    occurrence = F.xxhash64("key", "place")
    kinds = materialize(
        marked.groupBy("anchor", "context").agg(
            F.min(F.struct("key", "place")).alias("one"), (F.min(occurrence) != F.max(occurrence)).alias("again")
        )
    )
    whole = marked.join(kinds.filter("again").select("anchor", "context"), ["anchor", "context"], "left_semi")
    whole = whole.filter(F.col("stop") - F.col("begin") >= least).select("key", F.col("begin").alias("start"), "stop")
    whole = materialize(whole.distinct())
    # An anchor with very many different contexts is dealt in blocks; see `leftovers`.
    held = kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", F.ceil(F.col("n") / hot).alias("blocks"))
    candidates = (
        kinds.join(held, "anchor").groupBy(F.col("one.key").alias("key"))
        .agg(F.collect_list(F.struct("one.place", "anchor", "blocks")).alias("places"))
    )
    # Copies, repeated rows among them, have one body.
    concerned = candidates.select("key", "places").join(whole.select("key").distinct().withColumn("repeats", F.lit(True)), "key", "full_outer")
    bodies = materialize(long_ones.groupBy("key").agg(F.first("body").alias("body")).join(concerned.drop("repeats"), "key"))
    released(marked, kinds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "block", "key", "place", "before", "context"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for key, body, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for p in places or ():
                    at = p["place"]
                    block = zlib.crc32(key + at.to_bytes(8, "little")) % p["blocks"] if p["blocks"] > 1 else -1
                    rows.append((p["anchor"], block, key, at, min(at, deep), body[max(0, at - deep) : at + least]))
                if len(rows) > 5000:
                    yield out(rows, names, types)
                    rows = []
            yield out(rows, names, types)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups at once: rows come sorted by (anchor, block)."""
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, ROWS_AT_ONCE), batch.slice(ROWS_AT_ONCE)
                waiting.append(part)
                size += part.num_rows
                if size >= ROWS_AT_ONCE and [waiting[0][c][0] for c in ("anchor", "block")] != [part[c][-1] for c in ("anchor", "block")]:
                    table = joined(waiting)
                    a, b = table["anchor"].to_numpy(), table["block"].to_numpy()
                    ends = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
                    yield solve(table.slice(0, ends[-1]))
                    table = table.slice(ends[-1])
                    waiting, size = table.to_batches(), table.num_rows
        if size:
            yield solve(joined(waiting))

    def joined(waiting: list[pa.RecordBatch]) -> pa.Table:
        """One copy of what waits, which is given up."""
        table = pa.Table.from_batches(waiting).combine_chunks()
        waiting.clear()
        return table

    def solve(table: pa.Table) -> pa.RecordBatch:
        a, block = table["anchor"].to_numpy(), table["block"].to_numpy()
        group = np.cumsum(np.concatenate(([0], (a[1:] != a[:-1]) | (block[1:] != block[:-1]))))[: len(a)]
        keys, place, before = table["key"].to_pylist(), table["place"].to_numpy(), table["before"].to_numpy()
        contexts = table["context"].to_pylist()
        n = len(keys)
        left, right = np.full((n, deep), _PAD, np.uint8), np.full((n, least), _PAD, np.uint8)
        for i, c in enumerate(contexts):
            c, k = np.frombuffer(c, np.uint8), before[i]
            left[i, :k] = c[:k][::-1]
            right[i, : len(c) - k] = c[k:]
        found = repeated_windows(group, left, before, right, least)
        some = found.any(1)
        low, high = found.argmax(1), deep - found[:, ::-1].argmax(1)
        # Windows of one anchor overlap, so that a row has one span.
        rows = [(keys[i], place[i] - high[i], place[i] - low[i] + least, None) for i in np.flatnonzero(some)]
        told: set[bytes] = set()
        for i in np.flatnonzero(block >= 0):  # one block of several: others must hear of its windows
            c = contexts[i]
            for x in range(min(deep, before[i]) + 1):
                at = before[i] - x
                if at + least <= len(c):
                    window = hashlib.blake2b(c[at : at + least], digest_size=16).digest()
                    if window not in told or not found[i, x]:
                        rows.append((keys[i], place[i] - x, place[i] - x + least, window))
                    told.add(window)
        return out(rows, ["key", "start", "stop", "window"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()])

    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    contexts = bodies.mapInArrow(cut, "anchor long, block long, key binary, place long, before int, context binary")
    dealt = contexts.repartition(partitions, "anchor", "block").sortWithinPartitions("anchor", "block")
    with arrow_rows(spark, TEXTS_AT_ONCE):
        spans = materialize(dealt.mapInArrow(extend, "key binary, start long, stop long, window binary"))
    # Leftovers of anchors dealt in blocks: single windows meet by their 128-bit digest, in a
    # combinable aggregate whatever the anchor's size.
    single = spans.filter("window IS NOT NULL")
    at = F.xxhash64("key", "start")
    twice = single.groupBy("window").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a <> b")
    leftovers = single.join(twice, "window", "left_semi").select("key", "start", "stop")
    found = spans.filter("window IS NULL").select("key", "start", "stop").unionByName(leftovers).unionByName(whole)
    return bodies.select("key", "body"), found


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, hot: int = HOT
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` for each row of ``docs``; ``kept``
    is binary, null where nothing or everything is removed.

    A null text is empty. Rows with equal texts are copies of each other whatever their ids, so
    that repeated rows of ``least`` bytes or more go whole; each row has one result. Null ids are carried along; an empty
    table gives an empty result; other columns are ignored.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body"))
    texts = raw.withColumn("sha", F.sha2("body", 256)).withColumn("key", F.substring(F.unhex("sha"), 1, 16))
    bodies, spans = find_spans(texts.select("key", "body"), least, gram, hot)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            rows = []
            for key, body, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                merged: list[list[int]] = []
                for s in found:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["stop"])
                    else:
                        merged.append([s["start"], s["stop"]])
                edges = [0, *(x for m in merged for x in m), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((key, len(body) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)],
                ["key", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    merged = spans.distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    cleaned = bodies.join(merged, "key").mapInArrow(
        keep, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    copies = texts.filter(F.octet_length("body") >= least).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    verdict = cleaned.join(copies, "key", "full_outer").select(
        F.coalesce(cleaned["key"], copies["key"]).alias("key"), copies["n"].isNotNull().alias("copied"),
        "n_removed", "n_spans", "kept_sha256", "kept",
    )
    rows = texts.select("id", "key", "sha", F.octet_length("body").cast("long").alias("n_bytes"))
    copied = F.coalesce(F.col("copied"), F.lit(False))
    return rows.join(verdict, "key", "left").select(
        F.col("id").alias("doc_id"), "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(~copied, F.col("kept")).alias("kept"),
    )
