"""Cross-tokenizer alignment with anchors at white space.

A text is encoded whole by both tokenizers. Where a token of each ends at the same byte and the next
token of each carries a space in front, the text is cut; what lies between two cuts is a window, named
by its two tuples of token ids. A window's alignment depends on these ids alone, so that it is made
once and remembered: groups between shared ends, links between tokens whose bytes overlap, and the id
pairs of its links. A document is its windows in order.

How many documents hold a pair is counted over the whole corpus. Pairs that many documents hold are few, by
their sum, and are sent to all tasks; the others meet their counts by a join on the pair.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Characters, and documents, that a task aligns at once; tokens of remembered windows before they are forgotten.
CHARS_AT_ONCE, DOCS_AT_ONCE, REMEMBERED = 1 << 18, 1024, 1 << 21
#: Pairs at most whose counts are sent to all tasks (some 17 bytes each).
MOST_SENT = 1 << 20

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


class Vocabulary:
    """Bytes of each id, their number, and whether they start with a space."""

    def __init__(self, entries: list[bytes]):
        self.bytes = entries
        self.size = np.array([len(x) for x in entries], np.int64)
        self.spaced = np.array([x[:1] == b" " for x in entries])


class Aligner:
    """Both tokenizers and the windows seen so far."""

    def __init__(self, ranks_path: str, pattern: str, model_path: str):
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.first = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=model_path)
        entries = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            entries[rank] = token
        self.a = Vocabulary(entries)
        m = self.second
        self.b = Vocabulary([
            bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())
        ])
        # Names of ids with what follows them: a comma, or a bar after a group's first side and a semicolon after its second.
        self.names = [f"{i}{end}" for size in (len(self.a.bytes), len(self.b.bytes)) for i in range(size) for end in (",", "|", ";", "")]
        self.width = np.array([len(x) for x in self.names], np.int64)
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple[bytes, bytes], int] = {}
        self.written: list[str] = []
        self.groups, self.links = array("q"), array("q")
        # Pairs of window w, and how often it has each: places ends[w] to ends[w + 1] of these.
        self.pairs, self.times, self.ends, self.held = array("q"), array("q"), array("q", [0]), 0

    def _learn(self, ranges: np.ndarray, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, shared: np.ndarray) -> None:
        """Align windows seen for the first time; ``ranges`` has a row (from, to, from, to) of token places for
        each, ``shared`` says which tokens of the first end where one of the second does."""
        size_a, size_b = ranges[:, 1] - ranges[:, 0], ranges[:, 3] - ranges[:, 2]
        spread = lambda first, size: np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        at_a, at_b = spread(ranges[:, 0], size_a), spread(ranges[:, 2], size_b)
        window_a = np.repeat(np.arange(len(ranges)), size_a)
        # A token's links: from the first of the others that ends after its start to the first that ends at or after its end.
        end = ends_a[at_a]
        low, high = np.searchsorted(ends_b, end - self.a.size[a[at_a]], side="right"), np.searchsorted(ends_b, end)
        n = high - low + 1
        pair = np.repeat(a[at_a].astype(np.int64), n) * len(self.b.bytes) + b[spread(low, n)]
        window = np.repeat(window_a, n)
        order = np.lexsort((pair, window))
        pair, window = pair[order], window[order]
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (window[1:] != window[:-1])))
        # Groups are numbered through all windows; a token's is the number of shared ends before it.
        before = np.append(0, np.cumsum(shared[at_a]))
        group_a = before[:-1]
        cuts = ends_a[at_a[shared[at_a]]]
        group_b = np.searchsorted(cuts, ends_b[at_b])
        order = np.lexsort((np.append(np.zeros(len(at_a), np.int8), np.ones(len(at_b), np.int8)), np.append(group_a, group_b)))
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        last_b = np.append(group_b[1:] != group_b[:-1], True)
        of_a, of_b = 4 * a[at_a].astype(np.int64) + last_a, 4 * (len(self.a.bytes) + b[at_b].astype(np.int64)) + 2 * last_b
        named = np.append(of_a, of_b)[order]
        written = "".join(map(self.names.__getitem__, named.tolist()))
        groups = np.bincount(window_a, shared[at_a], len(ranges)).astype(np.int64)
        width = np.add.reduceat(self.width[named], np.append(0, np.cumsum(size_a + size_b)[:-1]))
        stops = np.cumsum(width).tolist()
        self.written += [written[x : y - 1] for x, y in zip([0, *stops[:-1]], stops, strict=True)]
        self.groups.extend(groups.tolist())
        self.links.extend(np.bincount(window_a, n, len(ranges)).astype(np.int64).tolist())
        self.pairs.extend(pair[new].tolist())
        self.times.extend(np.diff(np.append(new, len(pair))).tolist())
        self.ends.extend((self.ends[-1] + np.cumsum(np.bincount(window[new], minlength=len(ranges)))).tolist())
        self.held += int(size_a.sum() + size_b.sum())

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers; none where the bytes of either aren't those of a space and the text."""
        first = [self.first.encode_ordinary(" " + t) if t else [] for t in texts]
        second = self.second.encode([t or "" for t in texts], num_threads=1)
        for k, t in enumerate(texts):
            if first[k] or second[k]:
                whole = (" " + t).encode("utf-8", "surrogatepass") if t else b""
                if whole != self.first.decode_bytes(first[k]) or whole != b"".join(map(self.b.bytes.__getitem__, second[k])):
                    first[k], second[k] = [], []
        return first, second

    def documents(self, texts: list[str | None]) -> list[list]:
        """Columns of ``ALIGNED`` but the first."""
        if self.held > REMEMBERED:
            self.forget()
        first, second = self.encode(texts)
        n_a, n_b = np.array([len(x) for x in first], np.int64), np.array([len(x) for x in second], np.int64)
        a, b = (np.fromiter(chain.from_iterable(x), np.int32, int(n.sum())) for x, n in ((first, n_a), (second, n_b)))
        full = np.flatnonzero(n_a)
        last = np.zeros(len(a), bool)
        last[np.cumsum(n_a)[full] - 1] = True
        # Bytes go on from text to text, so that the end of each is shared by both.
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        meets = np.searchsorted(ends_b, ends_a)
        shared = ends_b[meets] == ends_a if len(b) else np.zeros(0, bool)
        spaced = np.append(self.a.spaced[a[1:]], True)[: len(a)] & np.append(self.b.spaced[b], True)[meets + 1] if len(a) else shared
        cut = np.flatnonzero(shared & (spaced | last))
        stop_a, stop_b = cut + 1, meets[cut] + 1
        owner = full[np.cumsum(np.append(0, last[:-1]))[cut]] if len(a) else cut

        raw_a, raw_b, known, fresh = a.tobytes(), b.tobytes(), self.number, []
        windows, from_a, from_b = [], 0, 0
        for to_a, to_b in zip((4 * stop_a).tolist(), (4 * stop_b).tolist(), strict=True):
            key = raw_a[from_a:to_a], raw_b[from_b:to_b]
            w = known.get(key)
            if w is None:
                w = known[key] = len(known)
                fresh.append(len(windows))
            windows.append(w)
            from_a, from_b = to_a, to_b
        windows = np.array(windows, np.int64)
        if fresh:
            self._learn(np.stack([np.append(0, stop_a)[fresh], stop_a[fresh], np.append(0, stop_b)[fresh], stop_b[fresh]], 1), a, b, ends_a, ends_b, shared)

        n = len(texts)
        bounds = np.searchsorted(owner, np.arange(n + 1))
        of, written = windows.tolist(), self.written
        texts_of_groups = [";".join([written[w] for w in of[x:y]]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        groups = np.bincount(owner, np.array(self.groups, np.int64)[windows], n).astype(np.int64)
        links = np.bincount(owner, np.array(self.links, np.int64)[windows], n).astype(np.int64)

        # Distinct windows of a document with their counts, then distinct pairs of those.
        code, count = np.unique(owner * len(self.written) + windows, return_counts=True)
        doc, w = np.divmod(code, max(1, len(self.written)))
        ends = np.array(self.ends, np.int64)
        size = ends[w + 1] - ends[w]
        at = np.repeat(ends[w] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        pair, times = np.array(self.pairs, np.int64)[at], np.array(self.times, np.int64)[at] * np.repeat(count, size)
        doc = np.repeat(doc, size)
        order = np.lexsort((pair, doc))
        pair, doc, times = pair[order], doc[order], times[order]
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1]))[: len(pair)])
        times = np.add.reduceat(times, new) if len(new) else times
        offsets = np.searchsorted(doc[new], np.arange(n + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((pair[new], pa.int64()), (times, pa.int32()))]
        return [n_a, n_b, groups, links, texts_of_groups, *lists]


@lru_cache(maxsize=1)
def aligner(ranks_path: str, pattern: str, model_path: str) -> Aligner:
    return Aligner(ranks_path, pattern, model_path)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of documents that are aligned at once."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS_AT_ONCE or k + 1 - start >= DOCS_AT_ONCE:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def aligned(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ids of each tokenizer, groups and links (counts), ``groups`` as ``a1,a2|b1;a3|b2,b3``, and
    the distinct ``pairs`` linked (first id times the second vocabulary's size plus second id) with how many links each has.

    A text without tokens (null, empty, or whose tokens don't spell it) has zeros, an empty string and empty lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(ranks_path, pattern, model_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in _parts(texts):
                gc.disable()  # nothing here refers to itself, and what is remembered would be gone over again and again
                try:
                    n_a, n_b, groups, links, written, pairs, times = both.documents(texts[start:stop])
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, stop - start), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups, links)), pa.array(written, pa.string()), pairs, times],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame, second_size: int) -> DataFrame:
    """``(pair, n, best)``: how many rows hold a pair, and whether no pair of its first id has more."""
    counts = materialize(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    first = F.floor(F.col("pair") / F.lit(second_size))
    most = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))  # at most a row per id of the first vocabulary
    return counts.withColumn("first", first).join(F.broadcast(most), "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """``rows`` (written, with a unique ``row``) with ``n_best`` and ``count_sum`` in place of the pairs.

    Pairs of at least a ``most_sent``-th of all occurrences are ``most_sent`` at most; tasks get their counts.
    Each of the others is in fewer rows than that, so none is hot in the join that gives them theirs.
    """
    total = counts.agg(F.sum("n").alias("total")).first()["total"] or 0
    least = -(-total // most_sent)
    sent = counts.filter(F.col("n") >= least).toArrow()
    key = np.asarray(sent["pair"], np.int64)
    order = np.argsort(key)
    shared = rows.sparkSession.sparkContext.broadcast((key[order], np.asarray(sent["n"], np.int64)[order], np.asarray(sent["best"]).astype(bool)[order]))
    kept = [c for c in rows.columns if c not in ("pairs", "times")]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            lists, weights = batch.column("pairs"), batch.column("times")
            pair, times = np.asarray(lists.flatten(), np.int64), np.asarray(weights.flatten(), np.int64)
            size = np.asarray(lists.value_lengths(), np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            at = np.searchsorted(keys, pair)
            found = np.append(keys, -1)[at] == pair
            at = np.where(found, at, 0)
            count_sum, n_best = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            if len(keys):
                np.add.at(count_sum, owner[found], (n[at] * times)[found])
                np.add.at(n_best, owner[found], (best[at] * times)[found])
            offsets = np.searchsorted(owner[~found], np.arange(len(size) + 1)).astype(np.int32)
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~found], t)) for x, t in ((pair, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(n_best), pa.array(count_sum), *rest], [*kept, "n_best", "count_sum", "pairs", "times"]
            )

    types = dict(rows.dtypes)
    settled = rows.mapInArrow(settle, ", ".join([*(f"{c} {types[c]}" for c in kept), "n_best long, count_sum long, pairs array<long>, times array<int>"]))
    if least <= 1:  # all pairs were sent
        return settled.select(*kept, "n_best", "count_sum")
    settled = materialize(settled)
    others = settled.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = others.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("times")).alias("s"))
    return settled.join(sums, "row", "left").select(
        *kept, (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum")
    )


def second_vocabulary_size(model_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()


def corpus_alignment(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, most_sent: int = MOST_SENT) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for each row of ``docs``.

    ``n_best`` counts links whose pair is, of all pairs with its first id, in as many documents as any;
    ``count_sum`` sums over links how many documents hold their pair. Null, empty and unspellable texts have zeros
    and an empty ``groups_sha256``. Null ids are carried along; repeated rows count as documents each; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = aligned(docs, ranks_path, pattern, model_path)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups"), 256))
    rows = materialize(rows.withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id()))
    return scored(rows, pair_counts(rows, second_vocabulary_size(model_path)), most_sent).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
