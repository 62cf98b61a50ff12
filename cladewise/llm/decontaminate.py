"""Benchmark decontamination: CGK walks, bit sampling over item-sized windows, exact edit distance.

Texts are read as lower-case words. A CGK walk goes over a sequence of words and at each step gives
out the word it is at; a random bit of the word and the step says whether it goes on to the next word. Two
walks over sequences that few edits set apart come together again after each edit, so that an edit
distance becomes a Hamming distance between what they give out. A few random steps of that are a key; equal
keys of an item's walk and a text's make a candidate, and the exact edit distance between the item
and the words around the place decides.

Walks start at every word of a text that may be inside an item: the words about it must be as many
of the items' words as an item with all its edits has. An item has walks that start all over it, so
that edits wherever they bunch leave some of them alone, and each of them is repeated with other bits and
steps until the recall is near 1 (see ``REPEATS``).

Items that begin alike ("which of the following ...") share keys. Where many do, a place in a text meets only
those of them of which it has enough rare words: as no more than its edits of an item's words may be missing, of
so many and ``ASKED`` more at least ``ASKED`` are there, and the rarest among the key's items are asked for. No
item is lost by that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of an item's words that may be edited.
TOLERANCE = 0.2
#: Walks, each with bits and steps of its own; at the full tolerance none of 5,400 edited items of 8 to 120 words was missed with 6.
REPEATS = 6
#: Steps of a walk that make a key; numbers of steps that walks have, by the words of an item from their start on.
SAMPLED, STEPS = 3, (1, 2, 4, 8, 12, 18, 28, 42)
#: An item's walks start about so often, and at most so many words apart; they go over this share of its words.
STARTS, APART, SHARE = 8, 7, 0.35
#: Walks with one key from which on they are met by their items' rarest words; how many of these must be near.
SHARED, ASKED = 64, 4
#: Characters of items searched for at once, beside ITEMS_AT_ONCE.
ITEM_CHARS_AT_ONCE = 20_000_000
#: Items with fewer words than this have none; items searched for at once; words read at once; hits compared at once.
LEAST_WORDS, ITEMS_AT_ONCE, WORDS_AT_ONCE, HITS_AT_ONCE = 1, 20_000, 1 << 16, 1 << 18

#: Characters of scripts without blanks (kana, ideographs, Thai, Lao, Burmese, Khmer), a word each with
#: the marks on it; their punctuation parts words.
_ALONE = re.compile("[\u0e01-\u0e30\u0e32\u0e33\u0e40-\u0e46\u0e50-\u0e59\u0e81-\u0eb0\u0eb2\u0eb3\u0ebd-\u0ec6\u0ed0-\u0edf\u1000-\u102a\u103f-\u1049\u1780-\u17b3\u17e0-\u17e9\u3005-\u3007\u3041-\u3096\u30a1-\u30fa\u30fc\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff][\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ecd\u102b-\u103e\u17b4-\u17d3\u3099\u309a\u200b-\u200d]*")
_FAR = re.compile("[\u0e01-\U0003ffff]")
_BETWEEN = re.compile("[\u104a\u104b\u17d4-\u17da\u0e5a\u0e5b\u3000-\u3004\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Size of the table that says, with chance errors, whether an item has a word.
_MEMBERS = 1 << 22
#: Sizes of windows that stand for items of about that size.
_GROWING = [*range(1, 6), *(int(5 * 1.25**k) + 1 for k in range(1, 60))]


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of any other characters, in lower case; in scripts without
    blanks, characters."""
    text = (text or "").lower()
    if not text.isascii() and _FAR.search(text):
        text = _BETWEEN.sub(" ", _ALONE.sub(r" \g<0> ", text))
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


class Searcher:
    """Finds items, each a list of words, in a sequence of word numbers."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], tolerance: float = TOLERANCE, repeats: int = REPEATS):
        self.items = [(i, w) for i, w in items if len(w) >= LEAST_WORDS]
        self.number = {w: k for k, w in enumerate(sorted({x for _, ws in self.items for x in ws}), 1)}
        self.coded = [np.array([self.number[x] for x in ws], np.int32) for _, ws in self.items]
        self.sizes = np.array([len(w) for w in self.coded], np.int64)
        self.most = np.array([int(tolerance * len(w)) for w in self.coded], np.int64)
        self.member = np.zeros(_MEMBERS, bool)
        for k, w in enumerate(self.coded):
            self.member[self._slot(k, w.astype(np.int64))] = True
        self.classes = self._classes()
        rng = np.random.default_rng(11)
        self.bits = rng.integers(0, 2**63, (repeats, len(self.number) + 1)).astype(np.uint64)
        self.steps = [[np.sort(rng.choice(n, min(SAMPLED, n), replace=False)).tolist() for n in STEPS] for _ in range(repeats)]
        self.starts = self._starts()
        self.tables = [self._tables(r) for r in range(repeats)]

    @staticmethod
    def _mix(code, word):
        code = (code ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return code ^ (code >> np.uint64(29))

    @staticmethod
    def _slot(item, word):
        return (item * 0x9E3779B1 + word * 0x85EBCA77) % _MEMBERS

    def _classes(self) -> list[tuple[int, int, int]]:
        """(words, items' words among them at least, longest item) of items of about a size."""
        out: dict[int, tuple[int, int]] = {}
        for n, most in zip(self.sizes.tolist(), self.most.tolist(), strict=True):
            size = next(x for x in _GROWING if x * 5 // 4 + 1 > n)
            longest, edits = out.get(size, (0, 0))
            out[size] = max(longest, n), max(edits, most)
        return [(size, size - edits, longest) for size, (longest, edits) in out.items()]

    def _starts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """By number of steps: items and the places in them where walks start."""
        found: list[list[tuple[int, int]]] = [[] for _ in STEPS]
        for k, w in enumerate(self.coded):
            n = len(w)
            apart = max(1, min(n // STARTS, APART)) if self.most[k] else n
            for at in range(0, n, apart):
                reach = min(n - at, max(int(SHARE * n), 6))
                if at == 0 or reach > 3:
                    steps = 2 * reach if self.most[k] else n  # a whole item's walk must not leave it
                    found[max(x for x, s in enumerate(STEPS) if s <= steps)].append((k, at))
        return [tuple(np.array(x, np.int64).reshape(-1, 2).T) for x in found]

    def _keys(self, words_at: np.ndarray, start: np.ndarray, r: int, only: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of steps, keys, whether each is of items' words only) of the walks from ``start``."""
        wanted = [x for x in range(len(STEPS)) if len(self.starts[x][0]) and only in (None, x)]
        if not wanted:
            return
        bit, at = self.bits[r][words_at], start.astype(np.intp)
        code = {x: np.full(len(at), x, np.uint64) for x in wanted}
        good = {x: np.ones(len(at), bool) for x in wanted}
        for step in range(max(self.steps[r][x][-1] for x in wanted) + 1):
            sampled = [x for x in wanted if step in self.steps[r][x]]
            if sampled:
                word = words_at.take(at, mode="clip")
                for x in sampled:
                    code[x], good[x] = self._mix(code[x], word), good[x] & (word > 0)
                    if step == self.steps[r][x][-1]:
                        yield x, code[x], good[x]
            at += ((bit.take(at, mode="clip") >> np.uint64(step)) & np.uint64(1)).view(np.int64)

    def _tables(self, r: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, tuple]]:
        """By number of steps: a table that says, with chance errors, whether any walk has a key, the
        keys in order, the numbers of their walks, and what :meth:`_crowded` makes of keys with many."""
        ends = np.cumsum(self.sizes + STEPS[-1])
        whole = np.zeros(int(ends[-1]) if len(ends) else 1, np.int32)
        for w, end in zip(self.coded, ends.tolist(), strict=True):
            whole[end - len(w) - STEPS[-1] : end - STEPS[-1]] = w
        out = {}
        for x, (item, at) in enumerate(self.starts):
            for _, key, good in self._keys(whole, ends[item] - self.sizes[item] - STEPS[-1] + at, r, x):
                on = np.flatnonzero(good)
                on = on[np.argsort(key[on], kind="stable")]
                room = 1 << max(12, (16 * len(on)).bit_length())
                may = np.zeros(room, bool)
                may[key[on] & np.uint64(room - 1)] = True
                out[x] = may, key[on], on, self._crowded(x, key[on], on)
        return out

    def _crowded(self, x: int, keys: np.ndarray, walks: np.ndarray) -> tuple[np.ndarray, ...]:
        """For keys that more than ``SHARED`` walks have: their first places in ``keys``, how many words before and
        after a place can be an item's, and (key, word) codes in order with the walks whose items have the word
        among their rarest, how often it is among these, and how many of these must be there."""
        first, times = np.unique(keys, return_index=True, return_counts=True)[1:]
        first, times = first[times > SHARED], times[times > SHARED]
        span, codes, found, often, least = np.zeros((len(first), 2), np.int64), *([np.zeros(0, np.int64)] for _ in range(4))
        for k, (a, n) in enumerate(zip(first.tolist(), times.tolist(), strict=True)):
            walk = walks[a : a + n]
            item, at = self.starts[x][0][walk], self.starts[x][1][walk]
            reach = 2 * self.most[item]
            span[k] = (at + reach).max(), (self.sizes[item] - at + reach).max()
            own, of = np.unique(item, return_inverse=True)
            word = np.concatenate([self.coded[i] for i in own.tolist()]).astype(np.int64)
            owner = np.repeat(np.arange(len(own)), self.sizes[own])
            code, place = np.unique(owner * (len(self.number) + 1) + word, return_inverse=True)
            common = np.bincount(code % (len(self.number) + 1), minlength=len(self.number) + 1)[word]
            order = np.lexsort((word, common, owner))
            rank = np.arange(len(order)) - np.repeat(np.cumsum(self.sizes[own]) - self.sizes[own], self.sizes[own])
            asked, times_in = np.unique(code[place[order[rank < self.most[own][owner[order]] + ASKED]]], return_counts=True)
            owner, word = np.divmod(asked, len(self.number) + 1)
            size = np.bincount(owner, minlength=len(own))
            ends = np.cumsum(size)
            per = size[of]
            at_word = np.repeat(ends[of] - per - np.cumsum(per) + per, per) + np.arange(int(per.sum()))
            codes.append(k * (len(self.number) + 1) + word[at_word])
            found.append(np.repeat(walk, per))
            often.append(times_in[at_word])
            least.append(np.repeat(np.minimum(ASKED, self.sizes[item] - self.most[item]), per))
        order = np.argsort(np.concatenate(codes), kind="stable")
        return first, span, *(np.concatenate(x)[order] for x in (codes, found, often, least))

    def _met(self, crowded: tuple, key_place: np.ndarray, spot: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and walks of crowded keys that have enough of the words asked for near the place."""
        first, span, codes, walks, often, least = crowded
        k = np.searchsorted(first, key_place)
        size = span[k].sum(1)
        total = np.cumsum(size)
        start = 0
        while start < len(spot):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + HITS_AT_ONCE)))
            n = size[start:stop]
            which = np.repeat(np.arange(start, stop), n)
            at = np.repeat(spot[start:stop] - span[k[start:stop], 0] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            inside = (at >= 0) & (at < len(w))
            which, word = which[inside], w[at[inside]].astype(np.int64)
            seen = np.unique(np.stack((which[word > 0], k[which[word > 0]] * (len(self.number) + 1) + word[word > 0]), 1), axis=0)
            low = np.searchsorted(codes, seen[:, 1])
            times = np.searchsorted(codes, seen[:, 1], side="right") - low
            hit = np.repeat(low - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            both, of = np.unique(np.repeat(seen[:, 0], times) * (int(walks.max(initial=0)) + 1) + walks[hit], return_inverse=True)
            enough = np.bincount(of, often[hit], len(both)) >= np.bincount(of, least[hit], len(both)) / np.maximum(np.bincount(of, minlength=len(both)), 1)
            at, walk = np.divmod(both[enough], int(walks.max(initial=0)) + 1)
            yield spot[at], walk
            start = stop

    def _likely(self, w: np.ndarray) -> np.ndarray:
        """Places that may be inside an item, by the number of items' words around them."""
        count = np.concatenate(([0], np.cumsum(w > 0)))
        change = np.zeros(len(w) + 1, np.int32)
        for size, least, longest in self.classes:
            if len(w) >= size:
                full = np.flatnonzero(count[size:] - count[:-size] >= least)
                reach = longest + longest // 4 + 1
                change += np.bincount(full, minlength=len(w) + 1).astype(np.int32)
                change -= np.bincount(np.minimum(full + reach, len(w)), minlength=len(w) + 1).astype(np.int32)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)

    def candidates(self, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, places of their first words and places of a walk of theirs, where enough words are
        in common to be compared."""
        start = self._likely(w)
        padded = np.concatenate((w, np.zeros(STEPS[-1] + 1, np.int32)))
        for r in range(len(self.tables)) if len(start) else ():
            for x, key, good in self._keys(padded, start, r):
                may, keys, walks, crowded = self.tables[r][x]
                on = np.flatnonzero(good & may[key & np.uint64(len(may) - 1)])
                low = np.searchsorted(keys, key[on])
                times = np.searchsorted(keys, key[on], side="right") - low
                many = times > SHARED
                for spot, walk in self._met(crowded, low[many], start[on[many]], w) if many.any() else ():
                    yield from self._compared(x, walk, spot, w)
                few = (times > 0) & ~many
                on, low, times = on[few], low[few], times[few]
                total = np.cumsum(times)
                for first in range(0, int(total[-1]) if len(on) else 0, HITS_AT_ONCE):
                    rank = np.arange(first, min(first + HITS_AT_ONCE, int(total[-1])))
                    which = np.searchsorted(total, rank, side="right")
                    yield from self._compared(x, walks[low[which] + rank - (total - times)[which]], start[on[which]], w)

    def _compared(self, x: int, walk: np.ndarray, spot: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        item = self.starts[x][0][walk]
        place = spot - self.starts[x][1][walk]
        keep = self._alike(item, place, w)
        yield item[keep], place[keep], spot[keep]

    def _alike(self, item: np.ndarray, place: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Whether the words that an item would be on are its own but for its edits. An edit takes one
        word at most out of them, and the place may be wrong by as many words as there are edits."""
        size, most = self.sizes[item], 2 * self.most[item]
        missed, left = np.zeros(len(item), np.int64), np.arange(len(item))
        for first in range(0, int(size.max(initial=0)), 16):
            left = left[(missed[left] <= most[left]) & (size[left] > first)]
            at = np.arange(first, first + 16)
            spot = place[left, None] + at
            word = np.where((spot >= 0) & (spot < len(w)), w[np.clip(spot, 0, len(w) - 1)], 0).astype(np.int64)
            other = (word == 0) | ~self.member[self._slot(item[left, None], word)]
            missed[left] += (other & (at < size[left, None])).sum(1)
        return missed <= most

    def edits(self, k: int, text: np.ndarray) -> int:
        """Least number of word edits between item ``k`` and any part of ``text``."""
        item, places = self.coded[k], np.arange(len(text) + 1)
        row = np.zeros(len(text) + 1, np.int64)
        for i, x in enumerate(item, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[:-1] + (text != x), row[1:] + 1)
            row = np.minimum.accumulate(new - places) + places
        return int(row.min())

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(number of the text, item, edits) of all items that are in the texts."""
        at, known = 0, {}
        while at < len(texts):
            coded, size, first = [], 0, at
            while at < len(texts) and (not coded or size < WORDS_AT_ONCE):
                found = words(texts[at])
                coded.append(np.fromiter(map(self.number.get, found, repeat(0)), np.int32, len(found)))
                size, at = size + len(found) + 1, at + 1
            gap = np.zeros(1, np.int32)
            whole = np.concatenate([x for c in coded for x in (c, gap)])
            ends = np.cumsum([len(c) + 1 for c in coded])
            hits = [np.stack((np.searchsorted(ends, spot, side="right"), item, place), 1) for item, place, spot in self.candidates(whole)]
            hits = np.unique(np.concatenate(hits), axis=0) if hits else np.zeros((0, 3), np.int64)
            reach = 2 * self.most[hits[:, 1]]
            begins = np.concatenate(([0], ends))[hits[:, 0]]
            low, high = np.maximum(begins, hits[:, 2] - reach), np.minimum(ends[hits[:, 0]] - 1, hits[:, 2] + self.sizes[hits[:, 1]] + reach)
            # Places of an item that are near each other are compared together.
            new = np.ones(len(hits), bool)
            new[1:] = (hits[1:, :2] != hits[:-1, :2]).any(1) | (low[1:] > high[:-1])
            group = np.flatnonzero(new)
            best: dict[tuple[int, int], int] = {}
            for (d, k, _), a, b in zip(hits[group].tolist(), low[group].tolist(), np.maximum.reduceat(high, group).tolist() if len(group) else [], strict=True):
                text, most = whole[a:b], int(self.most[k])
                if best.get((d, k)) == 0 or len(text) < self.sizes[k] - most:
                    continue
                seen = (k, text.tobytes())
                e = known[seen] if seen in known else known.setdefault(seen, self.edits(k, text))
                if e <= most and e < best.get((d, k), most + 1):
                    best[d, k] = e
            if len(known) > 10_000:
                known.clear()
            yield from ((first + d, k, e) for (d, k), e in sorted(best.items()))


def _searchers(benchmark: DataFrame, tolerance: float) -> Iterator[Searcher]:
    """Searchers of blocks of the benchmark, of about ``ITEMS_AT_ONCE`` items each."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEMS_AT_ONCE), -(-(size["chars"] or 0) // ITEM_CHARS_AT_ONCE))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        found = {(r["item_id"], tuple(words(r["text"]))) for r in part.collect()}
        yield Searcher(sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[1])), tolerance)


def matches(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``(doc_id, item_id, item_words, edits)`` for each document and item in it.

    An item is in a document if some passage differs from it by at most ``tolerance`` times its words
    in word edits. Items too short for an edit are looked for as they are. Null texts hold nothing; null
    items and those without words are not looked for; null ids of documents and items are carried along; a
    document repeated is reported each time. Empty tables
    give an empty result; other columns are ignored. The benchmark is searched for in blocks of
    ``ITEMS_AT_ONCE`` items, each against all documents.
    """
    schema = "doc_id long, item_id long, item_words int, edits int"
    picked = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for searcher in _searchers(benchmark, tolerance):
        shared = docs.sparkSession.sparkContext.broadcast(searcher)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s: Searcher = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], s.items[k][0], len(s.coded[k]), e) for d, k, e in s.search(batch.column(1).to_pylist())]
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                    ["doc_id", "item_id", "item_words", "edits"],
                )

        found = picked.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs``, all columns, without the rows whose text an item is in, whatever their ids."""

    def clean(shared):
        @F.pandas_udf("boolean")
        def judge(texts: pd.Series) -> pd.Series:
            out = np.ones(len(texts), bool)
            out[[d for d, _, _ in shared.value.search(texts.tolist())]] = False
            return pd.Series(out)

        return judge

    for searcher in _searchers(benchmark, tolerance):
        docs = docs.filter(clean(docs.sparkSession.sparkContext.broadcast(searcher))("text"))
    return docs
