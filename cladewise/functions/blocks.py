"""Sites of whole genes as arrays, within a task.

A batch of genes is gone through in blocks of sites: a row of codes for each slot, a column for each site. Rules count one
kind of residue after the other, at all sites of a block at once; they give what the column functions of
:mod:`.residues` give for one site. A slot whose sequence has ended holds a kind of its own, the empty residue.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .residues import GAP, MISSING, UNKNOWN, WORD

#: Residues that a block holds at once.
CELLS = 1 << 21


class Block(NamedTuple):
    """``row`` of the batch and ``pos`` of each site, ``res`` by slot and site, ``out`` the outgroup's residue where
    ``told``, and the codes that the batch has, the empty residue's last."""

    row: np.ndarray
    pos: np.ndarray
    res: np.ndarray
    out: np.ndarray | None
    told: np.ndarray | None
    kinds: np.ndarray

    @property
    def empty(self) -> int:
        return int(np.iinfo(self.res.dtype).max)

    def residue(self, code: int) -> str:
        return "" if code == self.empty else chr(code)

    def named(self, *residues: str) -> list[int]:
        return [k for k in self.kinds if self.residue(k) in residues]

    def count(self, kind: int, slots: slice = slice(None)) -> np.ndarray:
        """How many of the slots have a kind of residue, by site."""
        part = self.res[slots] == kind
        return part.view(np.uint8).sum(0, dtype=np.uint8 if len(part) < 250 else np.int32)


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One code per letter of all texts, the empty residue's after the last; where each text starts, its length."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if len(data) and data.max() >= 128:
        words = [x or "" for x in texts.to_pylist()]
        ends, data = np.cumsum([0, *map(len, words)]), np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return np.append(data, np.iinfo(data.dtype).max).astype(data.dtype), ends[:-1], np.diff(ends)


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one width; the empty residue is the widest code of either."""
    if a.dtype == b.dtype:
        return a, b
    wide = lambda x: x if x.dtype == np.uint32 else np.where(x == 255, np.iinfo(np.uint32).max, x).astype(np.uint32)
    return wide(a), wide(b)


def _kinds(*codes: np.ndarray) -> np.ndarray:
    if codes[0].dtype == np.uint8:
        seen = np.zeros(256, bool)
        for x in codes:
            seen[x] = True
        return np.flatnonzero(seen)
    return np.unique(np.concatenate(codes)).astype(np.int64)


def slots_by_row(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    return lists.offsets.to_numpy(), lists.values


def blocks(batch: pa.RecordBatch, column: str = "seqs") -> Iterator[Block]:
    """All sites of a batch; a block's rows have one number of slots."""
    offsets, texts = slots_by_row(batch.column(column))
    data, start, size = _codes(texts)
    n = batch.column("n").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    outs = batch.column("out") if "out" in batch.schema.names else None
    if outs is not None:
        out_data, out_start, out_size = _codes(outs.cast(pa.string()))
        data, out_data = _alike(data, out_data)
        told = outs.is_valid().to_numpy(zero_copy_only=False)
    kinds = _kinds(data, *([] if outs is None else [out_data]))

    def letters(data: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray, count: np.ndarray, pos: np.ndarray) -> np.ndarray:
        at = np.repeat(start, count) + pos
        return data[at if (size >= n[rows]).all() else np.where(pos < np.repeat(size, count), at, len(data) - 1)]

    slots = np.diff(offsets)
    for k in np.unique(slots):
        wanted = np.flatnonzero((slots == k) & (n > 0))
        ends = np.cumsum(n[wanted])
        step = max(1, CELLS // max(1, int(k)))
        for low in range(0, int(ends[-1]) if len(ends) else 0, step):
            high = min(low + step, int(ends[-1]))
            part = slice(np.searchsorted(ends, low, "right"), np.searchsorted(ends, high - 1, "right") + 1)
            rows, last = wanted[part], ends[part]
            first = last - n[rows]
            count = np.minimum(last, high) - np.maximum(first, low)
            pos = np.arange(low, high) - np.repeat(first, count)
            res = np.empty((int(k), high - low), data.dtype)
            for s in range(int(k)):
                place = offsets[rows] + s
                res[s] = letters(data, start[place], size[place], rows, count, pos)
            row = np.repeat(rows, count)
            out = None if outs is None else letters(out_data, out_start[rows], out_size[rows], rows, count, pos)
            yield Block(row, pos, res, out, None if outs is None else told[row], kinds)


def _tallies(b: Block, left_out: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many residues a site has without those left out, and how often it has the commonest."""
    total = most = np.zeros(b.res.shape[1], np.uint8 if len(b.res) < 250 else np.int32)
    for kind in b.kinds:
        if kind not in left_out:
            n = b.count(kind)
            total, most = total + n, np.maximum(most, n)
    return total, most


def variable(b: Block) -> np.ndarray:
    total, most = _tallies(b, b.named(GAP, ""))
    return (most >= 2) & (most + 2 <= total)


def informative(b: Block, min_count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By residue that becomes a feature somewhere: its code, the sites, and how many slots have it there."""
    gap = b.named(GAP)
    total, most = _tallies(b, gap)
    good = variable(b) & (most + 2 <= total)
    for kind in b.kinds:
        if kind not in gap:
            n = b.count(kind)
            at = np.flatnonzero(good & (n >= min_count))
            if len(at):
                yield int(kind), at, n[at]


def masks(b: Block, kind: int, at: np.ndarray) -> np.ndarray:
    """Slot bits of a residue, a row per word of ``WORD`` slots."""
    words = np.zeros((max(1, -(-len(b.res) // WORD)), len(at)), np.int64)
    for s, res in enumerate(b.res):
        words[s // WORD] |= (res[at] == kind).astype(np.int64) << (s % WORD)
    return words


def cancelled(b: Block, intact: np.ndarray, outgroup: bool, min_pairs: int, only_partner: bool, tri_allelic: bool) -> np.ndarray:
    """Residues after gap cancellation; ``intact`` is by site the gene's number of pairs with both species."""
    n, code = len(b.res), ord(GAP)
    holes = b.res == code
    gap = holes.any(0)
    if only_partner:
        lost = [holes[i : i + 2].any(0) for i in range(0, n, 2)]
        left = n - n // 2 - np.sum(lost, axis=0) if lost else np.zeros(len(b.pos), int)
        dead = gap & (left < min_pairs)
        step = b.res.copy()
        for i in range(n):
            step[i][lost[i // 2]] = code
    else:
        step, dead = b.res.copy(), gap
    step[:, dead] = code
    if outgroup:
        dead = dead | (b.told & (b.out != code) & (step[1::2] != b.out).any(0))
    if tri_allelic and n == 4:
        kinds = np.zeros(len(b.pos), int)
        for kind in {*b.kinds.tolist(), code}:
            kinds += (step == kind).any(0)
        dead = dead | (kinds == 3)
    if n % 2 == 0:
        dead = dead | (intact < min_pairs)
    step[:, dead] = code
    return step


def intact_pairs(missing: pa.ListArray) -> np.ndarray:
    """Pairs with both species in the alignment, by row."""
    offsets, values = slots_by_row(missing)
    here = ~np.append(values.fill_null(True).to_numpy(zero_copy_only=False), True)
    size, out = np.diff(offsets), np.zeros(len(missing), np.int64)
    for i in range(0, int(size.max(initial=0)), 2):
        at = np.minimum(offsets[:-1] + i, len(here) - 2)
        out += (i + 1 < size) & here[at] & here[at + 1]
    return out


def texts(rows: np.ndarray, codes: np.ndarray, count: int) -> pa.Array:
    """Codes of sites, sorted by row, as one text for each of ``count`` rows; empty residues go."""
    kept = codes != np.iinfo(codes.dtype).max
    n = np.bincount(rows[kept], minlength=count)
    if codes.dtype == np.uint8:
        ends = np.append(0, np.cumsum(n))
        return pa.LargeStringArray.from_buffers(count, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(codes[kept]))).cast(pa.string())
    whole, ends = codes[kept].tobytes().decode("utf-32-le"), np.append(0, np.cumsum(n))
    return pa.array([whole[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.string())


class Sides(NamedTuple):
    """What the site counter asks of a site: ancestral and other residues of a side, where some other is shared by two of it, the score."""

    score: np.ndarray
    size: tuple[np.ndarray, np.ndarray]
    old: tuple[np.ndarray, np.ndarray]
    shared: tuple[np.ndarray, np.ndarray]
    kinds: tuple[np.ndarray, np.ndarray]


def sides(b: Block, ancestral, missing: tuple[str, ...] = MISSING) -> Sides:
    """Convergent and control residues that occur twice on both sides together and are none of ``missing``;
    ``ancestral(kind)`` is by site whether a residue is."""
    k, zero = np.int16 if len(b.res) < 10_000 else np.int32, b.res.shape[1]
    size, old, kinds = ([np.zeros(zero, k), np.zeros(zero, k)] for _ in range(3))
    shared, score = [np.zeros(zero, bool), np.zeros(zero, bool)], np.zeros(zero, k)
    for kind in b.kinds:
        n = [b.count(kind, slice(i, None, 2)).astype(k) for i in (0, 1)]
        letter = b.residue(int(kind))
        if letter == GAP:
            score -= n[0] + n[1]
        if letter == GAP or letter == UNKNOWN:
            continue
        lone = n[0] + n[1] == 1
        for x in n:
            x[lone] = 0
        if letter not in MISSING:
            score += np.abs(n[0] - n[1])
        if letter in missing:
            continue
        is_old = ancestral(int(kind))
        for i in (0, 1):
            size[i] += n[i]
            old[i] += np.where(is_old, n[i], 0)
            kinds[i] += n[i] > 0
            shared[i] |= ~is_old & (n[i] >= 2)
    return Sides(np.maximum(score, 0), tuple(size), tuple(old), tuple(shared), tuple(kinds))


def ancestral_sets(b: Block, levels: list[list[list[int]]], bits: dict[str, int], node: np.ndarray) -> np.ndarray:
    """What the node of each site may have, by parsimony over all leaves (the block's slots): a node has what all its
    children with known residues share, or else what any has."""
    found = []
    for res in b.res:
        one = np.zeros(len(b.pos), np.int64)
        for kind in b.kinds:
            bit = bits.get(b.residue(int(kind)), 0)
            if bit:
                one[res == kind] = bit
        found.append(one)
    for level in levels:
        made = []
        for children in level:
            both, either = np.full(len(b.pos), -1, np.int64), np.zeros(len(b.pos), np.int64)
            for c in children:
                both &= np.where(found[c] != 0, found[c], -1)
                either |= found[c]
            made.append(np.where((both != 0) & (either != 0), both, either))
        found += made
    out = np.zeros(len(b.pos), np.int64)
    for k in np.unique(node):
        at = node == k
        out[at] = found[k][at]
    return out
