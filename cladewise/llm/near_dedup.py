"""Near-duplicate classes by bottom-k sketches from one hash function.

A document's sketch is the ``SKETCH`` smallest hashes of its shingles. Inverted lists of retained
values bring documents together, the sketch of a pair's union estimates its similarity and drops
most chance meetings, and the exact Jaccard similarity of the full sets confirms a link.

Documents with equal sets are one node. A linked pair has most of its retained values in common, so
it has one among the rarest few of either; only those are listed, and values that a third of all
documents share are listed only for documents made of little else. Nodes that lists join, one by one
or through others, are a family. A family meets once, whatever the number of its lists. One of more
than ``BLOCK`` nodes first meets in blocks of its longest lists; the nodes that are still apart then meet
block by block, those of its largest component only with the rest. A task hands on a link for each node
at most, never pairs, and no group grows with a list or a family.

Sets of at most three quarters of ``SKETCH`` shingles meet whole sketches only, and none of their links is lost. Larger
ones lose a link of similarity 0.75 if less than ``LEAST_SHARED`` of the retained values are in common,
which is 5 deviations away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import materialize, released, small

WORDS, LEAST_PERCENT = 5, 75
SKETCH = 128
#: Share of the retained values that linked sets have in common at least. Sets of at most
#: 0.75 SKETCH shingles meet whole sketches only and share the exact part.
LEAST_SHARED = 0.55
#: Values that are looked at first, and how many of them a linked document shares with others (fewer
#: with chance 3e-7 in large sets, never in sets of at most so many).
FIRST, FIRST_SHARED = 16, 3
#: Rows of a table of all pairs of a block that are worked on at once.
ROWS_AT_ONCE = 128
#: Nodes and shingles that one group holds of each of the two blocks that meet.
BLOCK, BLOCK_VALUES = 1024, 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Hashes(dict):
    """64-bit hashes of the words seen, forgotten from time to time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``WORDS`` words; one for fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ w[i : len(w) - size + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(31)
    return np.unique(h.view(np.int64))


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, digest, sketch)``: the set's size, a digest of the whole set, its smallest hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "digest", "sketch"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(sketch, "doc_id long, n long, digest binary, sketch array<long>")


def _held(values: DataFrame) -> DataFrame:
    """``(value, times)`` of the values that more than one node has."""
    return values.groupBy("value").agg(F.count("*").alias("times")).filter("times > 1")


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """``(key, node, n)``: the lists of retained values that can join nodes, as a written table.

    A document that shares few of its first values is linked with nothing. Of the others, the values
    are put in order, the rarest first; two sets that share ``least`` of ``m`` share one of the first
    ``m - least + 1`` of either."""
    first = nodes.select(F.explode(F.slice("sketch", 1, FIRST)).alias("value"), "node")
    likely = first.join(_held(first), "value").groupBy("node").agg(F.count("*").alias("shared")).filter(F.col("shared") >= FIRST_SHARED)
    likely = materialize(likely.select("node"))
    values = nodes.join(small(likely), "node", "left_semi").select(F.explode("sketch").alias("value"), "node", "n")
    retained = F.least("n", F.lit(SKETCH))
    least = F.when(F.col("n") <= SKETCH * LEAST_PERCENT // 100, F.ceil(F.col("n") * LEAST_PERCENT / 100)).otherwise(F.floor(retained * LEAST_SHARED))
    ordered = F.array_sort(F.collect_list(F.struct("times", "value")))
    shared = values.join(_held(values), "value").groupBy("node", "n").agg(ordered.alias("v"))
    # Values that no other node has come before all these.
    room = (retained - least + 1 - (retained - F.size("v"))).cast("int")
    keys = materialize(shared.withColumn("room", room).filter("room > 0").select(F.explode(F.slice(F.col("v.value"), F.lit(1), F.col("room"))).alias("key"), "node", "n"))
    several = keys.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key")
    return materialize(keys.join(several, "key", "left_semi"))


def families(lists: DataFrame) -> DataFrame:
    """``(node, family)``: nodes that lists join, directly or through others; named by the smallest."""
    heads = lists.groupBy("key").agg(F.min("node").alias("head"))
    return components(lists.join(heads, "key").select(F.col("node").alias("a"), F.col("head").alias("b"))).withColumnRenamed("component", "family")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, n, shingles)`` of the documents in ``wanted(node)``, as a written table."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                seen = {(i, _digest(s)): (i, len(s), s) for i, s in zip(part.column(0).to_pylist(), sets, strict=True) if len(s)}
                columns = list(zip(*seen.values(), strict=True)) if seen else [[], [], []]
                types = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["node", "n", "shingles"])

    picked = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(small(wanted), "node", "left_semi")
    return materialize(picked.mapInArrow(make, "node long, n long, shingles array<long>"))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # values of one set alone are in no overlap
    on = times[value] > 1
    owner, value = owner[on], column[value[on]]
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for low in range(0, int(value[-1]) + 1 if len(value) else 0, width):
        a, b = np.searchsorted(value, (low, low + width))
        rows, at = np.unique(owner[a:b], return_inverse=True)
        table = np.zeros((len(rows), width), np.float32)
        table[at, value[a:b] - low] = 1
        out[np.ix_(rows, rows)] += table @ table.T
    return out


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Booleans for each two of the sets: their Jaccard similarity is ``LEAST_PERCENT`` or more.

    Sketches decide where they are whole sets. Of others the sketch of the union, which is what both have
    retained up to the smaller of their largest values, drops the unlikely; the full sets decide on the rest."""
    n = np.array([len(s) for s in sets])
    kept = [s[:SKETCH] for s in sets]
    shared, cut = _overlaps(kept), n > SKETCH
    enough = lambda common, p, q: 100 * common >= LEAST_PERCENT * (p + q - common)
    out, near = np.zeros(shared.shape, bool), np.zeros(shared.shape, bool)
    if cut.any():
        last = np.array([s[-1] for s in kept])
        low = np.array([np.searchsorted(s, last, side="right") for s in kept], np.int16)  # of a's values, those up to b's last
        own = np.diag(low)
    for first in range(0, len(sets), ROWS_AT_ONCE):  # a few rows of the tables at once
        r = slice(first, first + ROWS_AT_ONCE)
        out[r] = enough(shared[r], n[r, None], n[None, :])
        if cut.any():
            union = np.where(last[r, None] <= last[None, :], low[:, r].T + own[r, None], low[r] + own[None, :]) - shared[r]
            alike = shared[r] >= (LEAST_SHARED - 0.05) * union
            near[r] = (np.minimum(n[r, None], n[None, :]) * 100 >= np.maximum(n[r, None], n[None, :]) * LEAST_PERCENT) & alike & (cut[r, None] | cut[None, :])
    if cut.any():
        np.fill_diagonal(near, False)
        some = np.flatnonzero(near.any(1))
        place = np.full(len(sets), -1)
        place[some] = np.arange(len(some))
        common = _overlaps([sets[i] for i in some]) if len(some) else None
        for i in range(len(sets)):
            both = cut | cut[i]
            out[i, both] = False
            if place[i] >= 0:
                out[i, some] |= near[i, some] & enough(common[place[i]], n[i], n[some])
    np.fill_diagonal(out, False)
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(unit, node, component, shingles)``, sorted by unit and node: ``(a, b)`` that join the nodes
    of a unit to the smallest one of their component there."""

    def solve(group: list[tuple]) -> list[tuple[int, int]]:
        node, known = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        if len(group) < 2 or (known == known[0]).all():
            return []
        found, free = linked([g[2] for g in group]), np.ones(len(group), bool)
        _, known = np.unique(known, return_inverse=True)
        out = []
        for i in range(len(group)):
            if free[i]:
                reached, new = np.zeros(len(group), bool), np.zeros(len(group), bool)
                new[i] = True
                while new.any():
                    reached |= new
                    new = (found[new].any(0) | np.isin(known, known[new])) & ~reached
                free &= ~reached
                out += [(x, int(node[i])) for x in node[reached].tolist() if x != node[i]]
        return out

    group: list[tuple] = []
    unit = None
    for batch in batches:
        pairs: list[tuple[int, int]] = []
        units, nodes, parts = (batch.column(i).to_pylist() for i in range(3))
        values, ends = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
        for k, u in enumerate(units):
            if u != unit:
                pairs += solve(group)
                group, unit = [], u
            s = values[ends[k] : ends[k + 1]]
            if not (group and group[-1][0] == nodes[k] and np.array_equal(group[-1][2], s)):  # a row that repeats
                group.append((nodes[k], parts[k], s.copy()))
        yield _pairs(pairs)
    yield _pairs(solve(group))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[], []]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b"])


def meetings(rows: DataFrame) -> DataFrame:
    """``(a, b)`` found by :func:`_meet` in the units of ``rows(unit, node, component, shingles)``, as a written table."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("unit", "node", "component", "shingles").repartition(partitions, "unit").sortWithinPartitions("unit", "node")
    return materialize(dealt.mapInArrow(_meet, "a long, b long"))


def _blocks(count: Column, total: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / most), F.ceil(total / BLOCK_VALUES)).cast("int")


def _apart(members: DataFrame, unit: list[str], most: int) -> DataFrame:
    """``members`` with ``of_main``, ``mains``, ``rests`` and ``cost`` of their unit, where it has more than one component."""
    parts = members.groupBy(*unit, "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = parts.groupBy(*unit).agg(
        F.max(F.struct("c", "s", "component")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("parts")
    ).filter("parts > 1")
    rest = F.col("c") - F.col("m.c")
    mains, rests = _blocks(F.col("m.c"), F.col("m.s"), most), _blocks(rest, F.col("s") - F.col("m.s"), most)
    sizes = sizes.select(*unit, F.col("m.component").alias("main"), mains.alias("mains"), rests.alias("rests"), (rest * (mains + rests) + F.col("m.c") * rests).alias("cost"))
    return members.join(sizes, unit).withColumn("of_main", F.col("component") == F.col("main")).drop("main")


def _block_meetings(members: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """Units in which each block of a unit's rest meets each other and each block of its main component."""
    kind = lambda k, i, j: F.struct(F.lit(k).alias("k"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    to = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("of_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    dealt = members.withColumn("own", own)
    across = F.transform(to(F.col("rests")), lambda o: kind(0, F.col("own"), o))
    inside = F.concat(
        F.transform(to(F.col("mains")), lambda o: kind(0, o, F.col("own"))),
        F.transform(to(F.col("rests")), lambda o: kind(1, F.least(F.col("own"), o), F.greatest(F.col("own"), o))),
    )
    dealt = dealt.withColumn("met", F.explode(F.when(F.col("of_main"), across).otherwise(inside)))
    rows = dealt.select(F.xxhash64("unit", "met.k", "met.i", "met.j").alias("unit"), "node", "component")
    return meetings(rows.join(sets, "node"))


def confirmed(lists: DataFrame, sets: DataFrame, most: int = BLOCK) -> DataFrame:
    """``(a, b)`` links that make the components of the nodes in ``lists``; ``most`` nodes meet at once."""
    family = families(lists)
    members = materialize(sets.select("node", "n").join(family, "node"))
    size = members.groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("s")).withColumn("blocks", _blocks(F.col("c"), F.col("s"), most))
    size = materialize(size.select("family", "blocks"))
    whole = members.join(size.filter("blocks = 1"), "family").select(F.xxhash64(F.lit(0), "family").alias("unit"), "node", F.col("node").alias("component"))
    # Nodes of a larger family meet where their longest list is.
    large = materialize(lists.join(members.join(size.filter("blocks > 1"), "family").select("node", "family").distinct(), "node"))
    length = large.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("s")).withColumn("blocks", _blocks(F.col("c"), F.col("s"), most))
    place = large.join(length, "key").groupBy("node").agg(F.max(F.struct("c", "key", "blocks")).alias("l"))
    placed = place.select(F.xxhash64(F.lit(1), "l.key", F.pmod(F.xxhash64("node"), F.col("l.blocks"))).alias("unit"), "node", F.col("node").alias("component"))
    found = meetings(whole.unionByName(placed).join(sets, "node"))
    if large.isEmpty():
        return found
    known = large.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = materialize(known)
    by_list = _apart(known.withColumnRenamed("key", "unit"), ["unit"], most)
    once = known.select("node", "n", "family", "component").distinct().withColumn("unit", F.col("family"))
    by_family = _apart(once, ["unit"], most)
    # A family that few long lists make meets as one; one that many short lists chain meets by list.
    list_cost = by_list.groupBy("unit", "family").agg(F.first("cost").alias("cost")).groupBy("family").agg(F.sum("cost").alias("list_cost"))
    family_cost = by_family.groupBy("family").agg(F.first("cost").alias("family_cost"))
    chained = materialize(list_cost.join(family_cost, "family").select("family", (F.col("list_cost") < F.col("family_cost")).alias("chained")))
    dealt = by_list.join(chained.filter("chained"), "family").unionByName(by_family.join(chained.filter("not chained"), "family"))
    return found.unionByName(_block_meetings(dealt, sets, most))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Linked are texts whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.
    A null text is empty; empty texts are linked with nothing. A null ``doc_id`` is linked with
    nothing, has a null component and is kept. Rows that repeat an id are one document, whose texts
    share a component. An empty table gives an empty result; other columns are ignored.
    """
    lean = materialize(sketches(docs, id_col, text_col))
    usable = lean.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = materialize(usable.groupBy("digest", "n").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")))
    rows = materialize(lean.select("doc_id", "n", "digest"))
    released(lean)
    lists = inverted_lists(nodes)
    classes = materialize(nodes.select("digest", F.col("n").alias("size"), "node"))
    released(nodes)
    sets = full_sets(docs, lists.select("node").distinct(), id_col, text_col)
    found = confirmed(lists, sets, most)
    r, c = rows.alias("r"), classes.alias("c")
    member = r.join(c, (F.col("r.digest") == F.col("c.digest")) & (F.col("r.n") == F.col("c.size")) & F.col("r.doc_id").isNotNull(), "left")
    member = materialize(member.select("r.doc_id", F.col("r.n").alias("n_shingles"), "c.node"))
    # Different texts of one id.
    again = member.filter("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    several = member.join(again.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    component = components(found.unionByName(several))
    out = member.join(component, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that are not their component's smallest id."""
    dropped = materialize(near_duplicates(docs).filter("not kept").select("doc_id").distinct())
    return docs.join(small(dropped), "doc_id", "left_anti")
