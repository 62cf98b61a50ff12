"""Decontamination against an exact search of all places, and measured recall on edited items."""

import random

from cladewise.llm import decontaminate as dc


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_recall_and_no_false_reports(spark):
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(60)] + [f"r{k}" for k in range(3000)]
    prose = lambda n: [rng.choice(vocabulary[:60] if rng.random() < 0.5 else vocabulary) for _ in range(n)]
    items = [prose(rng.choice((14, 25, 40, 59))) for _ in range(60)]
    rows, truth, near = [], set(), 0
    for d in range(400):
        text = prose(rng.randrange(0, 400))
        if d % 2:
            k = rng.randrange(60)
            copy = list(items[k])
            for _ in range(int(0.12 * len(copy)) if d % 4 == 1 else 0):
                at, how = rng.randrange(len(copy)), rng.randrange(3)
                copy[at : at + (how != 0)] = [rng.choice(vocabulary)] if how != 1 else []
            at = rng.randrange(len(text) + 1)
            text[at:at] = copy
        rows.append((d, text))
        for k, item in enumerate(items):
            if d % 2 and edits(item, text) <= int(0.2 * len(item)):
                truth.add((d, k))
    docs = spark.createDataFrame([(d, " ".join(t).upper() + ".", 1) for d, t in rows] + [(-1, None, 1)], "doc_id long, text string, edits int")
    bench = spark.createDataFrame([(k, "  ".join(t)) for k, t in enumerate(items)] + [(99, None), (98, "too short")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in dc.matches(docs, bench).collect()}
    for (d, k), e in found.items():
        assert e == edits(items[k], rows[d][1])
    assert set(found) <= truth
    assert len(found) >= 0.97 * len(truth)
    exact = {(d, k) for d, k in truth if edits(items[k], rows[d][1]) == 0}
    assert exact <= set(found)
    kept = {r["doc_id"] for r in dc.drop_contaminated(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in found} | {-1}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.matches(docs, bench).count() == 0
    assert dc.matches(docs.limit(0), bench).count() == 0


def test_recall_of_edited_items_at_the_full_tolerance(spark):
    rng = random.Random(7)
    items = [[f"w{rng.randrange(4000)}" for _ in range(n)] for n in (15, 20, 23, 24, 30, 40, 59) for _ in range(8)]
    rows, truth = [], set()
    for k, item in enumerate(items):
        n, most = len(item), int(0.2 * len(item))
        for where in ("start", "middle", "end", "both", "random"):
            half = most // 2
            at = {"start": range(most), "middle": range(n // 2, n // 2 + most), "end": range(n - most, n), "both": [*range(half), *range(n // 2, n // 2 + most - half)], "random": rng.sample(range(n), most)}[where]
            for how in ("changed", "dropped", "put in"):
                copy = [y for i, x in enumerate(item) for y in ([x] if i not in at else {"changed": ["new"], "dropped": [], "put in": ["new", x]}[how])]
                rows.append((len(rows), " ".join(["z"] * rng.randrange(30) + copy + ["z"] * rng.randrange(30))))
                truth.add((len(rows) - 1, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in dc.matches(docs, bench).collect()}
    assert set(found) <= truth and len(found) >= 0.99 * len(truth)
    assert all(e == edits(items[k], rows[d][1].split()) for (d, k), e in found.items())


def test_short_items_and_scripts_without_blanks(spark):
    chinese, thai = "水在标准大气压下的沸点是多少摄氏度？请选择正确答案。", "เมืองหลวงของประเทศไทยคือเมืองใด"
    edited = chinese.replace("多少", "几")
    rows = [(1, "So: the ANSWER is four."), (2, "the answer was four"), (3, f"前言，{chinese}后记"), (4, f"前言{edited}后记"), (5, "完全不同的一段文字，没有关系。"), (6, f"ก่อน{thai}หลัง")]
    items = [(1, "The answer is four"), (2, chinese), (3, thai), (4, "one two three four five"), (5, "?!"), (6, "四")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in dc.matches(docs, bench).collect()}
    assert found == {(1, 1): 0, (3, 2): 0, (4, 2): 2, (6, 3): 0}
    assert dc.words("A水b，東京 x กำ กี่") == [x.encode() for x in ("a", "水", "b", "東", "京", "x", "ก", "ำ", "กี่")]


def test_other_tolerances(spark):
    rng = random.Random(9)
    items = [[f"w{rng.randrange(4000)}" for _ in range(20)] for _ in range(20)]
    rows = []
    for k, item in enumerate(items):
        at = set(rng.sample(range(20), 8))
        rows += [(k, "z " + " ".join("new" if i in at else x for i, x in enumerate(item))), (100 + k, "z z " + " ".join(item) + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in dc.matches(docs, bench, 0.4).collect()}
    assert sum(found.get((k, k)) == 8 for k in range(20)) >= 19 and all(found[100 + k, k] == 0 for k in range(20))
    assert {(r["doc_id"], r["item_id"]) for r in dc.matches(docs, bench, 0.0).collect()} == {(100 + k, k) for k in range(20)}


def test_null_ids_and_shared_ids(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(None, f"x {item} y", "a"), (None, "clean", "b"), (5, item, "c"), (5, "clean too", "d"), (5, item, "e")], "doc_id long, text string, __x string")
    bench = spark.createDataFrame([(None, item), (0, item), (3, None)], "item_id long, text string")
    found = sorted(((r["doc_id"] or -1), -1 if r["item_id"] is None else r["item_id"]) for r in dc.matches(docs, bench).collect())
    assert found == [(-1, -1), (-1, 0), (5, -1), (5, -1), (5, 0), (5, 0)]
    assert sorted(r["__x"] for r in dc.drop_contaminated(docs, bench).collect()) == ["b", "d"]


def templated(rng, n, words=16, template=9):
    head = [f"t{k}" for k in range(template)]
    return head, [head + [f"w{rng.randrange(3000)}" for _ in range(words)] for _ in range(n)]


def test_items_with_a_common_beginning_are_found_exactly(spark, monkeypatch):
    """Against all edit distances; templates are shared by many items, in every text, alone and with an item's rest."""
    monkeypatch.setattr(dc, "SHARED", 8)
    rng = random.Random(21)
    items = [x for words, template in ((16, 9), (4, 9), (6, 20), (3, 5)) for x in templated(rng, 60, words, template)[1]]
    items += [[*"what is the sum of".split(), f"n{i}", "and", f"n{j}"] for i in range(12) for j in range(12)]
    rows = []
    for d in range(150):
        text = []
        for _ in range(3):
            item = rng.choice(items)
            copy = list(item)
            for _ in range(rng.choice((0, 0, 1, int(0.2 * len(item))))):
                at, how = rng.randrange(len(copy)), rng.randrange(3)
                copy[at : at + (how != 0)] = [f"x{rng.randrange(999)}"] if how != 1 else []
            text += [f"z{rng.randrange(99)}" for _ in range(rng.randrange(12))] + (copy if rng.random() < 0.7 else [*item[:9], "other", "words", "go", "on", "here", "now"])
        rows.append((d, text))
    truth = {(d, k): e for d, t in rows for k, item in enumerate(items) if len(set(t) & set(item)) >= 2 for e in [edits(item, t)] if e <= int(0.2 * len(item))}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in dc.matches(docs, bench).collect()}
    assert set(found) <= set(truth) and all(truth[k] == e for k, e in found.items())
    assert len(found) >= 0.98 * len(truth) and all(k in found for k, e in truth.items() if e == 0)


def test_work_does_not_grow_with_items_times_occurrences():
    import time

    rng = random.Random(22)
    head, items = templated(rng, 4000)
    searcher = dc.Searcher([(k, [x.encode() for x in item]) for k, item in enumerate(items)])
    word = lambda: f"w{rng.randrange(3000)}"  # noqa: E731  (any item's)
    for n in (400, 1600):
        crowded = " ".join(" ".join([*head, *(word() for _ in range(16))]) for _ in range(n)) + " " + " ".join(items[7])
        start = time.time()
        assert [(k, e) for _, k, e in searcher.search([crowded])] == [(7, 0)]
        assert time.time() - start < 3 * n / 400
