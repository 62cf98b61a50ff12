"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words is their gap-weighted common letter triples (letters of a triple lie within
``SPAN`` places; each skipped place costs ``DECAY``), normalised, to the power ``DEGREE``. An insult with dots or letters put
in still shares most triples. A sentence's features are its words' best kernel values with each
landmark, mapped through the inverse root of the landmarks' kernel matrix; the SVM is linear there.
A document is as toxic as its worst sentence.

Words like no landmark are told by a bound that one look-up per triple gives, and then by one from
the few landmarks that have a triple.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import bounded_sample, remainder

SPAN, DECAY, SYMBOLS, DEGREE = 6, 0.7, 32, 3
#: Landmark words at most, labelled documents at most that train.
LANDMARKS, FIT_ROWS = 96, 16_000
#: A landmark's least log-likelihood ratio between toxic and clean documents, and the kernel value
#: with an earlier landmark that makes it superfluous.
LEAST_RATIO, TOO_LIKE = 20.0, 0.343
THRESHOLD = 0.7
#: Longer runs without white space are read in overlapping pieces of this size.
LONGEST = 24
#: Length of the parts in which letters set apart by blanks are read.
SPELT = 10
#: Words whose likeness is bounded at once.
AT_ONCE = 10_000
#: Kernel values (before the power) under this count as none, so that few words need more than a look.
LEAST_LIKE = 0.35
#: Words that a worker remembers.
CACHE = 400_000

_SIGNS = ".,;:!?\"'()[]{}<>*_-"
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """a-z are 1-26, other letters share 27-30; digits and signs are 31, the word break is 0."""
    letters = [x >= 0x3000 or chr(x).isalpha() for x in range(0x110000)]
    table = np.where(letters, 27 + np.arange(0x110000) % 4, 31).astype(np.int64)
    table[97:123] = np.arange(1, 27)
    table[10] = 0
    return table


def words_of(text: str | None) -> list[str]:
    """Lower-case words in order; the end of a line is a word of its own that ends a sentence."""
    return (text or "").lower().replace("\n", " . ").split()


def _pieces(word: str) -> list[str]:
    """A word, a very long one in parts, and what remains of it without signs put between letters."""
    if len(word) <= LONGEST and word.isalpha():
        return [word]
    half, bare = LONGEST // 2, word.strip(_SIGNS)
    found = [word] if bare.isalpha() or not bare else [word, "".join(filter(str.isalpha, bare))]
    return [w[i : i + LONGEST] for w in found for i in (range(0, len(w) - half, half) if len(w) > LONGEST else (0,))]


def _spelt(word: str) -> list[str]:
    """Overlapping parts of a word made of letters set apart, each about as long as a landmark."""
    return [word[i : i + SPELT] for i in (range(0, len(word), SPELT // 3) if len(word) > SPELT else (0,))]


def _raw_triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, triple, weight) of all letter triples, repeated ones apart."""
    flat = _symbols()[np.frombuffer("\n".join(w.strip(_SIGNS).replace("\n", "") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.cumsum(flat == 0)
    found = []
    for a, b in _OFFSETS:
        if len(flat) > b:
            i = np.flatnonzero((owner[:-b] == owner[b:]) & (flat[:-b] > 0))
            found.append((owner[i], (flat[i] * SYMBOLS + flat[i + a]) * SYMBOLS + flat[i + b], np.full(len(i), DECAY ** (b - 2))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised kernel features of words: (word number, triple, value), sorted by word."""
    word, triple, weight = _raw_triples(words)
    key, at = np.unique(word * SYMBOLS**3 + triple, return_inverse=True)
    value = np.bincount(at, weight, len(key))
    word, triple = key // SYMBOLS**3, key % SYMBOLS**3
    norm = np.sqrt(np.bincount(word, value * value, len(words)))
    return word, triple, value / norm[word]


def kernel_table(landmarks: list[str]) -> np.ndarray:
    """(triples, landmarks): a word's kernel with each landmark is its features times this."""
    table = np.zeros((SYMBOLS**3, len(landmarks)), np.float32)
    word, triple, value = triples(landmarks)
    table[triple, word] = value
    return table


def kernel(words: list[str], table: np.ndarray) -> np.ndarray:
    """(words, landmarks) kernel values; those under ``LEAST_LIKE`` before the power are 0."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    word, triple, value = triples(words)
    if len(word):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        for lo in range(0, len(starts), 2000):  # bounded memory
            first, last = starts[lo], starts[lo + 2000] if lo + 2000 < len(starts) else len(word)
            rows = table[triple[first:last]] * value[first:last, None].astype(np.float32)
            out[word[starts[lo : lo + 2000]]] = np.add.reduceat(rows, starts[lo : lo + 2000] - first, axis=0)
    return np.where(out >= LEAST_LIKE, out, 0) ** DEGREE


def _best(pieces: list[tuple[int, str]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best kernel values of each owner's pieces that are like a landmark, and the owners, in order."""
    values, own = kernel([p for _, p in pieces], table), np.array([k for k, _ in pieces])
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    values, own = np.maximum.reduceat(values, starts, axis=0), own[starts]
    like = values.any(1)
    return values[like], own[like]


class _Memory:
    """Words met so far, each with a code: four times its row of kernel values (0: like no landmark),
    plus 2 if it is one character, plus 1 if it ends a sentence. Forgotten when full."""

    def __init__(self, table: np.ndarray):
        self.table, self.most = table, table.max(1, initial=0)
        triple, self.landmark = np.nonzero(table)
        self.value, self.held = table[triple, self.landmark].astype(np.float64), np.bincount(triple, minlength=len(table))
        self.start = np.cumsum(self.held) - self.held
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.values = np.zeros((1, self.table.shape[1]), np.float32)

    def look(self, found: list[str]) -> np.ndarray:
        new = list(set(found).difference(self.codes))
        if len(self.codes) + len(new) > CACHE:
            self._forget()
            new = list(set(found))
        if new:
            self._learn(new)
        return np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found))

    def _near(self, words: list[str]) -> np.ndarray:
        """Numbers of the words that may be like a landmark. The norm takes repeated triples apart,
        which makes it smaller and so each kernel value a bound: first each triple as in its best
        landmark, then landmark by landmark."""
        word, triple, weight = _raw_triples(words)
        norm = np.maximum(np.sqrt(np.bincount(word, weight * weight, len(words))), 1e-12)
        left = np.bincount(word, weight * self.most[triple], len(words)) >= LEAST_LIKE * norm
        on = np.flatnonzero(left[word] & (self.held[triple] > 0))
        word, triple, weight = word[on], triple[on], weight[on]
        times = self.held[triple]
        at = np.arange(times.sum()) + np.repeat(self.start[triple] - (np.cumsum(times) - times), times)
        size = self.table.shape[1]
        common = np.bincount(np.repeat(word, times) * size + self.landmark[at], np.repeat(weight, times) * self.value[at], len(words) * size)
        return np.flatnonzero(common.reshape(-1, size).max(1, initial=0) >= (LEAST_LIKE - 1e-6) * norm)

    def _learn(self, new: list[str]) -> None:
        pieces = [(i, p) for i, w in enumerate(new) for p in _pieces(w)]
        near = [low + k for low in range(0, len(pieces), AT_ONCE) for k in self._near([p for _, p in pieces[low : low + AT_ONCE]]).tolist()]
        rows = np.zeros(len(new), np.int64)
        if near:
            values, own = _best([pieces[k] for k in near], self.table)
            rows[own] = np.arange(len(own)) + len(self.values)
            self.values = np.concatenate([self.values, values])
        self.codes.update(zip(new, [4 * r + 2 * (len(w) == 1) + (w[-1] in ".!?") for r, w in zip(rows.tolist(), new, strict=True)], strict=True))


def sentence_features(texts: list[str | None], memory: _Memory) -> tuple[np.ndarray, np.ndarray]:
    """Best kernel value with each landmark of each sentence that has a word like one, and the number
    of the text that each is of."""
    split = [words_of(t) for t in texts]
    found = [x for w in split for x in (*w, ".")]  # a text ends a sentence
    code = memory.look(found)
    text = np.repeat(np.arange(len(split)), [len(w) + 1 for w in split])
    sentence = np.cumsum(code & 1) - (code & 1)
    hit = np.flatnonzero(code > 3)
    rows, at = memory.values[code[hit] >> 2], hit
    # Three or more single characters set apart by blanks are read as one word as well.
    single = np.concatenate(([False], code & 2 > 0, [False]))
    edges = np.flatnonzero(single[1:] != single[:-1])
    spelt = [(a, "".join(found[a:b])) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a > 2]
    if spelt:
        more, place = _best([(a, p) for a, w in spelt for p in _spelt(w)], memory.table)
        rows, at = np.concatenate([rows, more]), np.concatenate([at, place])
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
    if not len(at):
        return np.zeros((0, memory.table.shape[1]), np.float32), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], sentence[at][1:] != sentence[at][:-1])))
    return np.maximum.reduceat(rows, starts, axis=0), text[at[starts]]


def choose_landmarks(train: DataFrame, n: int = LANDMARKS) -> list[str]:
    """Words that set toxic documents apart, by counts over all training rows; none too like another.

    The driver gets a fixed number of candidate words, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w.strip(_SIGNS), y) for t, y in zip(batch["text"], batch["toxic"], strict=True) for w in set(words_of(t))]
            yield pd.DataFrame(rows, columns=["word", "toxic"]).astype({"toxic": int})

    counts = (
        train.select("text", "toxic").mapInPandas(count, "word string, toxic int").filter(F.length("word").between(3, LONGEST))
        .groupBy("word").agg(F.sum("toxic").cast("double").alias("p"), F.sum(1 - F.col("toxic")).cast("double").alias("q"))
        .filter("p >= 2")
    )
    kinds = {r["toxic"]: float(r["n"]) for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = kinds.get(1, 0.0), kinds.get(0, 0.0)
    share, p, q = toxic / max(toxic + clean, 1), F.col("p"), F.col("q")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (
        part(p, (p + q) * share) + part(q, (p + q) * (1 - share))
        + part(toxic - p, (toxic + clean - p - q) * share) + part(clean - q, (toxic + clean - p - q) * (1 - share))
    )
    marked = counts.filter(p * clean > 3 * (q + 0.5) * toxic).withColumn("ratio", ratio).filter(F.col("ratio") > LEAST_RATIO)
    words = [r["word"] for r in marked.orderBy(F.desc("ratio"), "word").limit(20 * n).collect()]
    chosen: list[str] = []
    if words:
        like, free = kernel(words, kernel_table(words)), np.ones(len(words), bool)
        for i in range(len(words)):
            if free[i] and len(chosen) < n and like[i, i] > 0:
                chosen.append(words[i])
                free &= like[:, i] < TOO_LIKE
    return chosen


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 400) -> np.ndarray:
    """Weights and bias of a linear SVM, squared hinge loss with balanced classes, by accelerated
    gradient descent."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    s, cost = 2 * y - 1, np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * 100 * c
    rate = 1 / (1 + 2 * np.linalg.norm(z * np.sqrt(cost)[:, None], 2) ** 2)
    w = v = np.zeros(z.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - s * (z @ v))
        step = v - rate * (np.append(v[:-1], 0) - 2 * z.T @ (cost * s * slack))
        v, w = step + k / (k + 3) * (step - w), step
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict | float:
    """Landmarks, weights and calibration; a constant if the labels are not of both kinds."""
    marks = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    marks = bounded_sample(marks, fit_rows)
    seen = [r["toxic"] for r in marks.select("toxic").distinct().collect()]
    if len(seen) < 2:
        return float(seen[0]) if seen else 0.0
    train = docs.select("doc_id", "text").join(marks, "doc_id").select("text", "toxic")
    landmarks = choose_landmarks(train)
    if not landmarks:
        return 0.0
    table = kernel_table(landmarks)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # SYMBOLS^3 x LANDMARKS numbers

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = _Memory(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                x, of = sentence_features(list(part["text"]), memory)
                y = part["toxic"].to_numpy(int)
                # Of each document its sentence nearest to the landmarks; of a clean one, another too.
                rows = []
                for i in range(len(part)):
                    own = np.flatnonzero(of == i)
                    near = x[own[x[own].max(1).argmax()]] if len(own) else np.zeros(x.shape[1], np.float32)
                    rows.append((near, int(y[i]), True))
                    if not y[i] and len(own) > 1:
                        rows.append((x[own[len(own) // 2]], 0, False))
                yield pd.DataFrame(rows, columns=["x", "toxic", "worst"])

    rows = train.mapInPandas(features, "x array<float>, toxic int, worst boolean").toPandas()  # bounded by fit_rows
    x, y, worst = np.array(rows["x"].tolist(), np.float32), rows["toxic"].to_numpy(float), rows["worst"].to_numpy(bool)
    # Landmarks with a strange letter put in are sentences of their own, so that the SVM learns how
    # near is near enough.
    spoilt = [w[: len(w) // 2] + "x" + w[len(w) // 2 :] for w in landmarks if len(w) >= 5]
    variants = kernel(spoilt, table)
    variants = np.repeat(variants, max(1, int(y.sum()) // (2 * max(len(variants), 1))), axis=0)
    x, y, worst = np.vstack([x, variants]), np.append(y, np.ones(len(variants))), np.append(worst, np.ones(len(variants), bool))
    values, axes = np.linalg.eigh(kernel(landmarks, table).astype(np.float64))
    root = axes / np.sqrt(np.maximum(values, 1e-3)) @ axes.T  # Nyström map
    w = train_svm(x @ root, y)
    margin = x[worst] @ root @ w[:-1] + w[-1]
    # Platt: a logistic curve over the margins of whole documents.
    a, b, t = 1.0, 0.0, y[worst]
    for _ in range(100):  # Newton steps
        e = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        bend = np.maximum(e * (1 - e), 1e-6)
        hessian = np.array([[bend @ margin**2 + 1e-3, bend @ margin], [bend @ margin, bend.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(e - t) @ margin, (e - t).sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return {"table": table, "weights": root @ w[:-1], "bias": w[-1], "a": a, "b": b, "landmarks": landmarks}


def score(docs: DataFrame, model: dict | float) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; empty texts count as the mildest sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        memory = None if isinstance(model, float) else _Memory(model["table"])
        for texts in parts:
            if memory is None:
                yield pd.Series(model, index=texts.index, dtype=float)
                continue
            found = [np.zeros(0)]
            for at in range(0, len(texts), 64):
                part = list(texts.iloc[at : at + 64])
                x, of = sentence_features(part, memory)
                margin = np.full(len(part), model["bias"])
                if len(of):
                    np.maximum.at(margin, of, x @ model["weights"] + model["bias"])  # other sentences have the bias
                found.append(1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -60, 60))))
            yield pd.Series(np.concatenate(found))

    return docs.withColumn("score", judge("text"))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Labels of rows with ``crc32(doc_id) mod 3 = 1`` are never used; null labels and null ids neither.
    A null text is empty. Without labels of both kinds the score is constant. Repeated rows are
    scored each; an empty table gives an empty result; other columns are ignored.
    """
    picked = docs.select("doc_id", "text")
    scored = score(picked, fit(picked, labels, fit_rows))
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
