"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Word vectors come from the whole corpus: each word adds the sparse random index vectors of its
neighbours to its own vector. The network is trained in numpy on a bounded sample of labelled
documents, and a temperature fitted on a part of it calibrates the probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import bounded_sample, remainder
from .scratch import fresh

#: Hashed vocabulary, vector size, non-zero places of an index vector, neighbours on each side.
BUCKETS, DIMENSIONS, PLACES, REACH = 8192, 64, 2, 2
#: Labelled rows at most that train the network; hidden units; passes.
FIT_ROWS, HIDDEN, EPOCHS, SEED = 16_000, 32, 300, 11
THRESHOLD = 0.7

_WORD = re.compile(r"\w+|[^\w\s]+")


class _Buckets(dict):
    """Bucket of each word seen, forgotten from time to time."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = b = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


_buckets = _Buckets()


def words(text: str | None) -> np.ndarray:
    """Buckets of a text's words and runs of symbols, in order."""
    found = _WORD.findall(text or "")
    return np.fromiter(map(_buckets.__getitem__, found), np.int64, len(found))


def index_places() -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket's index vector: the non-zero places and their signs."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMENSIONS, (PLACES, BUCKETS)), rng.choice(np.array([-1.0, 1.0]), (PLACES, BUCKETS))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, DIMENSIONS) unit vectors from all texts of ``docs``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, signs = index_places()
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            for at in range(0, len(batch), 500):
                gap = np.full(REACH, -1)
                w = np.concatenate([x for t in batch[text_col].iloc[at : at + 500] for x in (words(t), gap)])
                for step in range(1, REACH + 1):
                    a, b = w[:-step], w[step:]
                    both = (a >= 0) & (b >= 0)
                    a, b = a[both], b[both]
                    for p, s in zip(places, signs, strict=True):
                        total += np.bincount(a * DIMENSIONS + p[b], s[b], len(total))
                        total += np.bincount(b * DIMENSIONS + p[a], s[a], len(total))
        m = total.reshape(BUCKETS, DIMENSIONS)
        seen = np.flatnonzero(m.any(1))
        frame = pd.DataFrame(m[seen].astype(np.int64), columns=[f"d{i}" for i in range(DIMENSIONS)])
        frame.insert(0, "bucket", seen)
        yield frame

    names = [f"d{i}" for i in range(DIMENSIONS)]
    sums = docs.select(text_col).mapInPandas(count, "bucket int, " + ", ".join(f"{x} long" for x in names))
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    totals = sums.groupBy("bucket").agg(*(F.sum(x).cast("double").alias(x) for x in names))
    for r in totals.toLocalIterator():  # BUCKETS rows at most
        out[r["bucket"]] = r[1:]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    seen = out.any(1)
    if seen.any():
        out[seen] -= out[seen].mean(0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's word vectors (near zero where a few words make up the text),
    how much of it few words make up, how many words repeat the one before, and its length."""
    w = words(text)
    if not len(w):
        return np.zeros(2 * DIMENSIONS + 3, np.float32)
    found, n = np.unique(w, return_counts=True)
    v, share = vectors[found], (n / len(w)).astype(np.float32)
    mean = share @ v
    spread = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
    sure = len(w) / (len(w) + 8)
    extent = [sure * np.sqrt(share @ share), sure * np.mean(w[1:] == w[:-1]) if len(w) > 1 else 0, np.log1p(len(w))]
    return np.concatenate([sure * mean, sure * spread, extent]).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Two layers by Adam on four fifths of the rows; the temperature on the rest."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    mu, sd = x.mean(0), x.std(0) + 1e-3
    z, cut = np.clip((x - mu) / sd, -6, 6), max(1, len(y) * 4 // 5)
    w = {
        "a": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
        "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1),
    }
    m, s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    t = 0
    for _ in range(max(2, min(EPOCHS, 3000 * 256 // max(cut, 1)))):
        for at in np.split(rng.permutation(cut), range(256, cut, 256)):
            h = np.tanh(z[at] @ w["a"] + w["b"])
            e = (1 / (1 + np.exp(-np.clip(h @ w["c"] + w["d"], -30, 30))) - y[at]) / len(at)
            back = np.outer(e, w["c"]) * (1 - h * h)
            grad = {"a": z[at].T @ back + 1e-4 * w["a"], "b": back.sum(0), "c": h.T @ e + 1e-4 * w["c"], "d": e.sum(keepdims=True)}
            t += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    rest = slice(cut, None) if cut < len(y) else slice(None)
    logits = np.tanh(z[rest] @ w["a"] + w["b"]) @ w["c"] + w["d"]
    loss = lambda k: np.logaddexp(0, -logits / k * (2 * y[rest] - 1)).mean()
    return w | {"mu": mu, "sd": sd, "temperature": min(np.geomspace(0.25, 8, 61), key=loss)}


def probability(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    h = np.tanh(np.clip((x - model["mu"]) / model["sd"], -6, 6) @ model["a"] + model["b"])
    return 1 / (1 + np.exp(-np.clip((h @ model["c"] + model["d"]) / model["temperature"], -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, dict | float]:
    """Word vectors of ``docs`` and the model; a constant if the labels are not of both kinds."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIMENSIONS numbers

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [pooled(t, shared.value) for t in batch["text"]], "quality": batch["quality"].astype(int)})

    marks = labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    train_rows = docs.select("doc_id", "text").join(bounded_sample(marks, fit_rows), "doc_id").select("text", "quality")
    rows = train_rows.mapInPandas(features, "x array<float>, quality int").toPandas()
    y = rows["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return vectors, float(y[0]) if len(y) else 0.5
    return vectors, train(np.array(rows["x"].tolist()), y)


def score(docs: DataFrame, vectors: np.ndarray, model: dict | float, name: str = "score") -> DataFrame:
    """``docs`` with the probability ``name`` of label 1, for empty texts as well."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        vectors, model = shared.value
        if isinstance(model, float):
            return pd.Series(model, index=texts.index, dtype=float)
        x = [pooled(t, vectors) for t in texts]
        return pd.Series(probability(np.array(x), model) if x else [], dtype=float)

    return docs.withColumn(name, judge("text"))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Labels of rows with ``crc32(doc_id) mod 4 = 2`` are never used; null labels and null ids neither.
    A null text is empty. Without labels of both kinds the score is constant. Repeated rows are
    scored each; an empty table gives an empty result; other columns are ignored.
    """
    picked = docs.select("doc_id", "text")
    scored = score(picked, *fit(picked, labels, fit_rows))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs``, all columns, without the documents whose score is under ``THRESHOLD``.

    Ids and labels decide nothing here but the training rows; each row is judged by its own text.
    """
    vectors, model = fit(docs.select("doc_id", "text"), labels, fit_rows)
    name = fresh("score", docs)
    return score(docs, vectors, model, name).filter(F.col(name) >= THRESHOLD).drop(name)
