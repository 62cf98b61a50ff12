"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector. A trigram binds (multiplies) its letters' vectors, each
permuted by its place; a text bundles (adds) its trigrams; a language prototype bundles its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS, SYMBOLS, SEED = 512, 64, 7
#: At most about so many labelled documents train the prototypes; all documents are scored.
FIT_ROWS = 20_000
#: Sharpness of the score that is made from the cosines.
SHARPNESS = 25.0


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, a-z apart, other letters shared out."""
    table = np.zeros(0x110000, np.uint8)
    for x in range(0x110000):
        low = chr(x).lower()[0]
        if low.isalpha():
            table[x] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % 4294967296 % 37
    return table


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    """(3, symbols, dimensions): the letters' vectors, permuted (rotated) by place."""
    one = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    return np.stack([np.roll(one, 2 - place, axis=1) for place in range(3)])


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text's letters and their counts; other runs count as one blank."""
    s = symbols()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0)
    s = np.concatenate(([0], s, [0]))
    s = s[(s > 0) | np.concatenate(([True], s[:-1] > 0))]
    found, n = np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True) if len(s) > 2 else (np.zeros(0, np.int64), np.zeros(0))
    return found, n


def bundles(texts: list[str | None]) -> np.ndarray:
    """Unit text vectors, zero for texts without letters."""
    letters, out = letter_vectors(), np.zeros((len(texts), DIMENSIONS), np.float32)
    parts = [trigrams(t) for t in texts]
    every = np.unique(np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])).astype(np.int64)
    bound = (letters[0][every // SYMBOLS**2] * letters[1][every // SYMBOLS % SYMBOLS] * letters[2][every % SYMBOLS]).astype(np.float32)
    for k, (found, n) in enumerate(parts):
        if len(found):
            v = n.astype(np.float32) @ bound[np.searchsorted(every, found)]
            out[k] = v / (np.linalg.norm(v) or 1)
    return out


def remainder(id_column: Column, n: int) -> Column:
    return F.pmod(F.crc32(id_column.cast("string")), F.lit(n))


def bounded_sample(labelled: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of their id."""
    n = labelled.count()
    if n <= rows:
        return labelled
    return labelled.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1 << 20)) < F.lit(int(rows / n * (1 << 20))))


def fit_prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """Unit prototype of each language; ``docs`` holds training rows only."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                vectors = bundles(list(part[text_col]))
                for lang in part[lang_col].unique():
                    total[lang] = total.get(lang, 0) + vectors[(part[lang_col] == lang).to_numpy()].sum(0)
        yield pd.DataFrame(
            [(k, d, float(x)) for k, v in total.items() for d, x in enumerate(v)], columns=["lang", "d", "x"]
        )

    train = bounded_sample(docs.filter(F.col(lang_col).isNotNull()), fit_rows).select(text_col, lang_col)
    sums = train.mapInPandas(bundle, "lang string, d int, x double").groupBy("lang", "d").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x DIMENSIONS numbers
        out.setdefault(r["lang"], np.zeros(DIMENSIONS, np.float32))[r["d"]] = r["x"]
    mean = sum(v / (np.linalg.norm(v) or 1) for v in out.values()) / max(len(out), 1) if len(out) > 1 else 0
    # What all languages share tells nothing; half of it is taken out of each prototype.
    out = {k: v / (np.linalg.norm(v) or 1) - 0.5 * mean for k, v in out.items()}
    return {k: v / (np.linalg.norm(v) or 1) for k, v in out.items()}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; ``und`` and 0 for null texts and those without letters."""
    names = sorted(prototypes)
    if not names:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    matrix = np.stack([prototypes[k] for k in names], axis=1).astype(np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for at in range(0, len(texts), 256):
            v = bundles(list(texts.iloc[at : at + 256]))
            cosines = v @ matrix
            e = np.exp(SHARPNESS * (cosines - cosines.max(1, keepdims=True)))
            seen = v.any(1)
            parts.append(pd.DataFrame({
                "lang_pred": np.where(seen, np.array(names, object)[cosines.argmax(1)], "und"),
                "score": np.where(seen, e.max(1) / e.sum(1), 0.0).astype(float),
            }))
        return pd.concat(parts) if parts else pd.DataFrame({"lang_pred": [], "score": []})

    return docs.withColumn("__p", nearest(F.col(text_col))).withColumn("lang_pred", F.col("__p.lang_pred")).withColumn("score", F.col("__p.score")).drop("__p")


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``docs``.

    Rows with ``crc32(doc_id) mod 4 = 2`` are held out of training, as are null ids and null
    languages. A null id is not held out in the result. Repeated rows are scored each; an empty
    table gives an empty result; other columns are ignored.
    """
    picked = docs.select("doc_id", "text", "lang")
    prototypes = fit_prototypes(picked.filter(remainder(F.col("doc_id"), 4) != 2), fit_rows=fit_rows)
    scored = predict_language(picked.select("doc_id", "text"), prototypes)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score")
