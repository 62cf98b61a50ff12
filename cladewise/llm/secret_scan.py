"""Secret scans: a keyword automaton first, anchored expressions near its hits, checksums last.

One Aho-Corasick pass over a text's bytes (in lower case) finds all keywords; each expression is then tried
only where one of its keywords stands. Runs of hexadecimal digits have no keyword: every twelfth byte is
looked at instead, as a run of 24 has two of these in a row. Tokens that carry a checksum of their own are
reported if it agrees.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed; the first three are the base.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "xprv", "age", "nsec")

#: Least characters of an assigned value, of an access key and of a hexadecimal run; every STEP-th byte is looked at for runs.
VALUE, ACCESS, HEX, STEP = 6, 20, 24, 12

# The expressions of the base kinds and the published formats and alphabets of tokens with checksums.
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_BECH32_POLY = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
_SIX = re.compile(rb"[A-Za-z0-9]+_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])")
_XPRV = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])")
_AGE = re.compile(rb"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![0-9A-Za-z])")
_NSEC = re.compile(rb"nsec1[02-9ac-hj-np-z]{58}(?![0-9A-Za-z])")

#: Keyword in lower case -> kind.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "xprv": "xprv", "age-secret-key-1": "age", "nsec1": "nsec",
}

_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def base62_crc(payload: bytes) -> str:
    """CRC-32 of ``payload`` as six digits to base 62."""
    n, out = zlib.crc32(payload), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def base58_agrees(token: str) -> bool:
    """Whether the last four of the bytes are the first of the doubled SHA-256 of the others."""
    n = 0
    for c in token:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes(82, "big") if n < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_agrees(token: str) -> bool:
    """Whether the checksum polynomial over prefix and data is 1."""
    prefix, _, data = token.lower().rpartition("1")
    check = 1
    for x in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *(_BECH32.find(c) for c in data)]:
        if x < 0:
            return False
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ x
        for k, poly in enumerate(_BECH32_POLY):
            if top >> k & 1:
                check ^= poly
    return check == 1


def _assign(raw: bytes, at: int) -> tuple[int, bool]:
    m = _ASSIGN.match(raw, at)
    return (m.end(), m.end(1) - m.start(1) >= VALUE) if m else (at, False)


def _access(raw: bytes, at: int) -> tuple[int, bool]:
    m = _ACCESS.match(raw, at)
    return (m.end(), m.end() - at >= ACCESS) if m else (at, False)


def _alone(raw: bytes, at: int) -> bool:
    return at == 0 or not raw[at - 1 : at].isalnum()


def _six(raw: bytes, at: int) -> tuple[int, bool]:
    m = _SIX.match(raw, at)
    return (m.end(), _alone(raw, at) and base62_crc(m[1]) == m[2].decode()) if m else (at, False)


def _checked(pattern: re.Pattern, agrees):
    def test(raw: bytes, at: int) -> tuple[int, bool]:
        m = pattern.match(raw, at)
        return (m.end(), _alone(raw, at) and agrees(m[0].decode())) if m else (at, False)

    return test


#: Kind -> (end of the match at a place, whether it counts); a match that doesn't count still takes its place.
TESTS = {
    "assign": _assign, "access": _access, "github": _six, "npm": _six,
    "xprv": _checked(_XPRV, base58_agrees), "age": _checked(_AGE, bech32_agrees), "nsec": _checked(_NSEC, bech32_agrees),
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (len(word) - 1, kind))
    out.make_automaton()
    return out


def hex_runs(raw: bytes) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least ``HEX`` hexadecimal digits."""
    looked = _IS_HEX[np.frombuffer(raw, np.uint8)[::STEP]]
    end = 0
    for at in (np.flatnonzero(looked[:-1] & looked[1:]) * STEP).tolist():
        if at >= end:
            start = max(end, at - STEP + 1)
            start += len(raw[start:at].rstrip(b"0123456789abcdef"))
            end = _HEX.match(raw, start).end()
            if end - start >= HEX:
                yield start, end


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in code points, by start, then by kind as in ``KINDS``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hits = sorted((end - back, kind) for end, (back, kind) in automaton().iter(raw.lower().decode("latin-1")))
    found, taken = [], dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at >= taken[kind]:
            taken[kind], counts = TESTS[kind](raw, at)
            if counts:
                found.append((at, taken[kind], kind))
    found += [(start, end, "hex") for start, end in hex_runs(raw)]
    if found and not raw.isascii():
        # Code points before each byte.
        before = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)))
        found = [(int(before[start]), int(before[end]), kind) for start, end, kind in found]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, secrets)`` for each row: spans as structs ``(kind, start, end)``, ``end`` exclusive.

    A null or empty text has none. Null ids are carried along, repeated rows are scanned each, an
    empty table gives an empty result, other columns are ignored.
    """
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(struct))], ["doc_id", "secrets"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(scan, "doc_id long, secrets array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each secret in ``text_col`` replaced by ``[kind]``; of overlapping ones the first names the whole."""

    @F.pandas_udf("string")
    def without(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = spans(text)
            parts, end = [], 0
            for start, stop, kind in found:
                if start >= end:
                    parts.append(f"{text[end:start]}[{kind}]")
                end = max(end, stop)
            out.append("".join(parts) + text[end:] if found else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, without(F.col(text_col).cast("string")))


def listed(secrets: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, for each row of ``docs``."""

    def of(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    return find_secrets(docs).select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans")
    )
