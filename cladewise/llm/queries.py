"""The registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_tokens, decontaminate, exact_dedup, language, near_dedup, packing, pii, quality, resampling, secret_scan, substrings, toxicity, warc
from .scratch import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Ranks and word pattern of the byte-level BPE vocabulary; ids are those of its json file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenizer_pair() -> tuple[str, str, str]:
    """The same vocabulary and pattern, and the model that it is aligned with."""
    import public_tokenizers

    return *tokenizer(), public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Packing with the digest of each piece's ids in place of the ids."""
    pieces = packing.token_pieces(docs, *tokenizer())
    return packing.assign_slots(materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.corpus_alignment(table(spark, sf_dir, "documents"), *tokenizer_pair())


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_quality, op3_substrings, op4_pii, op5_decontamination, op6_near_dedup, op7_packing, op8_language,
    op9_exact_dedup, op10_toxicity, op11_secrets, op12_resampling, op13_cross_tokens,
)}

ORACLE_SQL = {
    "op1_warc": r"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, url, strlen(h) AS n, sha1(h) AS d FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM q)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to, url FROM r""",
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
        g AS (SELECT *, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g""",
    # CRC-32 by its table, which a rule makes; a word's bytes are read from its hexadecimal form.
    "op12_resampling": r"""
        WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
                     FROM range(256) r(i)),
        texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
        words AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        one AS (SELECT side, r, unnest(w) AS w FROM words),
        hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM one)),
        coded AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
                         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket FROM hexed, tab),
        found AS (SELECT side, r, bucket FROM one JOIN coded USING (w)),
        n AS (SELECT bucket, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 'b')::DOUBLE AS t FROM found GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS g FROM n),
        weight AS (SELECT r, floor(sum(g) / count(*))::BIGINT AS weight FROM found JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
        scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                          coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
                   FROM words LEFT JOIN weight USING (r) WHERE side = 'd'),
        ranked AS (SELECT *, n_features >= 20 AS may, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 10 * (SELECT count(*) FROM ranked WHERE may) // 100 THEN place END AS rank FROM ranked""",
}
