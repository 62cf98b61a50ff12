"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text becomes an ordered list of chunk identifiers. Chunk content moves once, to prove that an
identifier stands for one chunk; whole documents are then compared by their short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, materialize, small

#: A chunk ends at the first space before a word in a-d after MIN_CHUNK characters, or after MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 400, 4096


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(text: Column) -> Column:
    """Content-defined chunks that tile ``text``; none for the empty text."""
    cut = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?: (?=[a-d])|\z)|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, a row for each row of ``docs``.

    Texts are equal when their normalised forms are. ``keep_id`` is the smallest ``doc_id`` of the
    group. Nulls: a null text is the empty text; a null ``doc_id`` loses to any other, and a group
    without any id keeps its null rows. Rows that repeat the kept ``doc_id`` are all kept, since
    they are one document. Other columns are ignored. An empty table gives an empty result.
    ``hash_bits`` below 64 is for tests that need collisions.
    """
    mask = (1 << hash_bits) - 1 if hash_bits < 64 else -1
    ident = lambda c: F.xxhash64(c).bitwiseAND(F.lit(mask))
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    recipes = texts.select(
        "doc_id",
        F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"),
        F.transform(chunks(F.col("t")), ident).alias("recipe"),
    )
    # The only movement of content: equal (identifier, chunk) rows meet, after a map-side combine.
    distinct_chunks = (
        texts.select(F.explode(chunks(F.col("t"))).alias("chunk"))
        .select(ident(F.col("chunk")).alias("id"), "chunk")
        .distinct()
    )
    shared_ids = materialize(
        distinct_chunks.groupBy("id").agg(F.count("*").alias("n"), F.array_agg(F.sha2("chunk", 256)).alias("bodies"))
        .filter("n > 1").select("id", F.explode("bodies").alias("body"))
    )
    if shared_ids.isEmpty():  # each identifier was proven to stand for one chunk
        keyed = recipes.withColumn("verified", F.lit(None).cast("array<string>"))
    else:
        # Occurrences under an identifier of several chunks carry the chunk's own digest as well.
        where = (
            texts.select(F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"), chunks(F.col("t")).alias("c"))
            .select("text_sha256", F.posexplode("c").alias("pos", "chunk"))
            .select("text_sha256", "pos", ident(F.col("chunk")).alias("id"), F.sha2("chunk", 256).alias("body"))
            .join(shared_ids, ["id", "body"], "left_semi")
            .distinct()
            .groupBy("text_sha256")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]).alias("verified"))
        )
        keyed = recipes.join(where, "text_sha256", "left")
    keyed = materialize(keyed)
    # Map-side combine keeps hot groups small; the join back may split a hot key (adaptive skew join).
    groups = keyed.groupBy("recipe", "verified").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    k, g = keyed.alias("k"), groups.alias("g")
    same = (F.col("k.recipe") == F.col("g.recipe")) & F.col("k.verified").eqNullSafe(F.col("g.verified"))
    return k.join(g, same).select(
        "k.doc_id", "g.keep_id", "g.group_size",
        F.col("k.doc_id").eqNullSafe(F.col("g.keep_id")).alias("kept"), "k.text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row with a smaller ``doc_id`` has.

    Rows are matched to verdicts by ``doc_id``; where one id stands on several texts, the row's own
    digest decides. All columns stay.
    """
    verdict = small(materialize(duplicate_groups(docs).filter("not kept").select("doc_id", "text_sha256").distinct()))
    sha = fresh("sha", docs)
    d = docs.withColumn(sha, F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256)).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col(f"d.{sha}") == F.col("v.text_sha256"))
    return d.join(verdict.alias("v"), same, "left_anti").drop(sha)
