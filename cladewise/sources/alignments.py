"""Alignment files, one per gene, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import empty_files, file_name, file_system, write_named

GLOB = "*.{fas,fasta,fa,faa,FAS,FASTA,FA,FAA}"


def read_files(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    """``(file, text)``: whole files, as one row each; a file is one gene."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(file_name().alias("file"), F.col("value").alias("text"))
    empty = empty_files(spark, path, glob)  # which Spark's scans leave out
    return whole.unionByName(spark.createDataFrame([(x, "") for x in empty], "file string, text string")) if empty else whole


def parse_alignments(files: DataFrame, policy: str = "model") -> DataFrame:
    """``files(file, text)`` -> ``aln(gene, species, seq, seq_len)``.

    The gene is the file's stem, a species the whole header. ``model``: upper case, ``?`` is a gap, the
    last of repeated species wins. ``site_counter``: letters as they are, repeated species are joined.
    Files without a record or with sequences of different sizes raise an error under ``model``."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    found = F.filter(F.split(F.concat(F.lit("\n"), F.col("text")), r"\n>"), lambda x: ~x.rlike(r"^\s*$"))
    if policy == "model":
        none = F.raise_error(F.concat(F.lit("no sequence in "), F.col("file"))).cast("array<string>")
        found = F.when(F.size(found) == 0, none).otherwise(found)
    records = files.select(stem.alias("gene"), F.posexplode(found).alias("no", "record"))
    lines = F.split("record", r"\r?\n", 2)  # the header, all else
    body = F.regexp_replace(F.coalesce(F.get(lines, 1), F.lit("")), r"\s", "")
    rows = records.select("gene", "no", F.trim(F.get(lines, 0)).alias("species"), body.alias("seq"))
    if policy == "model":
        rows = rows.withColumn("seq", F.replace(F.upper("seq"), F.lit("?"), F.lit("-")))
        seq = F.max_by("seq", "no")
    else:
        seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "seq"))), lambda x: x["seq"]), "")
    # Dealt by gene, sequences are shuffled once for both groupings.
    aln = rows.repartition("gene").groupBy("gene", "species").agg(seq.alias("seq")).withColumn("seq_len", F.length("seq"))
    if policy != "model":
        return aln
    gene = Window.partitionBy("gene")
    wrong = F.raise_error(F.concat(F.lit("sequences of different sizes in "), F.col("gene"))).cast("int")
    sizes = aln.withColumn("a", F.min("seq_len").over(gene)).withColumn("b", F.max("seq_len").over(gene))
    return sizes.select("gene", "species", "seq", F.when(F.col("a") == F.col("b"), F.col("seq_len")).otherwise(wrong).alias("seq_len"))


def read_alignments(spark: SparkSession, path: str, policy: str = "model", glob: str = GLOB) -> DataFrame:
    return parse_alignments(read_files(spark, path, glob), policy)


def to_two_line(aln: DataFrame) -> DataFrame:
    """``(gene, value)``: a file's text, each record a header and one line."""
    ordered = F.array_sort(F.collect_list(F.concat(F.lit(">"), "species", F.lit("\n"), "seq")))
    return aln.groupBy("gene").agg(F.array_join(ordered, "\n").alias("value"))


def write_alignments(aln: DataFrame, path: str) -> None:
    """Two-line files ``<gene>.fas``."""
    write_named(to_two_line(aln).select(F.concat("gene", F.lit(".fas")).alias("file"), "value"), path)


def write_cancelled(sequences: DataFrame, path: str) -> None:
    """``sequences(combo_idx, gene, species, seq)``, gaps cancelled, as two-line files ``combo_<i>/<gene>.fas``."""
    ordered = F.array_sort(F.collect_list(F.struct("slot", F.concat(F.lit(">"), "species", F.lit("\n"), "seq").alias("t"))))
    text = sequences.groupBy("combo_idx", "gene").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("value"))
    write_named(text.select(F.concat(F.lit("combo_"), F.col("combo_idx").cast("string"), F.lit("/"), "gene", F.lit(".fas")).alias("file"), "value"), path)


def read_cancelled(spark: SparkSession, path: str) -> DataFrame:
    """``(combo_idx, gene, species, seq)`` of :func:`write_cancelled`."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.fas", recursiveFileLookup=True)
    combo = F.regexp_extract("_metadata.file_path", r"/combo_(\d+)/[^/]*$", 1).alias("combo_idx")
    files = whole.select(F.concat_ws("/", combo, file_name()).alias("file"), F.col("value").alias("text"))
    at = lambda i: F.element_at(F.split("gene", "/", 2), i)
    return parse_alignments(files).select(at(1).cast("long").alias("combo_idx"), at(2).alias("gene"), "species", "seq")


def convert_folder(spark: SparkSession, path: str, out: str, glob: str = GLOB) -> None:
    """All alignments below ``path`` as two-line files below ``out``, in the same sub-folders; names end in ``.fas``."""
    store, at = file_system(spark, path)
    root = store.makeQualified(at).toUri().getPath().rstrip("/")
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    where = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^[a-z]+:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    files = whole.select(F.substring(where, F.lit(len(root) + 2), F.length(where)).alias("file"), F.col("value").alias("text"))
    text = to_two_line(parse_alignments(files, "site_counter"))
    write_named(text.select(F.concat("gene", F.lit(".fas")).alias("file"), "value"), out)


def check_two_line(files: DataFrame) -> DataFrame:
    """``(file, ok, reason)``: whether each record is a header and one line of sequence."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    f = files.withColumn("l", lines)
    head = lambda i: F.startswith(F.get("l", i), F.lit(">"))
    places = F.sequence(F.lit(0), F.size("l") - 1)
    reason = (
        F.when(F.size("l") == 0, "empty").when(~head(F.lit(0)), "sequence before header")
        .when(head(F.size("l") - 1), "header without sequence")
        .when(F.exists(places, lambda i: (i > 0) & head(i) & head(i - 1)), "header without sequence")
        .when(F.exists(places, lambda i: (i > 0) & ~head(i) & ~head(i - 1)), "sequence over several lines")
    )
    return f.select("file", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def ordered_genes(path_lines: DataFrame, aln: DataFrame, keys: list[str]) -> DataFrame:
    """``path_lines(keys, line_no, line)`` -> ``(keys, gene, gene_ord)`` in the list's order; folders and a
    missing or given extension are left out of the name. A listed gene that does not exist is an error."""
    name = F.regexp_replace(F.regexp_replace(F.trim("line"), r"^.*/", ""), r"\.(fas|fasta|fa|faa)$", "")
    listed = path_lines.filter(F.trim("line") != "").select(*keys, name.alias("gene"), F.col("line_no").alias("gene_ord"))
    found = listed.join(aln.select(F.col("gene"), F.lit(True).alias("__there")).distinct(), "gene", "left")
    lost = F.raise_error(F.concat(F.lit("no alignment of the listed gene "), F.col("gene"))).cast("string")
    return found.select(*keys, F.when(F.col("__there"), F.col("gene")).otherwise(lost).alias("gene"), "gene_ord")
