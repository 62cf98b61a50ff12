"""Small text formats of a run, parsed from ``(keys, line_no, line)`` tables, and written back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import value_counts
from .tables import file_name, write_named


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(file, line_no, line)`` of text files, numbered from 1."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    lines = whole.select(file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))
    return lines.select("file", (F.col("no") + 1).alias("line_no"), "line")


def read_groups(lines: DataFrame, keys: list[str], even: bool = True) -> DataFrame:
    """``(keys, line_no, members)`` of the non-empty lines, numbered from 0; an empty member is an error, and unless
    ``even`` is off an odd number of lines."""
    full = lines.filter(F.trim("line") != "")
    members = F.transform(F.split("line", ","), lambda x: F.trim(x))
    no = F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")) - 1
    fault = F.when(F.exists(members, lambda x: x == ""), F.lit("empty member in a group"))
    if even:
        fault = F.coalesce(fault, F.when(F.count("*").over(Window.partitionBy(*keys)) % 2 == 1, F.lit("odd number of lines in a groups file")))
    return full.select(*keys, no.alias("line_no"), F.when(fault.isNotNull(), F.raise_error(fault).cast("array<string>")).otherwise(members).alias("members"))


def read_response_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(combo_idx, file, species, y)`` of a folder's ``.txt`` files, which are numbered by name from 0."""
    lines = read_lines(spark, path, "*.txt")
    numbers = value_counts(lines.filter("line_no = 1"), [], "file").select("file", F.col("below").alias("combo_idx"))
    return read_responses(lines, ["file"]).join(numbers, "file").select("combo_idx", "file", "species", "y")


def read_responses(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, species, y)``: fields apart by a tab, else a comma, else blanks; zeros and short lines go."""
    sep = F.when(F.contains("line", F.lit("\t")), F.split("line", "\t")).when(F.contains("line", F.lit(",")), F.split("line", ",")).otherwise(F.split(F.trim("line"), r"\s+"))
    parts = lines.withColumn("p", F.transform(sep, lambda x: F.trim(x))).filter(F.size("p") >= 2)
    out = parts.select(*keys, F.get("p", F.lit(0)).alias("species"), F.expr("try_cast(get(p, 1) AS double)").alias("y"))
    return out.filter(F.abs("y") >= 1e-12)


def read_phenotypes(lines: DataFrame, keys: list[str], strip_quotes: bool = False) -> DataFrame:
    """``(keys, species, value)``: two fields, a header and lines without a number left out. With
    ``strip_quotes`` quotes go and further fields are ignored."""
    d = lines.withColumn("p", F.transform(F.split(F.regexp_replace("line", "[\"']", "") if strip_quotes else F.col("line"), ","), lambda x: F.trim(x)))
    d = d.filter(F.size("p") >= 2 if strip_quotes else F.size("p") == 2)
    out = d.select(*keys, F.get("p", F.lit(0)).alias("species"), F.expr("try_cast(get(p, 1) AS double)").alias("value"))
    return out.filter("value IS NOT NULL AND lower(species) <> 'species'")


def split_labels(coef: DataFrame) -> DataFrame:
    """``coef(label, weight)`` -> gene, position and residue, split from the right."""
    part = lambda i: F.regexp_extract("label", r"^(.*)_(\d+)_(.)$", i)
    keep = [c for c in coef.columns if c != "label"]
    return coef.filter("label <> 'Intercept'").select(*keep, part(1).alias("gene"), part(2).cast("int").alias("pos"), part(3).alias("aa"))


def groups_lines(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs(keys, pair, conv, ctrl, conv_alts, ctrl_alts)`` -> ``(keys, line_no, line)``."""
    line = lambda a, b: F.concat_ws(",", F.array(a), F.col(b))
    two = F.array(line("conv", "conv_alts"), line("ctrl", "ctrl_alts"))
    return pairs.select(*keys, "pair", F.posexplode(two).alias("side", "line")).select(*keys, (F.col("pair") * 2 + F.col("side")).alias("line_no"), "line")


def six_digits(v: Column) -> Column:
    """A double with six significant digits, as C's ``%.6g`` writes it: no zeros at the end, an exponent only
    under -4 or over 5. A seventh digit of exactly 5 is rounded up."""
    sci = F.format_string("%.5e", v)
    part = lambda i: F.regexp_extract(sci, r"^(-?)(\d)\.(\d+)e([+-]\d+)$", i)
    digits, exponent = F.concat(part(2), part(3)), part(4).cast("int")
    whole = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(6)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    short = lambda c: F.regexp_replace(c, r"\.?0*$", "")
    power = F.concat(short(F.concat(part(2), F.lit("."), part(3))), F.lit("e"), part(4))
    body = F.when((exponent < -4) | (exponent > 5), power).when(exponent < 0, short(small)).otherwise(short(whole))
    odd = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return F.when(v.isNotNull(), F.coalesce(odd, F.concat(part(1), body)))


def site_count_csv(counts: DataFrame) -> DataFrame:
    """The site counter's report: arrays as JSON text, a blank after each comma; numbers with six significant digits."""
    out = []
    for name, kind in counts.dtypes:
        if kind.startswith("array"):
            items = F.array_join(F.transform(name, lambda x: x.cast("string")), ", ", "null")
            out.append(F.concat(F.lit("["), items, F.lit("]")).alias(name))
        else:
            out.append((six_digits(F.col(name)) if kind == "double" else F.col(name).cast("string")).alias(name))
    return counts.select(*out)


def fifteen_places(value: Column) -> Column:
    """Numbers with up to fifteen decimal places of their exact value, without zeros at the end."""

    def write(values: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x != x else f"{x:.15f}".rstrip("0").rstrip(".") for x in values], dtype=object)

    return F.pandas_udf(write, "string")(value)


def _field(name: str, kind: str, none: str) -> Column:
    text = fifteen_places(F.col(name)) if kind == "double" else F.col(name).cast("string")
    quoted = F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.coalesce(quoted, F.lit(none))


def csv_lines(df: DataFrame, keep: list[str], none: str = "") -> DataFrame:
    """``(keep, line)``: each row as a line of text, numbers as :func:`fifteen_places` has them, ``none`` for nulls."""
    fields = [_field(c, kind, none) for c, kind in df.dtypes if c not in keep]
    return df.select(*keep, F.concat_ws(",", *fields).alias("line"))


def write_lines(lines: DataFrame, header: str, path: str) -> None:
    """``lines(line)`` as text files, each with the header as its first line."""
    whole = lines.select(F.col("line").alias(header)).write.mode("overwrite").option("header", True)
    whole.option("quote", "\u0000").option("escapeQuotes", False).option("emptyValue", "").csv(path, sep="\u0001")


def write_prediction_text(prediction: DataFrame, path: str) -> None:
    """Predictions as text in the order of designs: files in order of their names, each with the header."""
    order = [c for c in ("combo_idx", "lambda1", "lambda2", "penalty_term", "species") if c in prediction.columns]
    lines = csv_lines(prediction.repartitionByRange(*order).sortWithinPartitions(*order), ["combo_idx"])
    write_lines(lines, ",".join(c for c in prediction.columns if c != "combo_idx"), path)


def write_gene_ranks(ranks: DataFrame, path: str) -> None:
    """Gene ranks as text; a gene that was never ranked has ``None`` for its rank."""
    named = ranks.withColumnRenamed("gene", "gene_name")
    write_lines(csv_lines(named, [], "None"), ",".join(named.columns), path)


def read_ranged(spark: SparkSession, path: str) -> DataFrame:
    """``(file, no, line)`` of :func:`write_lines`, headers left out."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="part-*")
    lines = whole.select(file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("no", "line"))
    return lines.filter("no > 0 AND line <> ''")


def write_models(coef: DataFrame, models: DataFrame, path: str, base: str = "model") -> None:
    """A text file for each model, ``<base>_combo_<i>_l1_<lambda1>_l2_<lambda2>_out_feature_weights.txt``: a line per
    coefficient that is not zero, its label and 17 places, in the features' order, and the intercept last.

    ``coef(combo_idx, lambda1, lambda2, gene, pos, aa, weight)``, ``models(combo_idx, lambda1, lambda2, intercept)``."""
    key = ["combo_idx", "lambda1", "lambda2"]
    tag = lambda c: F.regexp_replace(F.format_string("%.5f", c), r"(\.\d+?)0+$", "$1")
    number = lambda c: F.format_string("%.17e", c)
    line = F.concat(F.concat_ws("_", "gene", F.col("pos").cast("string"), "aa"), F.lit("\t"), number(F.col("weight")))
    body = coef.filter("weight <> 0").groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gene", "pos", "aa", line.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    whole = models.join(body, key, "left").select(
        F.concat(F.lit(f"{base}_combo_"), F.col("combo_idx").cast("string"), F.lit("_l1_"), tag(F.col("lambda1")), F.lit("_l2_"), tag(F.col("lambda2")), F.lit("_out_feature_weights.txt")).alias("file"),
        F.concat_ws("\n", "body", F.concat(F.lit("Intercept\t"), number(F.col("intercept")))).alias("value"),
    )
    # Penalties that are alike to five places share a name.
    write_named(whole.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("value")), path)


def read_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(coef, models)`` of :func:`write_models`; design and penalties are those of the file's name."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*_out_feature_weights.txt")
    of = lambda i: F.regexp_extract("file", r"_combo_(\d+)_l1_([0-9.]+)_l2_([0-9.]+)_out_feature_weights\.txt$", i)
    lines = whole.select(file_name().alias("file"), F.explode(F.split("value", "\n")).alias("line")).filter(F.trim("line") != "")
    rows = lines.select(
        of(1).cast("long").alias("combo_idx"), of(2).cast("double").alias("lambda1"), of(3).cast("double").alias("lambda2"),
        F.element_at(F.split("line", "\t"), 1).alias("label"), F.element_at(F.split("line", "\t"), 2).cast("double").alias("weight"),
    )
    return split_labels(rows), rows.filter("label = 'Intercept'").select("combo_idx", "lambda1", "lambda2", F.col("weight").alias("intercept"))


def write_csv(df: DataFrame, path: str, null: str = "None") -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", null).csv(path)


def write_predictions(prediction: DataFrame, path: str) -> None:
    """A part per design, replaced whole when the design is run again."""
    prediction.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("combo_idx").parquet(path)
