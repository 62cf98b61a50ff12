"""Site counts of genes that keep arriving: an alignment folder read as a stream.

An extra to the batch operators: a file is a whole gene, so that the stream keeps no state and each
micro-batch goes through the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sitecount import gene_counts, paired_genes
from ..sources.alignments import GLOB, parse_alignments


def stream_site_counts(spark: SparkSession, path: str, combo: DataFrame, outgroup: str, out: str, checkpoint: str) -> StreamingQuery:
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", GLOB).load(path)
    files = files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))

    def count(batch: DataFrame, epoch: int) -> None:
        counts = gene_counts(paired_genes(parse_alignments(batch, "site_counter"), combo, outgroup))
        counts.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out)

    return files.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
