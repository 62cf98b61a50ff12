"""Resume: what is done, under which settings, and ranks rebuilt from what is stored."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import file_system
from .score import gene_ranks_multi, gene_scores, rank_genes

#: Settings that may differ between a run and its continuation.
BENIGN = {"threads", "verbose", "out", "plots"}


def pending(combo: DataFrame, audit: DataFrame) -> DataFrame:
    """Designs that the ledger doesn't have."""
    return combo.join(audit.select("combo_idx").distinct(), "combo_idx", "left_anti")


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in sorted(config.items()) if k not in BENIGN}, default=str).encode()).hexdigest()


def same_config(config: dict, audit: DataFrame) -> bool:
    return audit.filter(F.col("config") != config_hash(config)).isEmpty()


def start_run(spark: SparkSession, path: str, config: dict, force: bool = False) -> DataFrame:
    """The ledger of a run that is started or continued at ``path``. One made under other settings is an error,
    unless ``force`` clears the folder and starts anew."""
    store, at = file_system(spark, path)
    if store.exists(at):
        audit = spark.read.schema("combo_idx long, config string").json(path)
        if same_config(config, audit):
            return audit
        if not force:
            raise ValueError(f"{path} holds a run under other settings; force a restart to clear it")
        store.delete(at, True)
    return spark.createDataFrame([], "combo_idx long, config string")


def store_coefficients(coef: DataFrame, path: str) -> None:
    """A part per design, replaced whole when the design is fitted again."""
    coef.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("combo_idx").parquet(path)


def stored_coefficients(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def rebuild_ranks(coef: DataFrame, genes: DataFrame, top_rank_frac: float = 0.01) -> DataFrame:
    """Ranks over all designs from their stored coefficients; maxima and counts, so order is no matter."""
    return gene_ranks_multi(rank_genes(gene_scores(coef)), genes, top_rank_frac)


def reuse(spark: SparkSession, path: str, builder: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was finished, else built and written there."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        builder().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_audit(rows: DataFrame, path: str, config: dict) -> None:
    """Add finished models to the ledger, as JSON lines by design."""
    rows.withColumn("config", F.lit(config_hash(config))).write.mode("append").partitionBy("combo_idx").json(path)
