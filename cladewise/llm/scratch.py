"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of ids that is still sent to every executor.
SMALL_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``. Where that is unset, a local session (tests) makes one of its
    own; on a cluster no other folder is known to be shared, and it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a shared Parquet table and read it back: lineage ends there and lost
    executors cost nothing that was written."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run within it hands rows to Python in batches of ``most`` at most; a smaller setting of the session holds.
    A batch is held several times, by the executor and by its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(name)
    larger = not 0 < int(had) <= most
    if larger:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if larger:
            spark.conf.set(name, had)


def small(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast in a join if its rows, which are counted, are few enough; a table of
    a written folder is counted by its footers."""
    return F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids


def fresh(name: str, df: DataFrame) -> str:
    """``name`` with as many underscores as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
