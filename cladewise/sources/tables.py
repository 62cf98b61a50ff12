"""Written tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``. Where that is unset, a local session makes one of its own; on a
    cluster no other folder is known to be shared, and it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The store of ``path`` and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def file_name() -> Column:
    """The name of a scan's file; the scan has it as in a URL."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def empty_files(spark: SparkSession, path: str, glob: str) -> list[str]:
    """Names of the files of no length below ``path`` that the pattern takes in. Folders are listed without the places of
    blocks, which would ask the store again for each file."""
    store, at = file_system(spark, path)
    wanted, out, folders = spark._jvm.org.apache.hadoop.fs.GlobFilter(glob), [], [at]
    while folders:
        for f in store.listStatus(folders.pop()):
            if f.isDirectory():
                if not f.getPath().getName().startswith(("_", ".")):
                    folders.append(f.getPath())
            elif not f.getLen() and wanted.accept(f.getPath()) and not f.getPath().getName().startswith(("_", ".")):
                out.append(f.getPath().getName())
    return out


def write_named(files: DataFrame, path: str) -> None:
    """``files(file, value)``, a row for each name, as text files ``<path>/<file>``, in sub-folders if names have them. What
    was at ``path`` before goes. Tasks write a file under a hidden name and then give it its own, so it is there whole or not at all."""
    store, at = file_system(files.sparkSession, path)
    store.delete(at, True)
    store.mkdirs(at)
    uri = store.makeQualified(at).toUri().toString()

    def put(rows: Iterator[Row]) -> None:
        disk, root = fs.FileSystem.from_uri(uri)
        made: set[str] = set()
        for name, value in rows:
            target = f"{root}/{name}"
            folder = target.rpartition("/")[0]
            if folder not in made:
                disk.create_dir(folder, recursive=True)
                made.add(folder)
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with disk.open_output_stream(hidden, compression=None) as out:
                out.write(f"{value or ''}\n".encode())
            try:
                disk.move(hidden, target)
            except OSError:  # where a move replaces nothing, another attempt's same file stays
                if disk.get_file_info(target).type == fs.FileType.NotFound:
                    raise
                disk.delete_file(hidden)

    files.select("file", "value").foreachPartition(put)


def released(*tables: DataFrame) -> None:
    """Delete tables made by :func:`checkpointed` that no later plan reads."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
