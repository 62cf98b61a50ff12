"""What is made once for a design and used again: tables by design, finished when a manifest says so.

An attempt writes its tables below a folder of its own and then, last, one manifest that names the folder, the settings and
the designs. The manifest appears by a rename, so it is there whole or not at all; what a killed run has left has none and
is never read. Of several attempts at a design the last finished one counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import file_system

Tables = dict[str, DataFrame]


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def _text_file(spark: SparkSession, path: str, text: str) -> None:
    store, at = file_system(spark, path)
    out = store.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def manifests(spark: SparkSession, root: str, settings: dict) -> list[dict]:
    """Finished attempts under these settings, the last one first."""
    store, at = file_system(spark, f"{root}/manifests")
    if not store.exists(at):
        return []
    rows = spark.read.text(f"{root}/manifests", wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_modification_time").alias("t")).collect()  # one per attempt
    found = [json.loads(r["value"]) | {"t": r["t"]} for r in rows]
    return sorted((m for m in found if m["settings"] == settings_hash(settings)), key=lambda m: (m["number"], m["t"]), reverse=True)


def write_attempt(spark: SparkSession, root: str, tables: Tables) -> str:
    """Write the tables, by design; the attempt's name. Nothing reads it before :func:`commit`."""
    name = uuid.uuid4().hex
    for table, df in tables.items():
        df.write.partitionBy("combo_idx").parquet(f"{root}/attempts/{name}/{table}")
    return name


def commit(spark: SparkSession, root: str, settings: dict, attempt: str, tables: Tables, designs: list[int]) -> None:
    known = manifests(spark, root, settings)
    told = {
        "settings": settings_hash(settings), "attempt": attempt, "designs": sorted(designs), "number": known[0]["number"] + 1 if known else 0,
        "tables": {k: df.schema.jsonValue() for k, df in tables.items()},
    }
    hidden, final = f"{root}/manifests/_{attempt}.tmp", f"{root}/manifests/{attempt}.json"
    _text_file(spark, hidden, json.dumps(told))
    store, at = file_system(spark, hidden)
    store.rename(at, file_system(spark, final)[1])


def save(spark: SparkSession, root: str, settings: dict, tables: Tables) -> None:
    """Write tables with a ``combo_idx`` and make their designs known as finished."""
    attempt = write_attempt(spark, root, tables)
    designs = None
    for df in tables.values():
        part = df.select("combo_idx").distinct()
        designs = part if designs is None else designs.unionByName(part)
    commit(spark, root, settings, attempt, tables, [r["combo_idx"] for r in designs.distinct().collect()])  # designs


def finished(spark: SparkSession, root: str, settings: dict) -> list[int]:
    return sorted({c for m in manifests(spark, root, settings) for c in m["designs"]})


def load(spark: SparkSession, root: str, settings: dict) -> Tables:
    """The tables of all finished designs, each from its last attempt."""
    seen: set[int] = set()
    out: Tables = {}
    for m in manifests(spark, root, settings):
        new = [c for c in m["designs"] if c not in seen]
        seen.update(new)
        for table, schema in m["tables"].items() if new else ():
            kind = T.StructType.fromJson(schema)
            part = spark.read.schema(kind).parquet(f"{root}/attempts/{m['attempt']}/{table}").filter(F.col("combo_idx").isin(new)).select(kind.names)
            out[table] = part if table not in out else out[table].unionByName(part)
    return out


def reuse_designs(spark: SparkSession, root: str, settings: dict, designs: list[int], build: Callable[[list[int]], Tables]) -> Tables:
    """The tables of ``designs``; only those not finished are built and saved."""
    lacking = sorted(set(designs) - set(finished(spark, root, settings)))
    if lacking:
        save(spark, root, settings, build(lacking))
    return {k: df.filter(F.col("combo_idx").isin(designs)) for k, df in load(spark, root, settings).items()}


def discard_unfinished(spark: SparkSession, root: str) -> int:
    """Delete what attempts without a manifest have left; how many there were. Not while another run writes."""
    store, at = file_system(spark, f"{root}/attempts")
    kept, gone = file_system(spark, f"{root}/manifests"), 0
    names = {s.getPath().getName()[:-5] for s in kept[0].listStatus(kept[1])} if kept[0].exists(kept[1]) else set()
    for status in store.listStatus(at) if store.exists(at) else ():
        if status.getPath().getName() not in names:
            store.delete(status.getPath(), True)
            gone += 1
    return gone
