"""Versions of a table with optimistic commits: read a version, merge, write the next; whoever comes second merges again.

root/log/<version>.json names the data folder of each version. It is created, never overwritten, which file systems do as one step;
data are written before, so that a version is seen whole or not at all, and what a writer that lost had written is never read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    path, fs = _fs(spark, f"{root}/log")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json")) if fs.exists(path) else []


def entry(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/log/{version:012d}.json").collect()))


def latest(spark: SparkSession, root: str) -> dict | None:
    """version, data, note of the newest version."""
    known = versions(spark, root)
    return entry(spark, root, known[-1]) if known else None


def read(spark: SparkSession, root: str, version: dict) -> DataFrame:
    return spark.read.parquet(f"{root}/data/{version['data']}")


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file is new; one that exists stays as it is."""
    p, fs = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def commit(spark: SparkSession, root: str, merge: Callable[[DataFrame | None], DataFrame], note: dict | None = None, tries: int = 10) -> dict:
    """Writes merge(rows of the newest version, or None) as the next version; if another writer took that number meanwhile, reads and
    merges again, so that nobody's rows are lost."""
    for _ in range(tries):
        last = latest(spark, root)
        data = uuid.uuid4().hex
        merge(None if last is None else read(spark, root, last)).write.parquet(f"{root}/data/{data}")
        new = {"version": last["version"] + 1 if last else 1, "data": data, "note": note or {}}
        if create(spark, f"{root}/log/{new['version']:012d}.json", json.dumps(new)):
            return new
    raise RuntimeError(f"{root}: others wrote {tries} times meanwhile")
