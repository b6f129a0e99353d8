"""Results that are worked out again only if their inputs changed, and not more often than an age allows."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.operators import commits

log = logging.getLogger(__name__)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Of the files below the paths: their names, lengths and times. One row comes to the driver; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select(F.xxhash64("path", "length", "modificationTime").alias("h"), "length")
    r = files.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum("length").alias("size")).first()
    return f"{r.n}:{r.x}:{r.size}"


def keys_of(rows: DataFrame, key: str) -> str:
    """Of a set of keys, whatever their order."""
    r = rows.select(F.xxhash64(F.col(key).cast("string")).alias("h")).distinct().agg(F.count("*").alias("n"), F.bit_xor("h").alias("x")).first()
    return f"{r.n}:{r.x}"


def gated(spark: SparkSession, root: str, inputs: str, queue: str, compute: Callable[[], DataFrame], now: float, least_age: float = 0.0) -> DataFrame:
    """compute()'s rows, stored under root as a new version; or the stored ones if inputs and queue are as they were, or if the queue
    is and the stored ones are younger than least_age seconds. A computation that fails leaves the stored rows, if there are any."""
    last = commits.latest(spark, root)
    if last is not None:
        known = last["note"]
        if known["inputs"] == inputs and known["queue"] == queue:
            return commits.read(spark, root, last)
        if known["queue"] == queue and now - known["at"] < least_age:
            return commits.read(spark, root, last)
    try:
        made = commits.commit(spark, root, lambda _: compute(), note={"inputs": inputs, "queue": queue, "at": now})
    except Exception:
        if last is None:
            raise
        log.warning("not worked out again; the stored rows stay", exc_info=True)
        return commits.read(spark, root, last)
    return commits.read(spark, root, made)
