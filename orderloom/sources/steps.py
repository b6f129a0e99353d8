"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's path in spark.checkpoint.dir; on a local master, where that is unset, in a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="orderloom-")
    return f"{path}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again: cuts lineage, survives lost executors, and is worked out once however often it is read."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: texts of more than so many rows are joined by shuffles
MOST_SENT = 10_000


def met(rows: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    """rows with what `few`, a stored table with all their keys once, says of them. It is sent to all tasks up to MOST_SENT rows, beyond
    that both are shuffled; rows are never sent, however small the optimiser takes them to be."""
    return rows.join(F.broadcast(few) if few.limit(MOST_SENT + 1).count() <= MOST_SENT else few.hint("merge"), list(keys), "left")


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df dealt by the keys into as many partitions as the session has for shuffles. Adaptive planning puts partitions of few bytes
    together; where such rows are costly to work on, this keeps them apart. Rows that lie by the same keys already are not dealt again,
    and then are put together: after distinct() give a hash of the keys."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
