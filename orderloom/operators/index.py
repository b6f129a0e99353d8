"""A stored inverted index of orders' features, kept up by deltas.

Postings (kind, feature, job, version) lie in buckets by feature, as partitions of one Parquet table, so that a target reads the
buckets of its own features only. An order that is parsed again adds postings of a higher version; a small table of such orders
tells which of their postings count. compact() writes what counts as a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.operators.search import similar

BUCKETS = 64
POSTINGS = "kind string, feature string, job long, version long, bucket int"
UPDATES = "job long, version long"


def bucketed(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return features.withColumn("bucket", F.pmod(F.xxhash64("kind", "feature"), F.lit(buckets)).cast("int"))


def add(features: DataFrame, root: str, version: int, jobs: DataFrame | None = None) -> None:
    """Adds the features (job, kind, feature) of orders as of a version, 0 for the first. jobs: the orders that were parsed again,
    whether they have features now or not; their former postings no longer count. Versions must rise. A feature that many orders
    have is spread over files."""
    rows = bucketed(features.select("kind", "feature", F.col("job").cast("long").alias("job")).distinct().withColumn("version", F.lit(version).cast("long")))
    rows.repartitionByRange("bucket", "feature", "job").write.mode("append").partitionBy("bucket").parquet(f"{root}/postings")
    if jobs is not None:
        jobs.select(F.col("job").cast("long").alias("job"), F.lit(version).cast("long").alias("version")).distinct().write.mode("append").parquet(f"{root}/updates")


def postings(spark: SparkSession, root: str, of: DataFrame | None = None, buckets: int = BUCKETS, few: bool = False) -> DataFrame:
    """job, kind, feature of what counts; with `of` (kind, feature) of the buckets of these only (at most `buckets` numbers come to
    the driver); few: of these features only."""
    rows = spark.read.schema(POSTINGS).parquet(f"{root}/postings")
    if of is not None:
        wanted = [r[0] for r in bucketed(of.select("kind", "feature"), buckets).select("bucket").distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(wanted))
        if few:
            rows = rows.join(of.select("kind", "feature").distinct(), ["kind", "feature"], "left_semi")
    return current(rows, updates(spark, root)).select("job", "kind", "feature")


def updates(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/updates")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(UPDATES).parquet(f"{root}/updates").groupBy("job").agg(F.max("version").alias("latest"))


def current(rows: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Rows of orders that were never parsed again, and of the others those of the latest version. The table of these grows with the
    orders, so it is not sent to all tasks."""
    if changed is None:
        return rows
    return rows.join(changed.hint("shuffle_hash"), "job", "left").filter(F.col("latest").isNull() | (F.col("version") == F.col("latest"))).drop("latest")


def ranked(spark: SparkSession, root: str, target: DataFrame, exclude: int | None = None, only: DataFrame | None = None, top: int = 15) -> DataFrame:
    """similar() on the index: job, score, shared of the orders most like the target's features (kind, feature)."""
    wanted = target.select("kind", "feature").distinct()
    rows = postings(spark, root, wanted, few=True)
    return similar(rows if exclude is None else rows.filter(F.col("job") != exclude), target, only=only, top=top)


def compact(spark: SparkSession, root: str, to: str) -> None:
    """What counts, as a new index of version 0."""
    add(postings(spark, root), to, 0)
