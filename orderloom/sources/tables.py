"""Scans: plain tables, dated snapshots, tolerant JSON stores, file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot(spark: SparkSession, root: str, day: str) -> DataFrame:
    """One day's rows of a snapshot table partitioned by snapshot_date; the filter prunes partitions."""
    return spark.read.parquet(root).filter(F.col("snapshot_date") == F.to_date(F.lit(day)))


def latest_day(days: DataFrame, today: str, lookback: int = 14, day_col: str = "snapshot_date") -> DataFrame:
    """The latest day strictly before today and at most lookback days back; no row where there is none."""
    day, now = F.col(day_col).cast("date"), F.to_date(F.lit(today))
    return days.filter((day < now) & (day >= F.date_sub(now, lookback))).agg(F.max(day).alias(day_col)).filter(F.col(day_col).isNotNull())


def json_store(spark: SparkSession, path: str, schema: str, malformed: str | None = None) -> DataFrame:
    """A JSON-lines store; absent keys are null, a store that is not there yet is empty. Malformed lines are left out, or kept
    whole in the column named `malformed`."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if malformed:
        schema = f"{schema}, `{malformed}` string"
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    if malformed:
        return spark.read.schema(schema).option("columnNameOfCorruptRecord", malformed).json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, modified, size of the files below root; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def job_folders(files: DataFrame, low: int, high: int) -> DataFrame:
    """Rows of a listing whose path holds <type>/<range>/<job>/ with the job between low and high."""
    parts = F.regexp_extract("path", r"([^/]+)/[^/]+/([0-9]+)/[^/]+$", 2)
    return files.withColumn("job", F.expr("try_cast(regexp_extract(path, '([^/]+)/[^/]+/([0-9]+)/[^/]+$', 2) as bigint)")).filter((parts != "") & F.col("job").between(low, high))


def drawing_files(files: DataFrame) -> DataFrame:
    """job, suffix, kinds: extensions of the files named <job>-<suffix>.<ext>."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    found = files.select(F.regexp_extract(name, r"^([0-9]+)-([0-9]{2})", 1).alias("job"), F.regexp_extract(name, r"^([0-9]+)-([0-9]{2})", 2).alias("suffix"), F.upper(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))
    return found.filter("job <> '' and ext <> ''").groupBy("job", "suffix").agg(F.array_sort(F.collect_set("ext")).alias("kinds"))


def text_rows(words: DataFrame) -> DataFrame:
    """Words (doc, page, top, x0, text) put together to rows of one rounded height, from left to right."""
    return words.groupBy("doc", "page", F.round("top").cast("int").alias("row")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"))
