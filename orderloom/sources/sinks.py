"""Sinks: dated snapshots, append-only event logs, keyed upserts, range shards with a manifest, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.functions.text import let
from orderloom.sources.steps import spread


def write_snapshot(rows: DataFrame, root: str, day: str, once: bool = False) -> None:
    """The rows as that day's partition; other days stay. once: an existing day is kept as it is."""
    spark = rows.sparkSession
    if once:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot_date={day}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return
    rows.withColumn("snapshot_date", F.to_date(F.lit(day))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(root)


def append_events(events: DataFrame, root: str) -> None:
    events.withColumn("day", F.to_date("time")).write.mode("append").partitionBy("day").parquet(root)


def signature(columns: list[str]) -> Column:
    return F.md5(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)))


def upsert_plan(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, op: append, update or delete, from row signatures; rows that did not change are left out."""
    old = before.select(key, signature(columns).alias("old"))
    new = after.select(key, signature(columns).alias("new"))
    both = old.join(new, key, "full_outer")
    op = F.when(F.col("old").isNull(), "append").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    return both.select(key, op.alias("op")).filter("op is not null")


def shard_manifest(rows: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """low, high (range of keys), rows, first, last of each shard of `width` keys."""
    low = (F.floor(F.col(key) / width) * width).cast("long")
    return rows.groupBy(low.alias("low")).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last")).withColumn("high", F.col("low") + width - 1)


def byte_shards(rows: DataFrame, key: str, size: Column, most: int, width: int = 1000) -> DataFrame:
    """low, high, rows, bytes of shards: ranges of `width` keys, each halved until it has at most `most` bytes or one key. size: the
    bytes of a row. Keys are long, from 0.

    Rows are added up to keys, and only these are moved, once: a range of `width` keys lies in one task, which adds up its halvings
    level by level. Each key takes the widest range that fits."""
    levels = width.bit_length()
    base, at = (F.floor(F.col("k") / width) * width).cast("long"), F.pmod(F.col("k"), F.lit(width))
    keys = rows.groupBy(F.col(key).cast("long").alias("k")).agg(F.count("*").alias("rows"), F.sum(size.cast("long")).alias("bytes")).withColumn("base", base)
    whole = F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("low"), F.lit(width - 1).cast("long").alias("high"))

    def halved(acc: Column, i: Column) -> Column:
        def half(r: Column) -> Column:
            mid = F.floor((r["low"] + r["high"]) / 2)
            return F.struct(i.alias("level"), F.when(at <= mid, r["low"]).otherwise(mid + 1).alias("low"), F.when(at <= mid, mid).otherwise(r["high"]).alias("high"))

        return F.array_append(acc, let(F.element_at(acc, -1), half))

    spans = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(whole), halved)
    each = spread(keys, "base").withColumn("r", spans)
    shards = []
    for i in range(levels + 1):
        low, high = (F.col("base") + F.col("r")[i][side] for side in ("low", "high"))
        each = each.withColumn(f"low{i}", low)
        total = W.partitionBy("base", f"low{i}")
        each = each.withColumns({f"rows{i}": F.sum("rows").over(total), f"bytes{i}": F.sum("bytes").over(total)})
        shard = F.struct(F.col(f"low{i}").alias("low"), high.alias("high"), F.col(f"rows{i}").alias("rows"), F.col(f"bytes{i}").alias("bytes"))
        shards.append(F.when((F.col(f"bytes{i}") <= most) | (F.col(f"low{i}") == high), shard))
    return each.select(F.coalesce(*shards).alias("s")).filter("s is not null").select("s.low", "s.high", "s.rows", "s.bytes").distinct()


def write_shards(rows: DataFrame, key: str, root: str, width: int = 1000, max_rows: int = 1_000_000) -> DataFrame:
    """JSON files by range of keys, split where a range has more than max_rows; the manifest is returned."""
    sharded = rows.withColumn("shard", (F.floor(F.col(key) / width) * width).cast("long"))
    sharded.repartitionByRange("shard", key).write.mode("overwrite").option("maxRecordsPerFile", max_rows).partitionBy("shard").json(root)
    return shard_manifest(rows, key, width)


def archive_split(rows: DataFrame, day_col: str, today: str, keep_days: int = 60) -> DataFrame:
    """Marks rows older than keep_days as archived."""
    return rows.withColumn("archived", F.col(day_col).cast("date") < F.date_sub(F.to_date(F.lit(today)), keep_days))


def obsolete(files: DataFrame, folder: str, order: list[Column]) -> DataFrame:
    """All but the best-ranked row of each folder."""
    return files.withColumn("rank", F.row_number().over(W.partitionBy(folder).orderBy(*order))).filter("rank > 1")
