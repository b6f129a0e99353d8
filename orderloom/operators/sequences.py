"""Ordered folds as window operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def placed(rows: DataFrame, order: list[str], into: str, ranges: int = 64) -> DataFrame:
    """rows with their place (from 1) by the order columns, ascending. Rows are dealt into ranges of the first column, whose
    bounds come from a sample of 1,024 values; a range is numbered on its own and the ranges before it are counted."""
    first = F.col(order[0])
    sample = sorted(r[0] for r in rows.select(first).filter(first.isNotNull()).orderBy(F.xxhash64(first)).limit(1024).collect())
    bounds = sample[:: max(1, len(sample) // ranges)][1:]
    kind = rows.select(first).schema[0].dataType
    part = F.size(F.filter(F.array(*(F.lit(b).cast(kind) for b in bounds)), lambda b: b <= first)) if bounds else F.lit(0)
    dealt = rows.withColumn("__part", F.when(first.isNull(), -1).otherwise(part))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__offset", F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).drop("__n")  # a row for each range
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(offsets), "__part").withColumn(into, (F.col("__own") + F.col("__offset")).cast("long")).drop("__part", "__own", "__offset")


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def first_of_each(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return ranked(rows, by, order, "__rank").filter("__rank = 1").drop("__rank")


def revision_key(name: Column) -> Column:
    """(highest CO#n, highest REV letter or number) of a file name; 0 where there is none."""
    numbers = F.transform(F.regexp_extract_all(F.upper(name), F.lit(r"CO\s*#?\s*([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    revs = F.transform(F.regexp_extract_all(F.upper(name), F.lit(r"\bREV\.?\s*([0-9]+|[A-Z])\b"), F.lit(1)), lambda x: F.when(x.rlike("^[0-9]+$"), x).otherwise((F.ascii(x) - 64).cast("string")).cast("int"))
    return F.struct(F.coalesce(F.array_max(numbers), F.lit(0)).alias("co"), F.coalesce(F.array_max(revs), F.lit(0)).alias("rev"))


def transitions(events: DataFrame, by: list[str], order: str, value: list[str]) -> DataFrame:
    """Events whose value differs from the one before: dropping equal neighbours is dropping what equals the last one kept."""
    same = F.lag(F.struct(*value)).over(W.partitionBy(*by).orderBy(order))
    return events.withColumn("__last", same).filter(F.col("__last").isNull() | ~F.col("__last").eqNullSafe(F.struct(*value))).drop("__last")


def in_out(presence: DataFrame, key: str, bucket: str, first: int, last: int) -> DataFrame:
    """key, bucket, event: in where a presence starts, out in the bucket after it ends (not after the last)."""
    w = W.partitionBy(key).orderBy(bucket)
    rows = presence.select(key, bucket).distinct().withColumns({"__prev": F.lag(bucket).over(w), "__next": F.lead(bucket).over(w)})
    ins = rows.filter(F.col("__prev").isNull() | (F.col("__prev") < F.col(bucket) - 1)).select(key, bucket, F.lit("in").alias("event"))
    outs = rows.filter((F.col("__next").isNull() | (F.col("__next") > F.col(bucket) + 1)) & (F.col(bucket) < last)).select(key, (F.col(bucket) + 1).alias(bucket), F.lit("out").alias("event"))
    return ins.unionByName(outs)


def recent_duplicates(rows: DataFrame, order: str, digest: str, within: int = 25) -> DataFrame:
    """Rows whose digest occurs among the `within` rows before; earlier: the nearest of them.

    Rows get their places first; a row is compared with the row before it that has its digest, so nothing is gathered."""
    w = W.partitionBy(digest).orderBy("__place")
    near = placed(rows, [order], "__place").withColumns({"earlier": F.lag(order).over(w), "__before": F.lag("__place").over(w)})
    return near.filter(F.col("__place") - F.col("__before") <= within).drop("__place", "__before")


def row_keys(rows: DataFrame, by: str, base: str, order: list[Column], name: str = "row_key") -> DataFrame:
    """The base key, with |n for its n-th repetition within `by`."""
    n = F.row_number().over(W.partitionBy(by, base).orderBy(*order))
    return rows.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("|", F.col(base), n.cast("string"))))


def miss_streaks(rows: DataFrame, by: list[str], order: str, missed: Column, least: int = 15) -> DataFrame:
    """streak: place in the present run of misses (0: no miss); probe: the run has reached a multiple of `least`."""
    w = W.partitionBy(*by).orderBy(order)
    run = rows.withColumn("__run", F.sum(F.when(missed, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    streak = F.sum(F.when(missed, 1).otherwise(0)).over(W.partitionBy(*by, "__run").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return run.withColumn("streak", streak).withColumn("probe", (F.col("streak") > 0) & (F.col("streak") % least == 0)).drop("__run")


def carried(rows: DataFrame, by: list[str], order: str, opens: Column, closes: Column, value: Column, name: str) -> DataFrame:
    """The value of the last opening row, until a closing one."""
    event = F.when(opens, F.struct(F.lit(True).alias("open"), value.alias("v"))).when(closes, F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("v")))
    last = F.last(event, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__last", last).withColumn(name, F.when(F.col("__last.open"), F.col("__last.v"))).drop("__last")


def streaks(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """island: the same for consecutive whole numbers of `order`."""
    return rows.withColumn("island", F.col(order) - F.row_number().over(W.partitionBy(*by).orderBy(order)))


def first_and_last(events: DataFrame, by: list[str], order: str, old: str, new: str) -> DataFrame:
    """Of each group: the first old value, the last new one, and the number of steps."""
    return events.groupBy(*by).agg(F.min_by(old, order).alias("first_old"), F.max_by(new, order).alias("last_new"), F.count("*").alias("steps"))


def closest_preceding(notes: Column, n: Column) -> Column:
    """Of an array of (number, text): the text of number n, else of the closest below, else of the nearest above."""
    below = F.array_max(F.filter(notes, lambda x: x["number"] <= n))
    above = F.array_min(F.filter(notes, lambda x: x["number"] > n))
    return F.coalesce(below["text"], above["text"])


def baseline_flood(events: DataFrame, time: str, least: int = 8) -> DataFrame:
    """Without the earliest batch, if that has `least` events or more."""
    first = events.groupBy(F.col(time).alias("__t")).agg(F.count("*").alias("__n")).orderBy("__t").limit(1).filter(F.col("__n") >= least)
    return events.join(F.broadcast(first), F.col(time) == F.col("__t"), "left_anti")
