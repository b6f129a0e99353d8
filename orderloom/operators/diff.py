"""Differences between dated snapshots of a queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def norm_value(col: Column) -> Column:
    """Comparable text: null is empty, booleans and numbers as text, trimmed."""
    return F.trim(F.coalesce(col.cast("string"), F.lit("")))


def added(today: DataFrame, before: DataFrame, key: str) -> DataFrame:
    return today.join(before.select(key), key, "left_anti")


def removed(today: DataFrame, before: DataFrame, key: str) -> DataFrame:
    return before.join(today.select(key), key, "left_anti")


def returning(today: DataFrame, before: DataFrame, history: DataFrame, key: str, seen_col: str) -> DataFrame:
    """Rows added today that history knows, with the day they were last seen."""
    seen = history.groupBy(key).agg(F.max(seen_col).alias("last_seen"))
    return added(today, before, key).join(seen, key)


def changed_fields(today: DataFrame, before: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old, new: one row for each field whose comparable text differs."""
    old = before.select(key, F.array(*(norm_value(F.col(f)) for f in fields)).alias("old_values"))
    new = today.select(key, F.array(*(norm_value(F.col(f)) for f in fields)).alias("new_values"))
    names = F.array(*map(F.lit, fields))
    rows = new.join(old, key).select(key, F.explode(F.arrays_zip(names.alias("field"), F.col("old_values").alias("old"), F.col("new_values").alias("new"))).alias("f"))
    return rows.select(key, F.col("f.field").alias("field"), F.col("f.old").alias("old"), F.col("f.new").alias("new")).filter("old <> new")


def raised(today: DataFrame, before: DataFrame, key: str, number: str) -> DataFrame:
    """Keys whose number rose; a key without a number before is not a rise."""
    old = before.select(key, F.col(number).alias("old_number"))
    return today.select(key, F.col(number).alias("new_number")).join(old, key).filter("old_number is not null and new_number > old_number")


def persistence(presence: DataFrame, key: str, day: str, least: int = 3) -> DataFrame:
    """key, days: how many of the latest days that exist in a row, the last one included, a key was present; `least` or more.

    Days are ranked among those that exist, so a missing day breaks no streak."""
    days = presence.select(day).distinct().withColumn("back", F.row_number().over(W.orderBy(F.desc(day))))  # one row a day
    ranked = presence.select(key, day).distinct().join(F.broadcast(days), day)
    streak = ranked.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("back"))).filter("back = n")
    return streak.groupBy(key).agg(F.count("*").alias("days")).filter(F.col("days") >= least)


def new_today(board: DataFrame, morning: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """On the board and either not in the morning's snapshot or flagged as new."""
    fresh = board.select(key).join(morning.select(key), key, "left_anti").union(flagged.select(key)).distinct()
    return board.join(fresh, key, "left_semi")
