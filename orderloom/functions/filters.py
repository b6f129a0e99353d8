"""Predicates on orders, runs and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def penalty(item: Column) -> Column:
    return F.coalesce(item.rlike("(?i)penalty"), F.lit(False))


def repair_order(job: Column) -> Column:
    return F.coalesce(job.rlike("[A-Za-z]$"), F.lit(False))


def removed_today(seen: Column, on_queue: Column, left: Column, today: Column) -> Column:
    return seen & ~on_queue & (left.cast("date") == today)


def stale(rows: DataFrame, now: Column, verified: str, job: str, present: Column, minutes: int = 45, most: int = 2) -> DataFrame:
    """The `most` rows that are present, no repair orders, and never verified or longest ago, over `minutes`."""
    old = F.col(verified).isNull() | (F.unix_timestamp(now) - F.unix_timestamp(verified) > 60 * minutes)
    return rows.filter(present & ~repair_order(F.col(job)) & old).orderBy(F.asc_nulls_first(verified), job).limit(most)


def done(status: Column, kind: Column, attempts: Column, version: Column, current: str) -> Column:
    """Nothing left to fetch: read with a document kind, or missed twice by the present version."""
    read = (status == "ok") & (F.coalesce(kind, F.lit("")) != "")
    missed = status.isin("not-found", "no-so") & (attempts >= 2) & (version == current)
    return F.coalesce(read | missed, F.lit(False))


def backfill_status(found: Column, accepted: Column, runs: Column, fetched: Column) -> Column:
    return F.when(~found, "not-found").when(~accepted, "no-SO").when(runs == fetched, "ok").otherwise("error")


def changed_files(files: DataFrame, cache: DataFrame, history: DataFrame, path: str = "path") -> DataFrame:
    """Files whose time or size is not as at the last clean scan, or that have a report history."""
    fresh = files.join(cache.select(path, "modified", "size"), [path, "modified", "size"], "left_anti")
    return fresh.unionByName(files.join(history.select(path), path, "left_semi")).distinct()


def invalidated(report: Column, verified: Column) -> Column:
    """The newest invalidation, unless a verification came at the same time or later."""
    return F.when(report.isNotNull() & (verified.isNull() | (verified < report)), report)


def repriced(price: Column, before: Column) -> Column:
    return before.isNotNull() & ~price.eqNullSafe(before)


def noise(fact: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(fact).rlike("|".join(words)), F.lit(False))


def any_column(term: str, columns: list[str]) -> Column:
    """Whether one of the columns holds the term, whatever its case."""
    return F.contains(F.upper(F.concat_ws("\n", *(F.col(c).cast("string") for c in columns))), F.lit(term.upper()))


def event_excluded(field: Column, old: Column, new: Column, fields: list[str]) -> Column:
    return field.isin(fields) | (F.coalesce(old, F.lit("")) == F.coalesce(new, F.lit("")))
