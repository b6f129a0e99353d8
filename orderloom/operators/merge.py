"""Keyed merges: states folded with batches, sources laid over each other, values that never regress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.operators.sequences import placed


def filled(col: Column) -> Column:
    """Null where the text is empty."""
    return F.when(F.trim(col.cast("string")) != "", col)


def record_poll(state: DataFrame, batch: DataFrame, key: str, fields: list[str], now: Column, baseline: bool = False) -> DataFrame:
    """State (key, fields, first_seen, last_seen, present, carried_over) after a poll; delta: new, returning, removed or null.

    first_seen never moves; fields are refreshed for what is present; a baseline poll announces nothing."""
    s, b = state.alias("s"), batch.alias("b")
    both = s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full_outer")
    here, known = F.col(f"b.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()
    delta = F.when(F.lit(baseline), None).when(here & ~known, "new").when(here & ~F.col("s.present"), "returning").when(~here & F.col("s.present"), "removed")
    return both.select(
        F.coalesce(f"b.{key}", f"s.{key}").alias(key),
        *(F.when(here, F.col(f"b.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in fields),
        F.coalesce("s.first_seen", now).alias("first_seen"),
        F.when(here, now).otherwise(F.col("s.last_seen")).alias("last_seen"),
        here.alias("present"),
        F.coalesce("s.carried_over", F.lit(baseline)).alias("carried_over"),
        delta.alias("delta"),
    )


def insert_missing(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return state.unionByName(rows.join(state.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_filled(current: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Upsert in which an empty incoming value never replaces one that is filled."""
    c, i = current.alias("c"), incoming.alias("i")
    both = c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer")
    return both.select(F.coalesce(f"i.{key}", f"c.{key}").alias(key), *(F.coalesce(filled(F.col(f"i.{f}")), F.col(f"c.{f}")).alias(f) for f in fields))


def merge_sparse(current: DataFrame, incoming: DataFrame, key: str, fields: list[str], given: str = "present_fields") -> DataFrame:
    """Upsert in which only the fields named in `given` replace; a field that is named and empty is blanked."""
    c, i = current.alias("c"), incoming.alias("i")
    both = c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer")
    pick = lambda f: F.when(F.col(f"i.{key}").isNotNull() & F.coalesce(F.array_contains(f"i.{given}", f), F.lit(False)), F.col(f"i.{f}")).otherwise(F.col(f"c.{f}"))
    return both.select(F.coalesce(f"i.{key}", f"c.{key}").alias(key), *(pick(f).alias(f) for f in fields))


def last_writer(current: DataFrame, incoming: DataFrame, key: str, stamp: str, fields: list[str]) -> DataFrame:
    """The row of the later stamp whole, deliberate blanks included; on ties the incoming one."""
    rows = current.select(key, stamp, *fields, F.lit(0).alias("side")).unionByName(incoming.select(key, stamp, *fields, F.lit(1).alias("side")))
    best = F.max_by(F.struct(stamp, *fields), F.struct(F.coalesce(F.col(stamp).cast("double"), F.lit(float("-inf"))), "side"))
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def overlay(main: DataFrame, over: DataFrame, key: str, stamp: str) -> DataFrame:
    """Union by key: the freshest row wins, on ties the main one."""
    rows = main.withColumn("__main", F.lit(1)).unionByName(over.withColumn("__main", F.lit(0)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc_nulls_last(stamp), F.desc("__main")))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank", "__main")


def keep_better(current: DataFrame, incoming: DataFrame, key: str, number: str, source: str, fields: list[str]) -> DataFrame:
    """Incoming fields, unless they would go back: a lower number, or the same number without its source document."""
    c, i = current.alias("c"), incoming.alias("i")
    back = (F.col(f"i.{number}") < F.col(f"c.{number}")) | ((F.col(f"i.{number}") == F.col(f"c.{number}")) & filled(F.col(f"i.{source}")).isNull() & filled(F.col(f"c.{source}")).isNotNull())
    keep = F.col(f"i.{key}").isNull() | F.coalesce(back, F.lit(False))
    both = c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "full_outer")
    return both.select(F.coalesce(f"i.{key}", f"c.{key}").alias(key), *(F.when(keep, F.col(f"c.{f}")).otherwise(F.col(f"i.{f}")).alias(f) for f in (number, source, *fields)), (keep & F.col(f"i.{key}").isNotNull()).alias("kept_current"))


def cleared(rows: DataFrame, when: Column, fields: list[str]) -> DataFrame:
    """Fields set to null together where a document was invalidated."""
    return rows.withColumns({f: F.when(~when, F.col(f)) for f in fields})


def three_way(base: DataFrame, mine: DataFrame, theirs: DataFrame, key: str, field: str) -> DataFrame:
    """My change if I made one, else theirs."""
    b, m, t = (d.select(key, F.col(field).alias(n)) for d, n in ((base, "b"), (mine, "m"), (theirs, "t")))
    both = m.join(t, key, "full_outer").join(b, key, "left")
    return both.select(key, F.when(~F.col("m").eqNullSafe(F.col("b")), F.col("m")).otherwise(F.col("t")).alias(field))


def added_notes(notes: DataFrame, more: DataFrame, identity: list[str], id_col: str) -> DataFrame:
    """Notes with those that they do not hold; new ids follow the highest one, by identity."""
    fresh = more.dropDuplicates(identity).join(notes.select(*identity), identity, "left_anti")
    top = notes.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    numbered = placed(fresh, identity, id_col)
    return notes.unionByName(numbered.crossJoin(F.broadcast(top)).withColumn(id_col, F.col(id_col) + F.col("top")).drop("top"), allowMissingColumns=True)


def history_advance(day_start: DataFrame, back_again: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The history after a day, from its version at the day's start: what came back goes, what left comes in. Doing it again
    changes nothing."""
    return day_start.join(back_again.select(key), key, "left_anti").join(gone.select(key), key, "left_anti").unionByName(gone, allowMissingColumns=True)


def change_events(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old, new of merged rows; a value that was empty is no event."""
    from orderloom.operators.diff import changed_fields

    return changed_fields(after, before, key, fields).filter("old <> ''")


def without_phantoms(events: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Events that blank a value which is still there go."""
    held = current.select(key, F.col(value).cast("string").alias("__held"))
    phantom = (F.col("new") == "") & F.coalesce(F.col("__held") == F.col("old"), F.lit(False))
    return events.join(held, key, "left").filter(~phantom).drop("__held")
