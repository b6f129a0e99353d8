"""Records put together from several stores, marks folded into them, and their orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.functions.labels import CHANGE_ORDER
from orderloom.operators.merge import filled


def with_drawings(hits: DataFrame, scan: DataFrame, key: str) -> DataFrame:
    """hits with their drawing scan (extras, folder) and whether there is one."""
    found = scan.select(key, "extras", "folder", F.lit(True).alias("scanned"))
    joined = hits.join(found, key, "left")
    return joined.withColumns({"extras": F.coalesce("extras", F.create_map().cast("map<string,string>")), "folder": F.coalesce("folder", F.lit("")), "scanned": F.coalesce("scanned", F.lit(False))})


def with_cached_tags(items: DataFrame, cache: DataFrame, norm: str, tags: str) -> DataFrame:
    """Items without tags get those that the cache (norm, tags) has for their normal form, sorted."""
    known = cache.select(norm, F.array_sort(F.array_distinct(tags)).alias("__cached"))
    joined = items.join(known, norm, "left")
    return joined.withColumn(tags, F.when((F.coalesce(F.size(tags), F.lit(0)) <= 0) & (F.size("__cached") > 0), F.col("__cached")).otherwise(F.col(tags))).drop("__cached")


def with_marks(notes: DataFrame, marks: DataFrame, key: str, now: Column) -> DataFrame:
    """Open notes that the ledger marks become handled, with its resolution and time; closed: those that became so now."""
    found = marks.select(key, F.col("resolution").alias("__resolution"), F.col("handled_at").alias("__at"), F.lit(True).alias("__marked"))
    joined = notes.join(found, key, "left").withColumn("closed", F.coalesce("__marked", F.lit(False)) & (F.coalesce("status", F.lit("")) != "handled"))
    return joined.withColumns(
        {
            "status": F.when(F.col("closed"), "handled").otherwise(F.col("status")),
            "resolution": F.when(F.col("closed"), F.coalesce("__resolution", F.lit(""))).otherwise(F.col("resolution")),
            "handled_at": F.when(F.col("closed"), F.coalesce("__at", now)).otherwise(F.col("handled_at")),
        }
    ).drop("__resolution", "__at", "__marked")


def explorer_records(store: DataFrame, queue: DataFrame, master: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """All keys of the three; each field's first filled value, of the queue, then the master, then the store; whether on the board
    and in the master."""
    q, m, s = (d.select(key, *(filled(F.col(f)).alias(f"{side}_{f}") for f in fields), F.lit(True).alias(side)) for d, side in ((queue, "q"), (master, "m"), (store, "s")))
    every = s.join(q, key, "full_outer").join(m, key, "full_outer")
    return every.select(key, *(F.coalesce(f"q_{f}", f"m_{f}", f"s_{f}").alias(f) for f in fields), F.coalesce("q", F.lit(False)).alias("on_board"), F.coalesce("m", F.lit(False)).alias("in_master"))


def master_or_store(master: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Master rows, and of what only the store knows rows that came and left when it was scanned."""
    only = store.join(master.select(key), key, "left_anti").withColumns({"on_queue": F.lit(False), "added": F.col("scanned_at"), "left": F.col("scanned_at")}).drop("scanned_at")
    return master.unionByName(only, allowMissingColumns=True)


def realigned(current: DataFrame, given: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """current with the given rows' fields (a null is a field that is not known), no rows more; changed: whether a row differs now."""
    new = given.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    joined = current.join(new, key, "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.coalesce(F.col(f"__{f}"), F.col(f)).eqNullSafe(F.col(f))
    return joined.withColumn("changed", differs).withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*(f"__{f}" for f in fields))


def folded(master: DataFrame, sources: list[tuple[str, DataFrame, Column | None]], key: str, fields: list[str]) -> DataFrame:
    """master with the sources folded in, one after another: filled values replace, where the source's guard (a condition on the
    master's columns and `scanned_at`) holds. n_<name>: whether the source changed the row."""
    out = master
    for name, rows, guard in sources:
        own = [f for f in fields if f in rows.columns]
        stamp = F.col("scanned_at") if "scanned_at" in rows.columns else F.lit(None).cast("string")
        joined = out.join(rows.select(key, *(filled(F.col(f)).alias(f"__{f}") for f in own), stamp.alias("__scanned_at")), key, "left")
        allowed = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
        values = {f: F.when(allowed, F.coalesce(f"__{f}", f)).otherwise(F.col(f)) for f in own}
        differs = F.lit(False)
        for f, v in values.items():
            differs = differs | ~v.eqNullSafe(F.col(f))
        out = joined.withColumn(f"n_{name}", differs).withColumns(values).drop(*(f"__{f}" for f in own), "__scanned_at")
    return out


def recorded(store: DataFrame, parsed: DataFrame, key: str, kept: list[str], latest: list[str]) -> DataFrame:
    """The store with the latest parse: `kept` fields never become empty again, `latest` are taken as they are."""
    s, p = store.alias("s"), parsed.alias("p")
    here = F.col(f"p.{key}").isNotNull()
    both = s.join(p, F.col(f"s.{key}") == F.col(f"p.{key}"), "full_outer")
    return both.select(F.coalesce(f"p.{key}", f"s.{key}").alias(key), *(F.coalesce(filled(F.col(f"p.{f}")), F.col(f"s.{f}")).alias(f) for f in kept), *(F.when(here, F.col(f"p.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in latest))


def carried_forward(fresh: DataFrame, before: DataFrame, keys: list[str], fields: list[str], empty: str, flag: str) -> DataFrame:
    """Fresh rows whose `empty` field has nothing take all fields of the earlier row of the same keys, if that has the flag."""
    old = before.filter(flag).select(*keys, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("__old"))
    take = F.coalesce("__old", F.lit(False)) & filled(F.col(empty)).isNull()
    return fresh.join(old, keys, "left").select(*keys, *(F.when(take, F.col(f"__{f}")).otherwise(F.col(f)).alias(f) for f in fields))


def best_of_passes(results: DataFrame, key: str, order: str) -> DataFrame:
    """The best result of each key: one with a document, else one that says there is none, else one with a revision, else any; the
    earliest of its rank. The second document is kept from whichever pass had it first."""
    rank = F.when(filled(F.col("path")).isNotNull(), 3).when(F.coalesce("none", F.lit(False)), 2).when(F.col("rev").isNotNull(), 1).otherwise(0)
    return results.groupBy(key).agg(F.max_by(F.struct("path", "none", "rev"), F.struct(rank.alias("rank"), (-F.col(order)).alias("o"))).alias("r"), F.min_by("second", F.when(filled(F.col("second")).isNotNull(), F.col(order))).alias("second")).select(key, "r.*", "second")


def guarded_state(mine: DataFrame, disk: DataFrame, key: str, stamp: str, fields: list[str]) -> DataFrame:
    """My state, in which what the stored one has invalidated (a stamp, unless mine was verified at that time or later) is cleared."""
    other = disk.select(key, F.col(stamp).alias("__at"))
    joined = mine.join(other, key, "left")
    at = F.greatest(F.coalesce("__at", F.lit("")), F.coalesce(stamp, F.lit("")))
    void = (at != "") & ~(F.coalesce("verified_at", F.lit("")) >= at)
    return joined.withColumns({stamp: F.when(void, at), **{f: F.when(~void, F.col(f)) for f in fields}}).drop("__at")


def wrapped_history(lines: DataFrame, doc: str, pos: str, line: str, end: str) -> DataFrame:
    """doc, history: change orders with the lines that they wrap onto, up to the next one or an end line."""
    text = F.trim(F.coalesce(F.col(line), F.lit("")))
    starts, ends = text.rlike(CHANGE_ORDER), text.rlike(end)
    own = W.partitionBy(doc).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    event = F.when(starts, F.struct(F.col(pos).alias("at"))).when(ends, F.struct(F.lit(None).cast("int").alias("at")))
    rows = lines.withColumn("__at", F.last(event, ignorenulls=True).over(own)["at"]).filter("__at is not null").withColumn("__t", text).filter("__t <> ''")
    notes = rows.groupBy(doc, "__at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "__t"))), lambda x: x["__t"]), " ").alias("note"))
    return notes.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "note"))), lambda x: x["note"]).alias("history"))


def board_positions(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """rows with their position (from 1) in the board's order, null where the board does not have them."""
    return rows.join(order.select(key, F.col("position")), key, "left").orderBy(F.col("position").asc_nulls_last(), key)


def group_starts(rows: DataFrame, group: str, pos: str) -> DataFrame:
    return rows.withColumn("group_start", F.col(pos) == F.min(pos).over(W.partitionBy(group)))


def typed_order(col: str, ascending: bool = True) -> list[Column]:
    """Numbers by value, then other texts, blanks last either way."""
    text = F.trim(F.coalesce(F.col(col).cast("string"), F.lit("")))
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))
    way = (lambda c: c.asc_nulls_last()) if ascending else (lambda c: c.desc_nulls_last())
    return [(text == "").asc(), number.isNull().asc(), way(number), way(text)]


def rarest_first(shared: DataFrame, counts: DataFrame, key: str, feature: str) -> DataFrame:
    """key, features: those shared, the rarest (by the counts' df) first, then by name."""
    both = shared.join(counts.select(feature, "df"), feature)
    return both.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", feature))), lambda x: x[feature]).alias("features"))


def within_limit(rows: DataFrame, most: int) -> DataFrame:
    """All rows if there are at most `most`, else none: wide matrices are made for narrow choices only."""
    n = rows.limit(most + 1).count()
    return rows if n <= most else rows.limit(0)


def review_metrics(items: DataFrame, job: str, flags: str) -> DataFrame:
    """One row: items that need review, jobs that have any, and flags."""
    each = items.groupBy(job).agg(F.count_if(F.size(flags) > 0).alias("rows"), F.sum(F.greatest(F.size(flags), F.lit(0))).alias("flags"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(total("rows").alias("flagged_items"), F.count_if(F.col("rows") > 0).alias("jobs_with_review"), total("flags").alias("parser_flags"))


def commonest(rows: DataFrame, value: str, most: int = 20) -> DataFrame:
    """value, n: the commonest values, of equally common ones the lesser."""
    return rows.filter(F.col(value) != "").groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(most)


def all_names(rows: DataFrame, key: str, names: str) -> DataFrame:
    """The union of all names that were ever attached to a key, sorted."""
    return rows.select(key, F.explode(names).alias("__name")).groupBy(key).agg(F.array_sort(F.collect_set("__name")).alias(names))


def updated_master(master: DataFrame, board: DataFrame, key: str, fields: list[str], now: Column) -> DataFrame:
    """The master (key, fields, added, left, last_in, last_out, on_queue, history) after a poll of the board (key, fields).

    New rows are added; `added` never moves; `left` is set on departure and cleared on return; `last_in` and `last_out` are the
    last times of either; history gets an entry for each passage, unless its last entry is the same. A null field of the board is
    not known and keeps what is stored."""
    m, b = master.alias("m"), board.alias("b")
    both = m.join(b, F.col(f"m.{key}") == F.col(f"b.{key}"), "full_outer")
    here, known = F.col(f"b.{key}").isNotNull(), F.col(f"m.{key}").isNotNull()
    was = F.coalesce("m.on_queue", F.lit(False))
    came, went = here & ~was, ~here & was
    entry = lambda event: F.array(F.struct(F.lit(event).alias("event"), now.alias("time")))
    last = F.element_at("m.history", -1)
    repeat = lambda event: F.coalesce((last["event"] == event) & (last["time"] == now), F.lit(False))
    history = F.when(~known, entry("in")).when(came & ~repeat("in"), F.concat("m.history", entry("in"))).when(went & ~repeat("out"), F.concat("m.history", entry("out"))).otherwise(F.col("m.history"))
    return both.select(
        F.coalesce(f"b.{key}", f"m.{key}").alias(key),
        *(F.coalesce(f"b.{f}", f"m.{f}").alias(f) for f in fields),
        F.coalesce("m.added", now).alias("added"),
        F.when(~here, F.when(went, F.coalesce("m.left", now)).otherwise(F.col("m.left"))).alias("left"),
        F.when(came, now).otherwise(F.col("m.last_in")).alias("last_in"),
        F.when(went, now).otherwise(F.col("m.last_out")).alias("last_out"),
        here.alias("on_queue"),
        history.alias("history"),
    )
