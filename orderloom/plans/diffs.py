"""Queries on snapshot differences and keyed merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.operators import diff, merge
from orderloom.plans.board import D0, D1, D2, FIELDS, board, board_sql
from orderloom.sources import sinks
from orderloom.sources.steps import stored
from orderloom.sources.tables import latest_day, table

B0, B1, B2 = map(board_sql, (D0, D1, D2))
CORE = ["job", "customer", "status", "priority", "price"]
CORE_SQL = ", ".join(CORE)


def boards(spark, sf):
    return tuple(board(spark, sf, d) for d in (D0, D1, D2))


def diff_new(spark, sf):
    _, b1, b2 = boards(spark, sf)
    return diff.added(b2, b1, "job").select(*CORE, "due_lines", "due_value", "first_ship")


def diff_removed(spark, sf):
    _, b1, b2 = boards(spark, sf)
    return diff.removed(b2, b1, "job").select(CORE)


def diff_returning(spark, sf):
    b0, b1, b2 = boards(spark, sf)
    return diff.returning(b2, b1, b0.withColumn("day", F.lit(D0)), "job", "day").select(*CORE, "last_seen")


def diff_changed(spark, sf):
    _, b1, b2 = boards(spark, sf)
    return diff.changed_fields(b2, b1, "job", ["status", "priority", "due_lines", "first_ship"])


def changed_sql(extra: str = "") -> str:
    fields = ["status", "priority", "due_lines", "first_ship"]
    return " UNION ALL ".join(f"SELECT a.job, '{f}' AS field, trim(coalesce(CAST(b.{f} AS VARCHAR), '')) AS old, trim(coalesce(CAST(a.{f} AS VARCHAR), '')) AS new FROM {B2} a JOIN {B1} b USING (job) WHERE trim(coalesce(CAST(b.{f} AS VARCHAR), '')) <> trim(coalesce(CAST(a.{f} AS VARCHAR), '')){extra}" for f in fields)


def diff_co_changed(spark, sf):
    _, b1, b2 = boards(spark, sf)
    return diff.raised(b2, b1, "job", "co_number")


DAYS = ["1998-06-01", "1998-06-02", "1998-06-04", "1998-06-05", "1998-06-09", "1998-06-15"]


def persistence(spark, sf):
    """Streaks over six snapshots; the presence of all days comes from one pass over the lines."""
    day = F.explode(F.array(*(F.lit(d).cast("date") for d in DAYS)))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_shipdate").cast("date").alias("ship")).filter(F.col("ship").between(DAYS[0], "1998-07-20"))
    present = lines.withColumn("day", day).filter("ship > day and ship <= date_add(day, 30)")
    return diff.persistence(present, "job", "day", 3)


PERSISTENCE = f"""
WITH days AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS back FROM (SELECT unnest([{', '.join(f"DATE '{d}'" for d in DAYS)}]) AS d)),
p AS (SELECT DISTINCT l_orderkey AS job, back FROM lineitem, days WHERE CAST(l_shipdate AS DATE) > d AND CAST(l_shipdate AS DATE) <= d + INTERVAL 30 DAY),
s AS (SELECT job, back, row_number() OVER (PARTITION BY job ORDER BY back) AS n FROM p)
SELECT job, count(*) AS days FROM s WHERE back = n GROUP BY job HAVING count(*) >= 3"""


def latest_snapshot(spark, sf):
    return latest_day(table(spark, sf, "events").select("ts"), "2024-01-20", 14, "ts").select(F.col("ts").alias("day"))


def new_today(spark, sf):
    b0, b1, b2 = boards(spark, sf)
    return diff.new_today(b2, b0, diff.added(b2, b1, "job"), "job").select("job", "due_lines")


def queue_state(spark, sf):
    """The state after the baseline poll at D1, given as of D0."""
    b0, b1, _ = boards(spark, sf)
    first = merge.record_poll(b0.select("job", "status", "due_lines").limit(0).withColumns({"first_seen": F.lit(None).cast("string"), "last_seen": F.lit(None).cast("string"), "present": F.lit(None).cast("boolean"), "carried_over": F.lit(None).cast("boolean")}), b0.select("job", "status", "due_lines"), "job", ["status", "due_lines"], F.lit(D0), baseline=True)
    return merge.record_poll(first.drop("delta"), b1.select("job", "status", "due_lines"), "job", ["status", "due_lines"], F.lit(D1)).drop("delta")


def record_poll(spark, sf):
    b2 = board(spark, sf, D2)
    return merge.record_poll(queue_state(spark, sf), b2.select("job", "status", "due_lines"), "job", ["status", "due_lines"], F.lit(D2))


RECORD_POLL = f"""
WITH b0 AS {B0}, b1 AS {B1}, b2 AS {B2}, k AS (SELECT job FROM b0 UNION SELECT job FROM b1 UNION SELECT job FROM b2)
SELECT k.job, coalesce(b2.status, b1.status, b0.status) AS status, coalesce(b2.due_lines, b1.due_lines, b0.due_lines) AS due_lines,
  CASE WHEN b0.job IS NOT NULL THEN '{D0}' WHEN b1.job IS NOT NULL THEN '{D1}' ELSE '{D2}' END AS first_seen,
  CASE WHEN b2.job IS NOT NULL THEN '{D2}' WHEN b1.job IS NOT NULL THEN '{D1}' ELSE '{D0}' END AS last_seen,
  b2.job IS NOT NULL AS present, b0.job IS NOT NULL AS carried_over,
  CASE WHEN b2.job IS NOT NULL AND b0.job IS NULL AND b1.job IS NULL THEN 'new' WHEN b2.job IS NOT NULL AND b1.job IS NULL THEN 'returning' WHEN b2.job IS NULL AND b1.job IS NOT NULL THEN 'removed' END AS delta
FROM k LEFT JOIN b0 USING (job) LEFT JOIN b1 USING (job) LEFT JOIN b2 USING (job)"""


def merge_freshest(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    main = d.filter("doc_id % 3 <> 0")
    over = d.filter("doc_id % 2 = 0").withColumn("n_chars", F.col("n_chars") + F.col("doc_id") % 5 - 2).withColumn("source", F.lit("overlay"))
    return merge.overlay(main, over, "doc_id", "n_chars")


MERGE_FRESHEST = """
WITH m AS (SELECT doc_id, source, n_chars, 1 AS main FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'overlay', n_chars + doc_id % 5 - 2, 0 FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, source, n_chars FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_chars DESC, main DESC) = 1"""


def halves(spark, sf):
    d = table(spark, sf, "documents")
    a = d.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).otherwise("").alias("source"))
    b = d.filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 6 > 0, F.upper("lang")).otherwise(" ").alias("lang"), F.upper("source").alias("source"))
    return a, b


HALVES = """a AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN lang END AS lang, CASE WHEN doc_id % 5 > 0 THEN source ELSE '' END AS source FROM documents WHERE doc_id % 3 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN upper(lang) ELSE ' ' END AS lang, upper(source) AS source FROM documents WHERE doc_id % 2 = 0)"""


def merge_nonempty(spark, sf):
    return merge.merge_filled(*halves(spark, sf), "doc_id", ["lang", "source"])


def merge_sparse(spark, sf):
    a, b = halves(spark, sf)
    named = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("lang"))).otherwise(F.array(F.lit("lang"), F.lit("source")))
    return merge.merge_sparse(a, b.withColumn("present_fields", named), "doc_id", ["lang", "source"])


def merge_last_writer(spark, sf):
    a, b = halves(spark, sf)
    return merge.last_writer(a.withColumn("stamp", F.col("doc_id") % 7), b.withColumn("stamp", F.col("doc_id") % 5), "doc_id", "stamp", ["lang", "source"])


def merge_three_way(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", "lang")
    mine = base.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise(F.col("lang")))
    theirs = base.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("!"))).otherwise(F.col("lang")))
    return merge.three_way(base, mine, theirs, "doc_id", "lang")


def merge_keep_better(spark, sf):
    _, b1, b2 = boards(spark, sf)
    cur = b1.select("job", "co_number", F.when(F.col("job") % 3 > 0, "a.pdf").alias("source"), "due_lines")
    new = b2.select("job", (F.col("co_number") - F.col("job") % 2).alias("co_number"), F.when(F.col("job") % 4 > 1, "b.pdf").alias("source"), "due_lines")
    return merge.keep_better(cur, new, "job", "co_number", "source", ["due_lines"])


KEEP_BETTER = f"""
WITH c AS (SELECT job, co_number, CASE WHEN job % 3 > 0 THEN 'a.pdf' END AS source, due_lines FROM {B1}), i AS (SELECT job, co_number - job % 2 AS co_number, CASE WHEN job % 4 > 1 THEN 'b.pdf' END AS source, due_lines FROM {B2}),
j AS (SELECT coalesce(i.job, c.job) AS job, i.job AS ij, c.co_number AS c1, i.co_number AS c2, c.source AS s1, i.source AS s2, c.due_lines AS d1, i.due_lines AS d2,
  i.job IS NULL OR coalesce(i.co_number < c.co_number OR (i.co_number = c.co_number AND i.source IS NULL AND c.source IS NOT NULL), false) AS keep FROM c FULL JOIN i ON c.job = i.job)
SELECT job, CASE WHEN keep THEN c1 ELSE c2 END AS co_number, CASE WHEN keep THEN s1 ELSE s2 END AS source, CASE WHEN keep THEN d1 ELSE d2 END AS due_lines, keep AND ij IS NOT NULL AS kept_current FROM j"""


def change_events(spark, sf):
    _, b1, b2 = boards(spark, sf)
    return merge.change_events(b1, b2, "job", ["status", "priority", "due_lines", "first_ship"])


def events_with_blanks(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("old"), F.when(F.col("event_id") % 3 == 0, "").otherwise("x").alias("new"))
    held = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("held"))
    return e, held


def phantom_scrub(spark, sf):
    e, held = events_with_blanks(spark, sf)
    return merge.without_phantoms(e, held, "user_id", "held").select("event_id", "user_id", "old", "new")


PHANTOMS = """
WITH e AS (SELECT event_id, user_id, event_type AS old, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'x' END AS new FROM events), h AS (SELECT user_id, arg_max(event_type, event_id) AS held FROM events GROUP BY 1)
SELECT event_id, user_id, old, new FROM e LEFT JOIN h USING (user_id) WHERE NOT (new = '' AND coalesce(held = old, false))"""


def master_union(spark, sf):
    _, _, b2 = boards(spark, sf)
    rest = table(spark, sf, "orders").filter("o_orderdate >= '1998-01-01' and o_orderdate < '1998-07-01'").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("customer"))
    return merge.insert_missing(b2.select("job", "customer", "due_lines"), rest, "job")


def note_merge(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("target"), F.col("text").alias("note"), "turn")
    old = c.filter("turn = 0 and target % 3 = 0").select("target", "note").dropDuplicates().withColumn("id", F.col("target"))
    return merge.added_notes(old, c.filter("turn = 0 and target % 2 = 0").select("target", "note"), ["target", "note"], "id")


NOTES = """
WITH o AS (SELECT DISTINCT conv_id AS target, text AS note, conv_id AS id FROM conversations WHERE turn = 0 AND conv_id % 3 = 0), f AS (SELECT DISTINCT conv_id AS target, text AS note FROM conversations WHERE turn = 0 AND conv_id % 2 = 0 AND (conv_id, text) NOT IN (SELECT (target, note) FROM o))
SELECT * FROM o UNION ALL SELECT target, note, row_number() OVER (ORDER BY target, note) + (SELECT coalesce(max(id), 0) FROM o) FROM f"""


def history_advance(spark, sf):
    b0, b1, b2 = (stored(b.select("job"), "history-day") for b in boards(spark, sf))
    start = diff.removed(b1, b0, "job").select("job", F.lit(D1).alias("left"))
    gone = diff.removed(b2, b1, "job").select("job", F.lit(D2).alias("left"))
    once = merge.history_advance(start, diff.added(b2, b1, "job"), gone, "job")
    return merge.history_advance(once, diff.added(b2, b1, "job"), gone, "job")


HISTORY = f"""
WITH b0 AS {B0}, b1 AS {B1}, b2 AS {B2}
SELECT job, '{D1}' AS "left" FROM b0 WHERE job NOT IN (SELECT job FROM b1) AND job NOT IN (SELECT job FROM b2)
UNION ALL SELECT job, '{D2}' FROM b1 WHERE job NOT IN (SELECT job FROM b2)"""


def upsert_plan(spark, sf):
    _, b1, b2 = boards(spark, sf)
    return sinks.upsert_plan(b1, b2, "job", ["status", "priority", "due_lines", "first_ship"])


UPSERT = f"""
SELECT coalesce(a.job, b.job) AS job, CASE WHEN b.job IS NULL THEN 'append' WHEN a.job IS NULL THEN 'delete' ELSE 'update' END AS op FROM {B2} a FULL JOIN {B1} b ON a.job = b.job
WHERE a.job IS NULL OR b.job IS NULL OR (a.status, a.priority, a.due_lines, a.first_ship) IS DISTINCT FROM (b.status, b.priority, b.due_lines, b.first_ship)"""


def clear_invalidated(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return merge.cleared(d, (F.col("doc_id") % 7 == 0) & (F.col("n_chars") > 500), ["lang", "source"])


QUERIES = {
    "diff_new": (diff_new, f"SELECT {CORE_SQL}, due_lines, due_value, first_ship FROM {B2} WHERE job NOT IN (SELECT job FROM {B1})"),
    "diff_removed": (diff_removed, f"SELECT {CORE_SQL} FROM {B1} WHERE job NOT IN (SELECT job FROM {B2})"),
    "diff_returning": (diff_returning, f"SELECT {CORE_SQL}, '{D0}' AS last_seen FROM {B2} WHERE job NOT IN (SELECT job FROM {B1}) AND job IN (SELECT job FROM {B0})"),
    "diff_changed": (diff_changed, changed_sql()),
    "diff_co_changed": (diff_co_changed, f"SELECT a.job, b.co_number AS old_number, a.co_number AS new_number FROM {B2} a JOIN {B1} b USING (job) WHERE a.co_number > b.co_number"),
    "persistence": (persistence, PERSISTENCE),
    "latest_snapshot": (latest_snapshot, "SELECT max(CAST(ts AS DATE)) AS day FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-20' AND CAST(ts AS DATE) >= DATE '2024-01-06' HAVING max(ts) IS NOT NULL"),
    "new_today": (new_today, f"SELECT job, due_lines FROM {B2} WHERE job NOT IN (SELECT job FROM {B0}) OR job NOT IN (SELECT job FROM {B1})"),
    "record_poll": (record_poll, RECORD_POLL),
    "merge_freshest": (merge_freshest, MERGE_FRESHEST),
    "merge_nonempty": (merge_nonempty, f"WITH {HALVES} SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(CASE WHEN trim(b.lang) <> '' THEN b.lang END, a.lang) AS lang, coalesce(CASE WHEN trim(b.source) <> '' THEN b.source END, a.source) AS source FROM a FULL JOIN b ON a.doc_id = b.doc_id"),
    "merge_sparse": (merge_sparse, f"WITH {HALVES} SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NOT NULL THEN b.lang ELSE a.lang END AS lang, CASE WHEN b.doc_id IS NOT NULL AND b.doc_id % 4 <> 0 THEN b.source ELSE a.source END AS source FROM a FULL JOIN b ON a.doc_id = b.doc_id"),
    "merge_last_writer": (merge_last_writer, f"WITH {HALVES}, u AS (SELECT doc_id, doc_id % 7 AS stamp, lang, source, 0 AS side FROM a UNION ALL SELECT doc_id, doc_id % 5, lang, source, 1 FROM b) SELECT doc_id, stamp, lang, source FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY stamp DESC, side DESC) = 1"),
    "merge_three_way": (merge_three_way, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) WHEN doc_id % 2 = 0 THEN lang || '!' ELSE lang END AS lang FROM documents"),
    "merge_keep_better": (merge_keep_better, KEEP_BETTER),
    "change_events": (change_events, f"SELECT * FROM ({changed_sql()}) WHERE old <> ''"),
    "phantom_scrub": (phantom_scrub, PHANTOMS),
    "master_union": (master_union, f"WITH b AS {B2} SELECT job, customer, due_lines FROM b UNION ALL SELECT o_orderkey, o_custkey, NULL FROM orders WHERE o_orderdate >= '1998-01-01' AND o_orderdate < '1998-07-01' AND o_orderkey NOT IN (SELECT job FROM b)"),
    "note_merge": (note_merge, NOTES),
    "history_advance": (history_advance, HISTORY),
    "upsert_plan": (upsert_plan, UPSERT),
    "clear_invalidated": (clear_invalidated, "SELECT doc_id, CASE WHEN NOT (doc_id % 7 = 0 AND n_chars > 500) THEN lang END AS lang, CASE WHEN NOT (doc_id % 7 = 0 AND n_chars > 500) THEN source END AS source, n_chars FROM documents"),
}
