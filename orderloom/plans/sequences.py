"""Queries on ordered folds, roll-ups and matrices, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.operators import rollups, sequences
from orderloom.plans.board import D2, board, board_sql
from orderloom.sources import sinks
from orderloom.sources.tables import table

B2 = board_sql(D2)


def lines(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey"))


LINES = "(SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"


def dedupe_transitions(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return sequences.transitions(e, ["user_id"], "event_id", ["event_type"])


def in_out_history(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("bucket"))
    last = e.agg(F.max("bucket")).first()[0]
    return sequences.in_out(e, "user_id", "bucket", 0, last)


IN_OUT = """
WITH e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket FROM events), w AS (SELECT *, lag(bucket) OVER o AS p, lead(bucket) OVER o AS n FROM e WINDOW o AS (PARTITION BY user_id ORDER BY bucket))
SELECT user_id, bucket, 'in' AS event FROM w WHERE p IS NULL OR p < bucket - 1 UNION ALL SELECT user_id, bucket + 1, 'out' FROM w WHERE (n IS NULL OR n > bucket + 1) AND bucket < (SELECT max(bucket) FROM e)"""


def rank_runs(spark, sf):
    order = [F.desc("p_size"), F.desc("l_quantity"), F.desc("l_shipdate"), F.desc("l_extendedprice"), F.asc("l_linenumber")]
    return sequences.ranked(lines(spark, sf).select("l_orderkey", "l_linenumber", "p_size", "l_quantity", "l_shipdate", "l_extendedprice"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "rank")


def dedupe_runs(spark, sf):
    order = [F.desc("p_size"), F.desc("l_quantity"), F.desc("l_shipdate"), F.asc("l_linenumber")]
    return sequences.first_of_each(lines(spark, sf).select("l_orderkey", "p_type", "l_linenumber", "p_size", "l_quantity", "l_shipdate"), ["l_orderkey", "p_type"], order).select("l_orderkey", "p_type", "l_linenumber")


def row_keys(spark, sf):
    return sequences.row_keys(lines(spark, sf).select("l_orderkey", "l_linenumber", "p_type"), "l_orderkey", "p_type", [F.asc("l_linenumber")])


def recent_duplicate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return sequences.recent_duplicates(d, "doc_id", "digest", 25).select("doc_id", "earlier")


def miss_streak(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return sequences.miss_streaks(e, ["user_id"], "event_id", F.col("value") < 50, 3)


MISS = """
WITH r AS (SELECT event_id, user_id, value, sum(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
s AS (SELECT *, CAST(sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS BIGINT) AS streak FROM r)
SELECT event_id, user_id, value, streak, streak > 0 AND streak % 3 = 0 AS probe FROM s"""


def section_carry(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return sequences.carried(e, ["user_id"], "event_id", F.col("event_id") % 5 == 0, F.col("event_id") % 7 == 0, F.col("event_type"), "section")


SECTION = """
WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN {'o': true, 'v': event_type} WHEN event_id % 7 = 0 THEN {'o': false, 'v': NULL} END AS ev FROM events),
l AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last FROM e)
SELECT event_id, user_id, event_type, CASE WHEN last.o THEN last.v END AS section FROM l"""


def orders_changed(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("value").alias("v"))
    return sequences.first_and_last(e, ["user_id", "event_type"], "event_id", "v", "v")


def baseline_flood(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return sequences.baseline_flood(e, "day", 8)


def co_note(spark, sf):
    """For each order, the note of change 3: that of line 3, else of the closest before, else of the nearest after."""
    notes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_linenumber") * 2).alias("number"), F.col("l_returnflag").alias("text"))).alias("notes"))
    return notes.select("l_orderkey", sequences.closest_preceding(F.col("notes"), F.lit(3)).alias("note"))


def tag_counts(spark, sf):
    words = table(spark, sf, "part").select("p_partkey", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("tags"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), "l_partkey").join(words, F.col("l_partkey") == F.col("p_partkey"))
    return rollups.tag_counts(items, "job", "tags")


def audit_untagged(spark, sf):
    items = lines(spark, sf).filter("p_size < 5").select(F.col("l_orderkey").alias("job"), F.upper("p_brand").alias("norm"))
    return rollups.audit(items, ["norm"], "job", 5)


def inquiry_counts(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").alias("inquiry")).filter("inquiry is not null")
    return rollups.mentions(e, ["inquiry"], "user_id")


def corpus_quality(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rollups.rates(rows, "lang", {"labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "short": F.col("n_chars") < 200, "odd_length": F.length("text") != F.col("n_chars")})


QUALITY = "SELECT lang, count(*) AS n, " + ", ".join(f"count(*) FILTER ({c}) AS {k}, round(count(*) FILTER ({c}) / CAST(count(*) AS DOUBLE), 4) AS {k}_rate" for k, c in {"labelled": "quality IS NOT NULL", "good": "quality = 1", "toxic": "toxic = 1", "short": "n_chars < 200", "odd_length": "length(text) <> n_chars"}.items()) + " FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"


def corpus_audit(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.length("text").alias("stored"))
    return rollups.set_audit(d.select("doc_id", "n_chars"), table(spark, sf, "labels").filter("doc_id % 10 > 0").select("doc_id"), "doc_id")


def queue_total(spark, sf):
    return rollups.totals(board(spark, sf, D2), "price", ["status"])


def component_rollup(spark, sf):
    return rollups.components(lines(spark, sf), ["l_orderkey", "p_type"], "l_extendedprice", "p_name", "l_linenumber", "p_brand")


COMPONENT = f"""
SELECT l_orderkey, p_type, arg_max(p_name, (l_extendedprice, -l_linenumber)) AS "primary", round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, count(*) AS members,
  string_agg(DISTINCT p_brand, ' | ' ORDER BY p_brand) AS attribute, count(DISTINCT p_brand) > 1 AS review FROM {LINES} GROUP BY 1, 2"""


def run_status(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def max_fields(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count_distinct("event_type").alias("fields"))
    return e.groupBy("user_id").agg(F.max("fields").alias("columns"))


def metrics_delta(spark, sf):
    d = table(spark, sf, "documents")
    before, after = (x.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")) for x in (d.filter("doc_id % 2 = 0"), d.filter("doc_id % 5 > 0")))
    return rollups.delta(before, after, "lang", ["n", "chars"])


def next_transmittal(spark, sf):
    return rollups.next_number(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


def feature_matrix(spark, sf):
    rows = lines(spark, sf).select(F.col("l_orderkey").alias("job"), "p_type")
    return rollups.matrix(rows, "job", "p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])


FEATURES = "SELECT l_orderkey AS job, " + ", ".join(f"max(CASE WHEN p_type = '{t}' THEN '✓' END) AS {t}" for t in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]) + f" FROM {LINES} GROUP BY 1"


def change_columns(spark, sf):
    """All that happened to each user on each day, numbered."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("date").alias("day"), "event_id", "event_type")
    return rollups.numbered_values(e, ["user_id", "day"], "event_id", "event_type")


def shard_manifest(spark, sf):
    return sinks.shard_manifest(table(spark, sf, "orders"), "o_orderkey", 1000)


def archive_sweep(spark, sf):
    return sinks.archive_split(table(spark, sf, "events").select("event_id", "ts"), "ts", "2024-03-10", 60).select("event_id", "archived")


def obsolete_files(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return sinks.obsolete(rows, "l_orderkey", [F.desc("l_quantity"), F.desc("l_shipdate"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "rank")


def full_backlog(spark, sf):
    return rollups.full_outer_flags(table(spark, sf, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("job")), table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("job")).distinct(), "job", "recorded", "drawn")


QUERIES = {
    "dedupe_transitions": (dedupe_transitions, "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1 OR p IS DISTINCT FROM event_type"),
    "in_out_history": (in_out_history, IN_OUT),
    "rank_runs": (rank_runs, f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_size DESC, l_quantity DESC, l_shipdate DESC, l_extendedprice DESC, l_linenumber) AS rank FROM {LINES}"),
    "dedupe_runs": (dedupe_runs, f"SELECT l_orderkey, p_type, l_linenumber FROM {LINES} QUALIFY row_number() OVER (PARTITION BY l_orderkey, p_type ORDER BY p_size DESC, l_quantity DESC, l_shipdate DESC, l_linenumber) = 1"),
    "row_keys": (row_keys, f"SELECT l_orderkey, l_linenumber, p_type, CASE WHEN n = 1 THEN p_type ELSE p_type || '|' || n END AS row_key FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, p_type ORDER BY l_linenumber) AS n FROM {LINES})"),
    "recent_duplicate": (recent_duplicate, "WITH p AS (SELECT doc_id, md5(text) AS m, row_number() OVER (ORDER BY doc_id) AS n FROM documents) SELECT doc_id, earlier FROM (SELECT doc_id, n, lag(doc_id) OVER w AS earlier, lag(n) OVER w AS before FROM p WINDOW w AS (PARTITION BY m ORDER BY n)) WHERE n - before <= 25"),
    "miss_streak": (miss_streak, MISS),
    "section_carry": (section_carry, SECTION),
    "orders_changed": (orders_changed, "SELECT user_id, event_type, arg_min(value, event_id) AS first_old, arg_max(value, event_id) AS last_new, count(*) AS steps FROM events GROUP BY 1, 2"),
    "baseline_flood": (baseline_flood, "WITH f AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 LIMIT 1) SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT day FROM f WHERE n >= 8)"),
    "co_note": (co_note, "SELECT l_orderkey, coalesce(arg_max(l_returnflag, (l_linenumber, l_returnflag)) FILTER (l_linenumber * 2 <= 3), arg_min(l_returnflag, (l_linenumber, l_returnflag)) FILTER (l_linenumber * 2 > 3)) AS note FROM lineitem GROUP BY 1"),
    "tag_counts": (tag_counts, "SELECT tag, count(DISTINCT l_orderkey) AS jobs, count(*) AS items FROM (SELECT l_orderkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS tag FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1"),
    "audit_untagged": (audit_untagged, f"SELECT norm, count(*) AS items, array_to_string(list_sort(list(DISTINCT job))[1:5], ',') AS jobs FROM (SELECT l_orderkey AS job, upper(p_brand) AS norm FROM {LINES} WHERE p_size < 5) GROUP BY 1"),
    "inquiry_counts": (inquiry_counts, "WITH e AS (SELECT user_id, json_extract_string(props, '$.k') AS inquiry FROM events) SELECT inquiry, 'job' AS level, user_id, count(*) AS n FROM e WHERE inquiry IS NOT NULL GROUP BY inquiry, user_id UNION ALL SELECT inquiry, 'total', NULL, count(*) FROM e WHERE inquiry IS NOT NULL GROUP BY inquiry"),
    "corpus_quality": (corpus_quality, QUALITY),
    "corpus_audit": (corpus_audit, "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS finding FROM documents a FULL JOIN (SELECT doc_id FROM labels WHERE doc_id % 10 > 0) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL"),
    "queue_total": (queue_total, f"SELECT status, count(*) AS n, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {B2} GROUP BY ROLLUP (status)"),
    "component_rollup": (component_rollup, COMPONENT),
    "run_status": (run_status, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "max_fields": (max_fields, "SELECT user_id, max(f) AS columns FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS f FROM events GROUP BY 1, 2) GROUP BY 1"),
    "metrics_delta": (metrics_delta, "SELECT lang, coalesce(a.n, 0) - coalesce(b.n, 0) AS n, CAST(coalesce(a.chars, 0) - coalesce(b.chars, 0) AS BIGINT) AS chars FROM (SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE doc_id % 5 > 0 GROUP BY 1) a FULL JOIN (SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) b USING (lang)"),
    "next_transmittal": (next_transmittal, "SELECT l_orderkey, lpad(CAST(max(l_linenumber) + 1 AS VARCHAR), 2, '0') AS next FROM lineitem GROUP BY 1"),
    "feature_matrix": (feature_matrix, FEATURES),
    "change_columns": (change_columns, "SELECT user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS field, event_type FROM events"),
    "shard_manifest": (shard_manifest, "SELECT o_orderkey // 1000 * 1000 AS low, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last, o_orderkey // 1000 * 1000 + 999 AS high FROM orders GROUP BY 1, 5"),
    "archive_sweep": (archive_sweep, "SELECT event_id, CAST(ts AS DATE) < DATE '2024-03-10' - 60 AS archived FROM events"),
    "obsolete_files": (obsolete_files, "SELECT l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_shipdate DESC, l_linenumber) AS rank FROM lineitem) WHERE rank > 1"),
    "full_backlog": (full_backlog, "SELECT coalesce(a.job, b.job) AS job, a.job IS NOT NULL AS recorded, b.job IS NOT NULL AS drawn FROM (SELECT o_orderkey AS job FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT DISTINCT l_orderkey AS job FROM lineitem WHERE l_quantity > 45) b ON a.job = b.job"),
}
