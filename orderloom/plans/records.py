"""Queries on records put together from several stores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.operators import records
from orderloom.plans.board import D0, D1, D2, board, board_sql
from orderloom.plans.labels import EXTRAS, LINES, extras, lines_of_orders
from orderloom.sources.tables import table

B0, B1, B2 = map(board_sql, (D0, D1, D2))


def key():
    return F.col("o_orderkey")


def orders(spark, sf):
    return table(spark, sf, "orders")


def attached_drawings(spark, sf):
    scan = extras(spark, sf).withColumnRenamed("l_orderkey", "o_orderkey").withColumn("folder", F.concat(F.lit("/dwg/"), key().cast("string")))
    return records.with_drawings(orders(spark, sf).select("o_orderkey"), scan, "o_orderkey").select("o_orderkey", F.size("extras").alias("drawings"), "folder", "scanned")


def cached_tags(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("norm"), F.when(F.col("p_size") > 10, F.array("p_type")).alias("tags"))
    cache = table(spark, sf, "part").groupBy(F.upper("p_name").alias("norm")).agg(F.max("p_brand").alias("b"), F.min("p_type").alias("t")).filter("t < 'N'").select("norm", F.array("t", "b", "t").alias("tags"))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, "l_partkey")
    return records.with_cached_tags(items, cache, "norm", "tags").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"))


CACHED = """
WITH c AS (SELECT upper(p_name) AS norm, array_to_string(list_sort([min(p_type), max(p_brand)]), ',') AS tags FROM part GROUP BY 1 HAVING min(p_type) < 'N')
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size > 10 THEN p_type ELSE coalesce(c.tags, '') END AS tags FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN c ON c.norm = upper(p_name)"""


def handled_marks(spark, sf):
    notes = orders(spark, sf).select("o_orderkey", F.when(key() % 4 == 0, "handled").otherwise("open").alias("status"), F.when(key() % 4 == 0, "before").otherwise("").alias("resolution"), F.when(key() % 4 == 0, "d0").alias("handled_at"))
    marks = orders(spark, sf).filter("o_orderstatus = 'F'").select("o_orderkey", F.when(key() % 3 > 0, F.col("o_orderpriority")).alias("resolution"), F.when(key() % 5 > 0, "d1").alias("handled_at"))
    return records.with_marks(notes, marks, "o_orderkey", F.lit("now"))


MARKS = """
SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 4 > 0 AS closed, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 4 = 0 THEN 'handled' ELSE 'open' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'before' WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END AS resolution,
  CASE WHEN o_orderkey % 4 = 0 THEN 'd0' WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 5 > 0 THEN 'd1' ELSE 'now' END END AS handled_at FROM orders"""


def explorer_records(spark, sf):
    """The line-item store, the queue and the master of all orders before a day, joined by order."""
    store = lines_of_orders(spark, sf).groupBy(F.col("l_orderkey").alias("job")).agg(F.min("flag").alias("status"), F.max("part").cast("string").alias("customer"))
    master = orders(spark, sf).filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).select(key().alias("job"), F.when(key() % 3 > 0, F.col("o_orderstatus")).otherwise(" ").alias("status"), F.when(key() % 2 == 0, F.col("o_custkey").cast("string")).alias("customer"))
    queue = board(spark, sf, D2).select("job", "status", F.lit("").alias("customer"))
    return records.explorer_records(store, queue, master, "job", ["status", "customer"])


EXPLORER = f"""
WITH s AS (SELECT l_orderkey AS job, min(flag) AS status, CAST(max(part) AS VARCHAR) AS customer FROM {LINES} GROUP BY 1),
m AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS customer FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), q AS (SELECT job, status FROM {B2})
SELECT job, coalesce(q.status, m.status, s.status) AS status, coalesce(m.customer, s.customer) AS customer, q.status IS NOT NULL AS on_board, job IN (SELECT job FROM m) AS in_master FROM s FULL JOIN q USING (job) FULL JOIN m USING (job)"""


def order_log(spark, sf):
    master = board(spark, sf, D1).select("job", F.lit(True).alias("on_queue"), F.lit(D0).alias("added"), F.lit(None).cast("string").alias("left"))
    store = orders(spark, sf).select(key().alias("job"), F.col("o_orderdate").cast("date").cast("string").alias("scanned_at"))
    return records.master_or_store(master, store, "job")


def realigned(spark, sf):
    current = board(spark, sf, D1).select("job", "status", F.col("due_lines").cast("string").alias("lines"), "first_ship")
    given = board(spark, sf, D2).select("job", F.when(F.col("job") % 3 > 0, F.lower("status")).alias("status"), F.col("due_lines").cast("string").alias("lines"), F.lit(None).cast("string").alias("first_ship"))
    return records.realigned(current, given, "job", ["status", "lines", "first_ship"])


REALIGNED = f"""
SELECT a.job, coalesce(CASE WHEN b.job % 3 > 0 THEN lower(b.status) END, a.status) AS status, CAST(coalesce(b.due_lines, a.due_lines) AS VARCHAR) AS lines, a.first_ship,
  coalesce((b.job % 3 > 0 AND lower(b.status) <> a.status) OR b.due_lines <> a.due_lines, false) AS changed FROM {B1} a LEFT JOIN {B2} b USING (job)"""


def folded_sources(spark, sf):
    """Drawings, then items, then a backfill that leaves alone what is on the board or was verified later."""
    master = orders(spark, sf).select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(key() % 5 == 0, F.col("o_orderpriority")).otherwise("").alias("note"), (key() % 4 == 0).alias("on_queue"), F.when(key() % 3 > 0, "1997-01-01").alias("verified_at"))
    drawn = extras(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("drawn "), F.size("extras").cast("string")).alias("note"))
    back = orders(spark, sf).select("o_orderkey", F.when(key() % 7 > 0, F.lower("o_orderstatus")).otherwise(" ").alias("status"), F.col("o_orderdate").cast("date").cast("string").alias("scanned_at"))
    guard = ~F.col("on_queue") & ~F.coalesce(F.col("verified_at") >= F.col("__scanned_at"), F.lit(False))
    out = records.folded(master, [("drawings", drawn, None), ("backfill", back, guard)], "o_orderkey", ["status", "note"])
    return out.select("o_orderkey", "status", "note", "n_drawings", "n_backfill")


FOLDED = f"""
WITH d AS (SELECT l_orderkey AS o_orderkey, 'drawn ' || count(*) AS note FROM {EXTRAS} GROUP BY 1),
x AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE '' END AS before, d.note, o_orderkey % 4 > 0 AND NOT (o_orderkey % 3 > 0 AND o_orderdate < TIMESTAMP '1997-01-02') AND o_orderkey % 7 > 0 AS take FROM orders LEFT JOIN d USING (o_orderkey))
SELECT o_orderkey, CASE WHEN take THEN lower(o_orderstatus) ELSE o_orderstatus END AS status, coalesce(note, before) AS note, note IS NOT NULL AND note <> before AS n_drawings, take AS n_backfill FROM x"""


def merge_counts(spark, sf):
    out = folded_sources(spark, sf)
    return out.agg(F.count_if("n_drawings").alias("drawings"), F.count_if("n_backfill").alias("backfill"))


def recorded_parses(spark, sf):
    store = orders(spark, sf).select(key().alias("job"), F.col("o_orderpriority").alias("customer"), F.when(key() % 2 == 0, "a.pdf").otherwise("").alias("pdf"), F.lit("old").alias("items"), F.lit("v1").alias("parser"))
    parsed = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.min(F.when(F.col("l_returnflag") != "A", "b.pdf").otherwise("")).alias("pdf"), F.count("*").cast("string").alias("items")).filter("items > 3").withColumns({"customer": F.when(F.col("job") % 3 == 0, "known"), "parser": F.lit("v2")})
    return records.recorded(store, parsed, "job", ["customer", "pdf"], ["items", "parser"])


RECORDED = """
WITH p AS (SELECT l_orderkey AS job, CASE WHEN bool_or(l_returnflag = 'A') THEN '' ELSE 'b.pdf' END AS pdf, CAST(count(*) AS VARCHAR) AS items FROM lineitem GROUP BY 1 HAVING count(*) > 3)
SELECT o_orderkey AS job, CASE WHEN items IS NOT NULL AND o_orderkey % 3 = 0 THEN 'known' ELSE o_orderpriority END AS customer, coalesce(nullif(p.pdf, ''), CASE WHEN o_orderkey % 2 = 0 THEN 'a.pdf' ELSE '' END) AS pdf, coalesce(items, 'old') AS items, CASE WHEN items IS NULL THEN 'v1' ELSE 'v2' END AS parser
FROM orders LEFT JOIN p ON p.job = o_orderkey"""


def carried_readings(spark, sf):
    """A re-scan that found nothing keeps what was read from the pages before."""
    l = lines_of_orders(spark, sf)
    fresh = l.select("l_orderkey", "l_linenumber", F.when(F.col("flag") == "N", F.col("q").cast("string")).otherwise("").alias("fields"), F.lit("new").alias("status"))
    before = l.select("l_orderkey", "l_linenumber", F.col("part").cast("string").alias("fields"), F.lit("read").alias("status"), (F.col("part") % 2 == 0).alias("vision"))
    return records.carried_forward(fresh, before, ["l_orderkey", "l_linenumber"], ["fields", "status"], "fields", "vision")


def best_results(spark, sf):
    """Lines of an order as fetch passes."""
    l = lines_of_orders(spark, sf)
    passes = l.select("l_orderkey", "l_linenumber", F.when(F.col("part") % 5 == 0, F.col("part").cast("string")).otherwise("").alias("path"), (F.col("flag") == "R").alias("none"), F.when(F.col("q") > 25, F.col("q")).alias("rev"), F.when(F.col("part") % 3 == 0, F.concat(F.lit("s"), F.col("part").cast("string"))).alias("second"))
    return records.best_of_passes(passes, "l_orderkey", "l_linenumber")


BEST = f"""
WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN part % 5 = 0 THEN CAST(part AS VARCHAR) ELSE '' END AS path, flag = 'R' AS none, CASE WHEN q > 25 THEN q END AS rev, CASE WHEN part % 3 = 0 THEN 's' || part END AS second FROM {LINES}),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY path = '', path = '' AND NOT none, path = '' AND NOT none AND rev IS NULL, l_linenumber) AS n FROM p),
s AS (SELECT l_orderkey, arg_min(second, l_linenumber) AS second FROM p WHERE second IS NOT NULL GROUP BY 1)
SELECT r.l_orderkey, path, none, rev, s.second FROM r LEFT JOIN s USING (l_orderkey) WHERE n = 1"""


def guarded_state(spark, sf):
    mine = orders(spark, sf).select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(key() % 6 == 0, "1996-05-05").alias("invalidated_at"), F.when(key() % 2 == 0, F.col("o_orderdate").cast("date").cast("string")).alias("verified_at"))
    disk = orders(spark, sf).filter("o_orderkey % 3 > 0").select("o_orderkey", F.when(key() % 5 == 0, "1998-01-01").alias("invalidated_at"))
    return records.guarded_state(mine, disk, "o_orderkey", "invalidated_at", ["status"])


GUARDED = """
WITH x AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS verified_at, greatest(CASE WHEN o_orderkey % 6 = 0 THEN '1996-05-05' ELSE '' END, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 = 0 THEN '1998-01-01' ELSE '' END) AS void FROM orders)
SELECT o_orderkey, CASE WHEN void = '' OR coalesce(verified_at, '') >= void THEN o_orderstatus END AS status, CASE WHEN void <> '' AND coalesce(verified_at, '') < void THEN void END AS invalidated_at, verified_at FROM x"""


def wrapped_history(spark, sf):
    """Events of a user as lines: purchases open a change order, logouts end the block."""
    e = table(spark, sf, "events")
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" CO# "), F.col("event_id").cast("string"))).when(F.col("event_id") % 7 == 0, "TOTAL").when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("event_type"))
    got = records.wrapped_history(e.select("user_id", "event_id", line.alias("line")), "user_id", "event_id", "line", "^TOTAL")
    return got.select("user_id", F.array_join("history", "\n").alias("history"))


WRAPPED = """
WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'CO# ' || event_id WHEN event_id % 7 = 0 THEN 'TOTAL' WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS line FROM events),
g AS (SELECT *, max(CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS opened FROM l),
n AS (SELECT user_id, opened, string_agg(line, ' ' ORDER BY event_id) AS note FROM g WHERE opened % 5 = 0 AND line <> '' GROUP BY 1, 2) SELECT user_id, string_agg(note, chr(10) ORDER BY opened) AS history FROM n GROUP BY 1"""


def board_positions(spark, sf):
    first = board(spark, sf, D1).select("job", (F.col("co_number") + 1).alias("position"))
    return records.board_positions(board(spark, sf, D2).select("job", "status"), first, "job")


def group_starts(spark, sf):
    return records.group_starts(lines_of_orders(spark, sf).filter("flag <> 'A'"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "group_start")


def typed_order(spark, sf):
    """The first 50 parts by a mixed column: numbers, texts, blanks."""
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise("").alias("value"))
    up, down = (p.orderBy(*records.typed_order("value", way), "p_partkey").limit(50).withColumn("way", F.lit(name)) for way, name in ((True, "up"), (False, "down")))
    return up.unionByName(down)


TYPED = """
WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_brand ELSE '' END AS value, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS n FROM part)
(SELECT p_partkey, value, 'up' AS way FROM p ORDER BY value = '', n NULLS LAST, value, p_partkey LIMIT 50) UNION ALL (SELECT p_partkey, value, 'down' AS way FROM p ORDER BY value = '', n DESC NULLS LAST, value DESC, p_partkey LIMIT 50)"""


def rarest_first(spark, sf):
    """Tags that an order shares with the one before it, the rarest first."""
    tags = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_brand").alias("tag")).distinct()
    shared = tags.join(tags.select((F.col("l_orderkey") + 1).alias("l_orderkey"), "tag"), ["l_orderkey", "tag"])
    got = records.rarest_first(shared, tags.groupBy("tag").agg(F.count("*").alias("df")), "l_orderkey", "tag")
    return got.select("l_orderkey", F.array_join("features", ",").alias("tags"))


RAREST = """
WITH t AS (SELECT DISTINCT l_orderkey, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey), d AS (SELECT tag, count(*) AS df FROM t GROUP BY 1)
SELECT a.l_orderkey, string_agg(a.tag, ',' ORDER BY df, a.tag) AS tags FROM t a JOIN t b ON b.l_orderkey = a.l_orderkey - 1 AND b.tag = a.tag JOIN d ON d.tag = a.tag GROUP BY 1"""


def history_matrix(spark, sf):
    """The matrix of one day's queue (few enough rows), and of all orders (too many, so empty)."""
    few = records.within_limit(board(spark, sf, D2).select("job").orderBy("job").limit(300), 300)
    many = records.within_limit(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job")), 300)
    return few.unionByName(many)


def review_metrics(spark, sf):
    flags = F.array_compact(F.array(F.when(F.col("flag") == "R", "returned"), F.when(F.col("q") > 40, "many"), F.when(F.col("part") % 9 == 0, "odd")))
    return records.review_metrics(lines_of_orders(spark, sf).withColumn("flags", flags), "l_orderkey", "flags")


REVIEW = f"""
WITH f AS (SELECT l_orderkey, (flag = 'R')::INT + (q > 40)::INT + (part % 9 = 0)::INT AS n FROM {LINES})
SELECT CAST(count(*) FILTER (n > 0) AS BIGINT) AS flagged_items, count(DISTINCT l_orderkey) FILTER (n > 0) AS jobs_with_review, CAST(sum(n) AS BIGINT) AS parser_flags FROM f"""


def commonest_types(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return records.commonest(rows, "p_name")


def names_ever(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.collect_set("event_type").alias("names"))
    return records.all_names(e, "user_id", "names").select("user_id", F.array_join("names", ",").alias("names"))


def history_recent(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").cast("string").alias("last_seen"))
    return e.orderBy(F.desc("last_seen"), "user_id").limit(10).select("user_id")


def master_update(spark, sf):
    """Three polls of the queue, one folded after another."""
    fields = ["status", "due"]
    master = spark.createDataFrame([], "job long, status string, due string, added string, left string, last_in string, last_out string, on_queue boolean, history array<struct<event:string,time:string>>")
    for day in (D0, D1, D2):
        poll = board(spark, sf, day).select("job", "status", F.when(F.col("job") % 3 > 0, F.col("due_lines").cast("string")).alias("due"))
        master = records.updated_master(master, poll, "job", fields, F.lit(day))
    return master.withColumn("history", F.array_join(F.transform("history", lambda h: F.concat_ws(" ", h["event"], h["time"])), ","))


MASTER = f"""
WITH p AS (SELECT job, d, status, CASE WHEN job % 3 > 0 THEN CAST(due_lines AS VARCHAR) END AS due FROM (SELECT 1 AS d, job, status, due_lines FROM {B0} UNION ALL SELECT 2, job, status, due_lines FROM {B1} UNION ALL SELECT 3, job, status, due_lines FROM {B2})),
g AS (SELECT job, bool_or(d = 1) AS a, bool_or(d = 2) AS b, bool_or(d = 3) AS c, arg_max(status, d) AS status, arg_max(due, d) FILTER (due IS NOT NULL) AS due FROM p GROUP BY 1)
SELECT job, status, due, CASE WHEN a THEN '{D0}' WHEN b THEN '{D1}' ELSE '{D2}' END AS added, CASE WHEN c THEN NULL WHEN b THEN '{D2}' ELSE '{D1}' END AS left, CASE WHEN c AND NOT b THEN '{D2}' WHEN b AND NOT a THEN '{D1}' ELSE '{D0}' END AS last_in,
  CASE WHEN b AND NOT c THEN '{D2}' WHEN a AND NOT b THEN '{D1}' END AS last_out, c AS on_queue,
  concat_ws(',', CASE WHEN a THEN 'in {D0}' END, CASE WHEN b AND NOT a THEN 'in {D1}' WHEN a AND NOT b THEN 'out {D1}' END, CASE WHEN c AND NOT b THEN 'in {D2}' WHEN b AND NOT c THEN 'out {D2}' END) AS history FROM g"""


QUERIES = {
    "attached_drawings": (attached_drawings, f"SELECT o_orderkey, CAST(coalesce(n, 0) AS INTEGER) AS drawings, CASE WHEN n IS NULL THEN '' ELSE '/dwg/' || o_orderkey END AS folder, n IS NOT NULL AS scanned FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {EXTRAS} GROUP BY 1) ON l_orderkey = o_orderkey"),
    "cached_tags": (cached_tags, CACHED),
    "handled_marks": (handled_marks, MARKS),
    "explorer_records": (explorer_records, EXPLORER),
    "order_log": (order_log, f"SELECT o_orderkey AS job, b.job IS NOT NULL AS on_queue, CASE WHEN b.job IS NULL THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE '{D0}' END AS added, CASE WHEN b.job IS NULL THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS left FROM orders LEFT JOIN {B1} b ON b.job = o_orderkey"),
    "realigned": (realigned, REALIGNED),
    "folded_sources": (folded_sources, FOLDED),
    "merge_counts": (merge_counts, f"SELECT count(*) FILTER (n_drawings) AS drawings, count(*) FILTER (n_backfill) AS backfill FROM ({FOLDED})"),
    "recorded_parses": (recorded_parses, RECORDED),
    "carried_readings": (carried_readings, f"SELECT l_orderkey, l_linenumber, CASE WHEN flag = 'N' THEN CAST(q AS VARCHAR) WHEN part % 2 = 0 THEN CAST(part AS VARCHAR) ELSE '' END AS fields, CASE WHEN flag <> 'N' AND part % 2 = 0 THEN 'read' ELSE 'new' END AS status FROM {LINES}"),
    "best_results": (best_results, BEST),
    "guarded_state": (guarded_state, GUARDED),
    "wrapped_history": (wrapped_history, WRAPPED),
    "board_positions": (board_positions, f"SELECT a.job, a.status, b.co_number + 1 AS position FROM {B2} a LEFT JOIN {B1} b USING (job)"),
    "group_starts": (group_starts, f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1 AS group_start FROM {LINES} WHERE flag <> 'A'"),
    "typed_order": (typed_order, TYPED),
    "rarest_first": (rarest_first, RAREST),
    "history_matrix": (history_matrix, f"SELECT job FROM {B2} ORDER BY job LIMIT 300"),
    "review_metrics": (review_metrics, REVIEW),
    "commonest": (commonest_types, "SELECT p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20"),
    "names_ever": (names_ever, "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY 1"),
    "history_recent": (history_recent, "SELECT user_id FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 10"),
    "master_update": (master_update, MASTER),
}
