"""Queries on predicates and order documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.functions import filters
from orderloom.operators import documents
from orderloom.plans.board import D1, D2, board, board_sql
from orderloom.sources.tables import table

B1, B2 = map(board_sql, (D1, D2))


def item_lines(spark, sf):
    """Lines of an order as a document: a heading, items with prices, text under them, a total."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    first = l.groupBy(F.col("l_orderkey").alias("doc"), "l_linenumber").agg(F.min_by("p_name", "l_partkey").alias("p_name"), F.min_by("p_type", "l_partkey").alias("p_type"), F.min("l_partkey").alias("k"))
    headed = F.max(F.col("l_linenumber") == 3).over(W.partitionBy("doc"))
    first = first.withColumn("headed", headed).filter("headed or l_linenumber < 3")
    rows = F.array(
        F.struct(F.lit(0).alias("o"), F.when(F.col("l_linenumber") == 3, "Accessories:").alias("line")),
        F.struct(F.lit(1).alias("o"), F.concat_ws("", F.col("l_linenumber").cast("string"), F.lit(". "), F.col("p_name"), F.when(F.col("l_linenumber") < 3, F.concat(F.lit(" L "), F.col("k").cast("string"), F.lit(".00")))).alias("line")),
        F.struct(F.lit(2).alias("o"), F.when(F.col("l_linenumber") < 3, F.concat(F.lit("  of "), F.col("p_type"))).alias("line")),
        F.struct(F.lit(3).alias("o"), F.when(F.col("l_linenumber") == 5, "Total 1.00").alias("line")),
    )
    return first.select("doc", F.col("l_linenumber").alias("n"), F.explode(rows).alias("r")).filter("r.line is not null").select("doc", (F.col("n") * 4 + F.col("r.o")).alias("pos"), F.col("r.line").alias("line"))


def extract_items(spark, sf):
    got = documents.extract_items(item_lines(spark, sf), "doc", "pos", "line")
    return got.select("doc", "item", "norm", "qty", "price", "type", F.coalesce("section", F.lit("")).alias("section"), F.array_join("details", "|").alias("details"))


EXTRACT = """
WITH f AS (SELECT l_orderkey AS doc, l_linenumber AS n, arg_min(p_name, l_partkey) AS p, arg_min(p_type, l_partkey) AS t, min(l_partkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
i AS (SELECT *, n * 4 + 1 AS item, upper(p) AS norm, bool_or(n = 3) OVER h AS opened, bool_or(n = 5) OVER b AS closed FROM f WINDOW h AS (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, coalesce(opened, false) AND NOT coalesce(closed, false) AS inside FROM i)
SELECT doc, CAST(item AS BIGINT) AS item, norm, CAST(n AS VARCHAR) AS qty, CASE WHEN n < 3 THEN k || '.00' ELSE '' END AS price, CASE WHEN n < 3 THEN 'L' ELSE '' END AS type, CASE WHEN n >= 3 THEN 'Accessories' ELSE '' END AS section, CASE WHEN n < 3 THEN 'of ' || t ELSE '' END AS details
FROM a WHERE n < 3 OR inside QUALIFY row_number() OVER (PARTITION BY doc, norm ORDER BY item) = 1"""


def order_items(spark, sf):
    """Orders as documents: what their heads say of arrangement and parts decides on the tags of lines below."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), "o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("s"))
    k = F.col("doc")
    rows = F.array(
        F.when(k % 5 > 0, F.lit("Sales Order")).otherwise("SALES ORDER FOR REPAIR PARTS"),
        F.when(k % 4 == 0, F.lit("Arrangement 9, class 2")).when(k % 4 == 1, F.lit("Arrangement: A/4V")).when(k % 4 == 2, F.lit("Class 2")).otherwise("arrangement 3"),
        F.concat(F.lit("1. Extended lube lines "), F.col("s"), F.lit(" L 12.00")), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("  on the motor "), (F.col("o_custkey") % 9).cast("string"))),
        F.concat(F.lit("2. Construction, aluminum "), (F.col("o_custkey") % 9).cast("string"), F.lit(" L 45.00")), F.when(F.col("o_custkey") % 3 == 0, F.lit("Arrangement 1")),
    )
    lines = o.select("doc", F.posexplode(rows).alias("pos", "line")).filter("line is not null")
    return documents.order_items(lines, "doc", "pos", "line").select("doc", "item", "norm", "arrangement", "parts_only", F.array_join("tags", ", ").alias("tags"))


ORDER_ITEMS = """
WITH o AS (SELECT o_orderkey AS doc, o_custkey AS c, o_orderstatus AS s, o_orderkey % 5 = 0 AS parts_only,
  CASE o_orderkey % 4 WHEN 0 THEN '9' WHEN 1 THEN 'A/4V' WHEN 3 THEN '3' ELSE CASE WHEN o_custkey % 3 = 0 THEN '1' ELSE '' END END AS arrangement FROM orders)
SELECT doc, 2 AS item, 'EXTENDED LUBE LINES ' || s AS norm, arrangement, parts_only, CASE WHEN c % 2 = 0 THEN 'MOTOR' WHEN arrangement = '' THEN 'BEARINGS, MOTOR' WHEN arrangement = 'A/4V' THEN 'MOTOR' ELSE 'BEARINGS' END AS tags FROM o
UNION ALL SELECT doc, 4, 'CONSTRUCTION ALUMINUM ' || c % 9, arrangement, parts_only, 'ALUMINUM, MATERIALS' || CASE WHEN parts_only THEN ', PARTS-ONLY ORDER' ELSE '' END FROM o"""


def labelled_values(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" : "), F.col("event_id").cast("string"), F.lit(" ")).alias("line"))
    return documents.labelled_values(e, "user_id", "event_id", "line")


def stale_recheck(spark, sf):
    b = board(spark, sf, D2).select(F.when(F.col("job") % 3 == 0, F.concat(F.col("job").cast("string"), F.lit("R"))).otherwise(F.col("job").cast("string")).alias("job"), F.when(F.col("job") % 5 > 0, F.to_timestamp(F.col("first_ship"))).alias("verified"), "due_lines")
    return filters.stale(b, F.to_timestamp(F.lit("1998-07-01 00:00:00")), "verified", "job", F.col("due_lines") > 1, most=5).select("job", F.col("verified").cast("date").alias("verified"))


def repriced(spark, sf):
    b1 = board(spark, sf, D1).select("job", F.col("due_value").alias("before"))
    return board(spark, sf, D2).select("job", "due_value").join(b1, "job").filter(filters.repriced(F.col("due_value"), F.col("before")))


def predicates(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        filters.penalty(F.when(k % 9 == 0, "late PENALTY applies").otherwise(F.col("o_orderpriority"))).alias("penalty"),
        filters.done(F.when(k % 2 == 0, "ok").otherwise("not-found"), F.when(k % 3 > 0, "so"), (k % 4).cast("int"), F.when(k % 5 > 0, "v2").otherwise("v1"), "v2").alias("done"),
        filters.backfill_status(k % 7 > 0, k % 3 > 0, k % 4, k % 2).alias("status"),
        filters.any_column("high", ["o_orderpriority", "o_orderstatus"]).alias("text"),
        filters.noise(F.col("o_orderpriority"), ["not spec", "low"]).alias("noise"),
    )


PREDICATES = """
SELECT o_orderkey, o_orderkey % 9 = 0 AS penalty, (o_orderkey % 2 = 0 AND o_orderkey % 3 > 0) OR (o_orderkey % 2 <> 0 AND o_orderkey % 4 >= 2 AND o_orderkey % 5 > 0) AS done,
  CASE WHEN o_orderkey % 7 = 0 THEN 'not-found' WHEN o_orderkey % 3 = 0 THEN 'no-SO' WHEN o_orderkey % 4 = o_orderkey % 2 THEN 'ok' ELSE 'error' END AS status,
  contains(upper(o_orderpriority || chr(10) || o_orderstatus), 'HIGH') AS text, regexp_matches(lower(o_orderpriority), 'not spec|low') AS noise FROM orders"""


def extremes(spark, sf):
    p = table(spark, sf, "part")
    said = F.concat(F.lit("RATED FOR "), (F.col("p_size") * 7 - 20).cast("string"), F.lit(" F, "), (F.col("p_size") * 2 - 5).cast("string"), F.lit(" DEG C, 900 RPM"))
    return p.select("p_partkey", F.array_join(documents.temperatures(said), "; ").alias("extremes"))


EXTREMES = """
SELECT p_partkey, concat_ws('; ', CASE WHEN p_size * 7 - 20 < 0 OR p_size * 7 - 20 >= 130 THEN (p_size * 7 - 20) || ' F' END, CASE WHEN p_size * 2 - 5 < 0 OR p_size * 2 - 5 >= 50 THEN (p_size * 2 - 5) || ' DEG C' END) AS extremes FROM part"""


def note_rows(spark, sf):
    c = table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").alias("order"), F.concat_ws("|", F.col("role"), F.col("turn").cast("string")).alias("row_key"), F.col("turn").cast("string").alias("item_no"), F.md5(F.col("text").cast("binary")).alias("item_text"), F.col("turn").alias("row"))
    rows = rows.groupBy("order", "row").agg(F.min("row_key").alias("row_key"), F.min("item_no").alias("item_no"), F.min("item_text").alias("item_text"))
    notes = rows.select((F.col("order") * 100 + F.col("row")).alias("id"), "order", F.when(F.col("row") % 4 == 0, F.col("row_key")).otherwise("gone").alias("row_key"), F.when(F.col("order") % 3 == 0, F.col("item_no")).otherwise("none").alias("item_no"), F.when(F.col("order") % 2 == 0, F.col("item_text")).otherwise("lost").alias("item_text"))
    return documents.notes_on_rows(notes, rows, "order")


NOTE_ROWS = """
WITH r AS (SELECT conv_id AS o, turn AS row, min(md5(text)) AS t FROM conversations GROUP BY 1, 2), x AS (SELECT o, t, min(row) AS by_text FROM r GROUP BY 1, 2), f AS (SELECT o, min(row) AS first FROM r GROUP BY 1)
SELECT o * 100 + row AS id, CASE WHEN row % 4 = 0 OR o % 3 = 0 THEN row WHEN o % 2 = 0 THEN by_text ELSE first END AS row FROM r JOIN x USING (o, t) JOIN f USING (o)"""


def preview_difference(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("left_status"), F.col("o_orderpriority").alias("left_priority"), F.lit("x").alias("left_size"))
    n = table(spark, sf, "orders").select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.lower("o_orderstatus").alias("right_status"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("right_priority"), F.lit("y").alias("right_size"))
    return documents.field_differences(o.join(n, "o_orderkey"), ["status", "priority", "size"], ["size"]).select("o_orderkey", F.array_join("differences", ",").alias("differences"))


def template_choice(spark, sf):
    d = table(spark, sf, "documents")
    scores = {"table": F.regexp_count("text", F.lit(r"\|")), "prose": F.when(F.col("text").contains("."), 3).otherwise(0), "lines": F.regexp_count("text", F.lit("\n"))}
    return documents.best_template(d, scores).select("doc_id", "template")


QUERIES = {
    "extract_items": (extract_items, EXTRACT),
    "order_items": (order_items, ORDER_ITEMS),
    "labelled_values": (labelled_values, "SELECT user_id, upper(event_type) AS label, CAST(min(event_id) AS VARCHAR) AS value FROM events GROUP BY 1, 2"),
    "stale_recheck": (stale_recheck, f"SELECT CAST(job AS VARCHAR) AS job, CASE WHEN job % 5 > 0 THEN CAST(first_ship AS DATE) END AS verified FROM {B2} WHERE due_lines > 1 AND job % 3 <> 0 AND (job % 5 = 0 OR CAST(first_ship AS TIMESTAMP) < TIMESTAMP '1998-06-30 23:15:00') ORDER BY verified NULLS FIRST, CAST(job AS VARCHAR) LIMIT 5"),
    "repriced": (repriced, f"SELECT a.job, a.due_value, b.due_value AS before FROM {B2} a JOIN {B1} b USING (job) WHERE a.due_value <> b.due_value"),
    "predicates": (predicates, PREDICATES),
    "temperatures": (extremes, EXTREMES),
    "note_rows": (note_rows, NOTE_ROWS),
    "preview_difference": (preview_difference, "SELECT a.o_orderkey, concat_ws(',', CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'status' END, CASE WHEN b.o_orderkey % 3 > 0 AND a.o_orderpriority <> b.o_orderpriority THEN 'priority' END) AS differences FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1"),
    "template_choice": (template_choice, "SELECT doc_id, CASE WHEN t >= p AND t >= l AND t > 0 THEN 'table' WHEN p >= l AND p > 0 THEN 'prose' WHEN l > 0 THEN 'lines' END AS template FROM (SELECT doc_id, length(text) - length(replace(text, '|', '')) AS t, CASE WHEN contains(text, '.') THEN 3 ELSE 0 END AS p, length(text) - length(replace(text, chr(10), '')) AS l FROM documents)"),
}
