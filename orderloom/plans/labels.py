"""Queries on labels and records as they are shown, with their SQL. Rows of the tables stand in for the reference's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.functions import labels
from orderloom.plans.board import D2, board, board_sql
from orderloom.sources.tables import table

B2 = board_sql(D2)
NOW = "2024-01-15 12:00:00"


def time_labels(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 > 0, F.col("ts").cast("timestamp")).alias("at"))
    return e.select("event_id", labels.time_label(F.col("at"), F.lit(NOW).cast("timestamp"), "NO DATA").alias("added"), labels.time_label(F.col("at"), F.lit(NOW).cast("timestamp"), "").alias("last_out"))


def _time_sql(missing):
    return f"CASE WHEN event_id % 10 = 0 THEN '{missing}' WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN strftime(ts, '%-I:%M %p') ELSE strftime(ts, '%b %-d, %Y') END"


def lines_of_orders(spark, sf):
    """Lines with a place in their order; repeated line numbers are told apart by the part."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part"), F.min("l_quantity").cast("int").alias("q"))


LINES = "(SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_partkey) AS part, CAST(min(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY 1, 2)"


def change_notes(spark, sf):
    said = F.concat(F.lit("C/O #"), (F.col("part") % 4).cast("string"), F.lit(" line "), F.col("l_linenumber").cast("string"))
    rows = lines_of_orders(spark, sf).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", said.alias("t")))), lambda x: x["t"]).alias("history"))
    return rows.select("l_orderkey", labels.change_order_note(F.col("history")).alias("note"))


def extras(spark, sf):
    """A map from drawing suffix to format for each order."""
    kind = F.when(F.col("flag") == "A", "PDF+DWG").when(F.col("flag") == "N", "DWG").otherwise("")
    rows = lines_of_orders(spark, sf).withColumns({"suffix": F.when(F.col("l_linenumber") == 4, "B").otherwise((F.col("part") % 30 + 3 * F.col("l_linenumber")).cast("string")), "kind": kind})
    rows = rows.groupBy("l_orderkey", "suffix").agg(F.min("kind").alias("kind"))
    return rows.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("suffix", "kind")))).alias("extras"))


EXTRAS = f"""(SELECT l_orderkey, suffix, min(kind) AS kind, CASE WHEN suffix = 'B' THEN 1000000000 ELSE CAST(suffix AS INTEGER) END AS n FROM
  (SELECT l_orderkey, CASE WHEN l_linenumber = 4 THEN 'B' ELSE CAST(part % 30 + 3 * l_linenumber AS VARCHAR) END AS suffix, CASE flag WHEN 'A' THEN 'PDF+DWG' WHEN 'N' THEN 'DWG' ELSE '' END AS kind FROM {LINES}) GROUP BY l_orderkey, suffix)"""


def drawing_labels(spark, sf):
    rows = extras(spark, sf)
    links = F.array_join(F.transform(labels.drawing_links(F.col("extras")), lambda x: F.concat(x["suffix"], F.lit("."), x["kind"])), ",")
    return rows.select("l_orderkey", labels.drawing_label(F.col("extras")).alias("label"), labels.drawing_label(F.col("extras"), formats=True).alias("formats"), links.alias("links"))


DRAWINGS = f"""
SELECT l_orderkey, string_agg('-' || suffix, ', ' ORDER BY n, suffix) AS label, string_agg('-' || suffix || CASE WHEN kind = '' THEN '' ELSE ' (' || kind || ')' END, ', ' ORDER BY suffix) AS formats,
  string_agg(suffix || CASE WHEN contains(kind, 'PDF') THEN '.pdf' ELSE '.dwg' END, ',' ORDER BY n, suffix) AS links FROM {EXTRAS} GROUP BY 1"""


def drawing_matrix(spark, sf):
    """Orders by suffix, with a mark where an order has the drawing; the columns are those suffixes that occur."""
    rows = extras(spark, sf).select("l_orderkey", F.explode(F.map_keys("extras")).alias("suffix")).filter("suffix in ('3', '6', '9', '12', '15', '18', 'B')")
    return rows.groupBy("l_orderkey").pivot("suffix", ["3", "6", "9", "12", "15", "18", "B"]).agg(F.max(F.lit("✓"))).select("l_orderkey", *(F.col(f"`{s}`").alias(f"dwg_{s}") for s in ["3", "6", "9", "12", "15", "18", "B"]))


MATRIX = "SELECT l_orderkey, " + ", ".join(f"max(CASE WHEN suffix = '{s}' THEN '✓' END) AS dwg_{s}" for s in ["3", "6", "9", "12", "15", "18", "B"]) + f" FROM {EXTRAS} WHERE suffix IN ('3', '6', '9', '12', '15', '18', 'B') GROUP BY 1"


def feature_labels(spark, sf):
    """Tags are words of a part's name over six letters, and its type where the line was returned."""
    p = table(spark, sf, "part").select("p_partkey", F.filter(F.split("p_name", " "), lambda w: F.length(w) > 6).alias("tags"))
    items = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").join(p, F.col("l_partkey") == F.col("p_partkey"))
    orders = items.groupBy("l_orderkey").agg(F.collect_list("tags").alias("items"))
    return orders.select("l_orderkey", labels.features_label(F.col("items")).alias("features"))


FEATURE_LABELS = """
WITH i AS (SELECT l_orderkey, list_filter(string_split(p_name, ' '), lambda w: length(w) > 6) AS tags FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
g AS (SELECT l_orderkey, count(*) AS n, list_sort(list_distinct(flatten(list(tags)))) AS tags FROM i GROUP BY 1) SELECT l_orderkey, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE '(' || n || ' items)' END AS features FROM g"""


def reuse_labels(spark, sf):
    """Of each customer's orders the three dearest as suggestions, with two lines each."""
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("job"), (F.floor(F.col("o_totalprice") / 10) / 100).alias("score"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).otherwise("").alias("customer"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("07"), (F.col("o_orderkey") % 90).cast("string"))).otherwise(F.array(F.lit("51"))).alias("suffixes"), F.when(F.col("o_orderkey") % 5 > 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("lines"))
    found = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), (-F.col("job")).alias("p"), F.struct("job", "score", "customer", "suffixes", "lines").alias("r")))), lambda x: x["r"]), 1, 3)
    return o.groupBy("o_custkey").agg(found.alias("found")).select("o_custkey", labels.reuse_label(F.col("found")).alias("label"), labels.reuse_note(F.col("found")).alias("note"))


REUSE = """
WITH r AS (SELECT o_custkey, o_orderkey AS job, floor(o_totalprice / 10) / 100 AS score, CASE WHEN o_orderkey % 3 > 0 THEN '  ' || o_orderstatus ELSE '' END AS customer, CASE WHEN o_orderkey % 2 = 0 THEN '-07' || sep || '-' || o_orderkey % 90 ELSE '-51' END AS suffixes,
  CASE WHEN o_orderkey % 2 = 0 THEN '-07, -' || o_orderkey % 90 ELSE '-51' END AS spaced, CASE WHEN o_orderkey % 5 > 0 THEN chr(10) || '  = ' || o_orderpriority ELSE '' END AS lines, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 10) DESC, o_orderkey DESC) AS n FROM orders, (SELECT ',' AS sep)),
t AS (SELECT * FROM r WHERE n <= 3)
SELECT o_custkey, max(CASE WHEN n = 1 THEN job || ' (' || suffixes || ')' END) || CASE WHEN count(*) > 1 THEN ' +' || (count(*) - 1) ELSE '' END AS label,
  string_agg(job || customer || ' — score ' || printf('%.2f', score) || chr(10) || '  custom DWGs: ' || spaced || lines, chr(10) ORDER BY n) AS note FROM t GROUP BY 1"""


def document_links(spark, sf):
    k = F.col("p_partkey")
    pid = F.when(k % 3 > 0, F.concat(F.element_at(F.array(F.lit("SITE_so"), F.lit("cs_"), F.lit("drw")), (k % 3 + 1).cast("int")), F.lower("p_type"), F.lit("-"), k.cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit("-A1"))).otherwise(F.lower("p_brand"))
    found = labels.document_of(F.concat(F.lit("https://host.example/doc.aspx?pid="), F.url_encode(pid), F.lit("&fn="), F.url_encode("p_name"), F.lit("#x")))
    return table(spark, sf, "part").select("p_partkey", found["fn"].alias("fn"), found["type"].alias("type"), found["rev"].alias("rev"), labels.plain_type(found["type"], ["site_", "cs_"]).alias("plain"))


DOCUMENTS = """
WITH d AS (SELECT p_partkey, p_name AS fn, CASE p_partkey % 3 WHEN 0 THEN lower(p_brand) WHEN 1 THEN 'cs_' || lower(p_type) ELSE 'drw' || lower(p_type) END AS type, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS rev FROM part)
SELECT *, CASE WHEN starts_with(type, 'cs_') THEN substr(type, 4) ELSE type END AS plain FROM d"""


def board_records(spark, sf):
    b = board(spark, sf, D2)
    fields = {"st": F.col("status"), "op": F.when(F.col("job") % 2 == 0, F.col("priority")).otherwise(""), "hr": F.col("due_lines"), "no": F.lit(None).cast("string")}
    context = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in b.columns else F.lit("") for c in labels.CONTEXT]
    return b.select("job", labels.filled_json(fields).alias("record"), F.concat_ws("|", *context).alias("context"))


BOARD = f"SELECT job, '{{\"st\":\"' || status || '\"' || CASE WHEN job % 2 = 0 THEN ',\"op\":\"' || priority || '\"' ELSE '' END || ',\"hr\":' || due_lines || '}}' AS record, job || '|' || customer || '||||||' AS context FROM {B2}"


def tracked(spark, sf):
    """Comparable values of orders: a field, the change order (null is unknown), drawings and features."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 3).alias("co_number"))
    both = o.join(extras(spark, sf).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    return both.select("o_orderkey", F.coalesce("status", F.lit("")).alias("status"), F.coalesce(F.col("co_number").cast("string"), F.lit("")).alias("co"), F.coalesce(labels.drawing_label(F.col("extras")), F.lit("")).alias("drawings"))


TRACKED = f"""
SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 3 AS VARCHAR) ELSE '' END AS co, coalesce(label, '') AS drawings
FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('-' || suffix, ', ' ORDER BY n, suffix) AS label FROM {EXTRAS} GROUP BY 1) ON l_orderkey = o_orderkey"""


def wheel_component(spark, sf):
    """Facts of a run as pseudo items of the order that it belongs to, numbered after the others."""
    p = table(spark, sf, "part")
    run = F.map_filter(F.create_map(F.lit("Blades"), F.when(F.col("p_size") > 20, "").otherwise(F.col("p_size").cast("string")), F.lit("Blade Count"), F.lit("12"), F.lit("Hub Bore"), F.lower("p_name"), F.lit("Non-Std Wheel Materials"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))), lambda k, v: F.col("p_partkey") % 7 > 0)
    facts = F.posexplode(labels.wheel_facts(run, F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.col("p_type"))))
    return p.select("p_partkey", facts.alias("place", "f")).select("p_partkey", (F.col("place") + 1).alias("no"), "f.label", "f.value", "f.norm")


WHEEL = """
WITH f AS (SELECT p_partkey, unnest([{'k': 0, 'label': 'Blade Type', 'value': CASE WHEN p_partkey % 3 > 0 THEN p_type END}, {'k': 1, 'label': 'Blades', 'value': CASE WHEN p_size > 20 THEN '12' ELSE CAST(p_size AS VARCHAR) END},
  {'k': 2, 'label': 'Hub Bore', 'value': lower(p_name)}, {'k': 3, 'label': 'Wheel Material', 'value': CASE WHEN p_partkey % 2 = 0 THEN p_brand END}]) AS f FROM part WHERE p_partkey % 7 > 0)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY f.k) AS INTEGER) AS no, f.label AS label, f.value AS value,
  trim(regexp_replace(regexp_replace(upper('WHEEL ' || f.label || ' ' || f.value), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM f WHERE f.value IS NOT NULL"""


def run_summary(spark, sf):
    p = table(spark, sf, "part")
    fields = F.create_map(F.lit("Zinc Paint"), F.col("p_type"), F.lit("Hub"), F.col("p_brand"), F.lit("Alpha"), F.col("p_size").cast("string"), F.lit("Shaft Material"), F.col("p_name"), F.lit("Seal"), F.lit("x"))
    return p.select("p_partkey", labels.summary(fields).alias("summary"), labels.summary(fields, 2).alias("short"))


def run_files(spark, sf):
    k = F.col("l_orderkey") % 8
    names = ["C:\\job\\{} qt  run.txt", "C:\\job\\Qt History\\{} quote run.txt", "/x/~$ {} wheel.pdf", "/x/{} damper Quote Run.DOCX", "/x/{} wheel.dwg", "/x/history of/{} construction.md", "/x/{} notes.txt", "/x/histo/{} Construction.csv"]
    path = F.replace(F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int")), F.lit("{}"), F.col("l_orderkey").cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", labels.run_file(path).alias("run"), labels.damper_run(path).alias("damper"))


def detail_lines(spark, sf):
    k = (F.col("event_id") % 5 + 1).cast("int")
    line = F.element_at(F.array(F.concat("event_type", F.lit(" 7A")), F.lit("421473 7074-49840-00-AI26"), F.lit("200 HP, 1800 RPM"), F.col("event_id").cast("string"), F.lit("a 1 b")), k)
    return table(spark, sf, "events").select("event_id", labels.detail_worthy(line).alias("worthy"))


def runs_to_read(spark, sf):
    """Runs of each order: their states follow the lines' flags."""
    status = F.when(F.col("flag") == "A", labels.NO_TEXT).when(F.col("flag") == "N", "OK").otherwise(F.when(F.col("l_linenumber") % 2 == 0, labels.CHECK).otherwise("PARTIAL"))
    run = F.struct(F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("part") % 3 > 0, ".PDF").otherwise(".txt")).alias("path"), status.alias("status"), (F.col("part") % 5 == 0).alias("vision"))
    runs = lines_of_orders(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    paths = lambda again: F.array_join(F.transform(F.filter("runs", lambda r: labels.to_read(r, again)), lambda r: r["path"]), ",")
    return runs.select("l_orderkey", labels.unsettled(F.col("runs")).alias("attention"), paths(False).alias("to_read"), paths(True).alias("again"))


RUNS = f"""
WITH r AS (SELECT l_orderkey, l_linenumber || CASE WHEN part % 3 > 0 THEN '.PDF' ELSE '.txt' END AS path, part % 3 > 0 AS pdf, part % 5 = 0 AS vision, CASE flag WHEN 'A' THEN '{labels.NO_TEXT}' WHEN 'N' THEN 'OK' ELSE CASE WHEN l_linenumber % 2 = 0 THEN '{labels.CHECK}' ELSE 'PARTIAL' END END AS status FROM {LINES})
SELECT l_orderkey, bool_or(status IN ('{labels.NO_TEXT}', 'PARTIAL')) AS attention, coalesce(string_agg(path, ',' ORDER BY path) FILTER (pdf AND ((status = '{labels.NO_TEXT}' AND NOT vision) OR status = '{labels.CHECK}')), '') AS to_read,
  coalesce(string_agg(path, ',' ORDER BY path) FILTER (pdf AND ((status = '{labels.NO_TEXT}' AND NOT vision) OR status = '{labels.CHECK}' OR vision)), '') AS again FROM r GROUP BY 1"""


QUERIES = {
    "time_labels": (time_labels, f"SELECT event_id, {_time_sql('NO DATA')} AS added, {_time_sql('')} AS last_out FROM events"),
    "change_notes": (change_notes, f"SELECT l_orderkey, 'Change orders (most recent first):' || chr(10) || string_agg('C/O #' || part % 4 || ' line ' || l_linenumber, chr(10) ORDER BY part % 4 DESC, l_linenumber) AS note FROM {LINES} GROUP BY 1"),
    "drawing_labels": (drawing_labels, DRAWINGS),
    "drawing_matrix": (drawing_matrix, MATRIX),
    "feature_labels": (feature_labels, FEATURE_LABELS),
    "reuse_labels": (reuse_labels, REUSE),
    "document_links": (document_links, DOCUMENTS),
    "board_records": (board_records, BOARD),
    "tracked_values": (tracked, TRACKED),
    "wheel_component": (wheel_component, WHEEL),
    "run_summary": (run_summary, "SELECT p_partkey, 'Shaft Material=' || p_name || '; Zinc Paint=' || p_type || '; Seal=x; Hub=' || p_brand || '; Alpha=' || p_size AS summary, 'Shaft Material=' || p_name || '; Zinc Paint=' || p_type AS short FROM part"),
    "run_files": (run_files, "SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 8 IN (0, 3, 7) AS run, l_orderkey % 8 = 3 AS damper FROM lineitem"),
    "detail_lines": (detail_lines, "SELECT event_id, event_id % 5 IN (0, 2) AS worthy FROM events"),
    "runs_to_read": (runs_to_read, RUNS),
}
