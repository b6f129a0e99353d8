"""Queries on order documents composed of several columns of the tables, with SQL that states what each says."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.functions import sheets
from orderloom.sources import sinks
from orderloom.sources.steps import spread
from orderloom.sources.tables import table


def chosen(key, *texts):
    """The text of a key's remainder."""
    out = texts[-1]
    for k, t in reversed(list(enumerate(texts[:-1]))):
        out = F.when(key % len(texts) == k, t).otherwise(out)
    return out


def order_validation(spark, sf):
    """Orders held against documents that give their number in five ways, another's, none, or that cannot be read."""
    o = table(spark, sf, "orders")
    n, other = (F.col("o_orderkey") + 100000).cast("string"), (F.col("o_orderkey") + F.col("o_custkey") % 2 + 100001).cast("string")
    text = chosen(
        F.col("o_orderkey"),
        F.concat(F.lit("SALES ORDER\nOrder # Job # "), F.col("o_orderpriority"), F.lit("\n\n "), n, F.lit(" x")), F.concat(F.lit("Order Verification Report\norder#: "), n), F.concat(F.col("o_orderpriority"), F.lit(" Sales Order No. "), other), F.concat(F.lit("Sales  Order\nOrder # Job #\n"), other, F.lit("a")),
        F.concat(F.lit("Sales Order of "), F.col("o_orderdate").cast("string")), F.col("o_orderstatus"), F.lit(None).cast("string"), F.concat(F.lit("Sales Order\nOrder# RepRef.# PO\n "), n, F.lit("b")),
        F.concat(F.lit("Order Cust PO Ship Via Package Prepaid Date Order Terms Verification Date\n"), n, F.lit(" 12 UPS")),
    )
    got = sheets.validated((F.col("o_orderkey") + 100000).cast("string"), text, "SALES_ORDER")
    return o.select("o_orderkey", got.alias("r")).select("o_orderkey", "r.*")


VALIDATION = """
WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS k, CAST(o_orderkey + 100000 AS VARCHAR) AS n, CAST(o_orderkey + o_custkey % 2 + 100001 AS VARCHAR) AS other FROM orders)
SELECT o_orderkey, (['MATCH', 'WRONG_DOCUMENT', 'UNVERIFIABLE', 'MISMATCH', 'UNVERIFIABLE', 'UNREADABLE', 'ERROR', 'UNVERIFIABLE', 'WRONG_DOCUMENT'])[k + 1] AS status,
  CASE WHEN k IN (0, 1, 8) THEN n WHEN k = 2 THEN other WHEN k = 3 THEN other || 'A' WHEN k = 7 THEN n || 'B' ELSE '' END AS number,
  (['order-job-table', 'inline', 'sales-order-label', 'order-job-table', 'none', 'none', 'none', 'header', 'order-verification-table'])[k + 1] AS method,
  CASE WHEN k IN (1, 8) THEN 'ORDER_VERIFICATION' WHEN k IN (5, 6) THEN 'UNKNOWN' ELSE 'SALES_ORDER' END AS kind FROM o"""


def legacy_specs(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    maybe = lambda rule, text: F.when(rule, text).otherwise("")
    line = F.concat(
        maybe(k % 5 > 0, F.concat(F.lit("D"), F.col("p_size").cast("string"), F.lit(" "))), F.col("p_name"), F.lit(",  Size "), F.col("p_size").cast("string"),
        maybe(k % 3 > 0, F.lit(", A/4V x,C/22")), maybe(k % 4 > 0, F.lit(" ,Arrangement 9")), maybe(k % 7 > 0, F.lit(", ccw")), F.lit(", TH"), maybe(k % 2 > 0, F.concat(F.lit(", "), F.col("p_size").cast("string"), F.lit(".5 %"))),
        F.lit(", WHEEL TYPE "), chosen(k, F.lit("backward  Curved"), F.lit("Airfoil,"), F.col("p_type")),
    )
    lines = F.array(F.col("p_brand"), F.lit(" design info "), F.lit(""), F.split(line, ",  ")[0], F.concat(F.lit(",  "), F.split(line, ",  ")[1]), chosen(k, F.lit("Performance"), F.lit("____"), F.lit("x@y.z")), F.concat(F.lit("a, DESIGN TEMP "), F.col("p_size").cast("string"), F.lit(" F, MAX TEMP -5.5")), F.lit("CSIV10C"), F.lit("Design Info"), F.lit("X, SIZE 1, CW"))
    return p.select("p_partkey", sheets.legacy_spec(lines).alias("s")).select("p_partkey", "s.*")


LEGACY = """
WITH p AS (SELECT *, p_partkey AS k FROM part), f AS (SELECT *, k % 7 > 0 AS r FROM p)
SELECT p_partkey, CASE WHEN r THEN p_name END AS design_desc, CASE WHEN r THEN CAST(p_size AS VARCHAR) END AS size,
  CASE WHEN r THEN CASE WHEN k % 3 > 0 THEN 'A/4V x' WHEN k % 4 > 0 THEN 'Arrangement 9' ELSE 'N/A' END END AS arrangement, CASE WHEN r THEN CASE WHEN k % 3 > 0 THEN 'C/22' ELSE 'N/A' END END AS fan_class,
  CASE WHEN r THEN 'CCW' END AS rotation, CASE WHEN r THEN 'TH' END AS discharge, CASE WHEN r THEN CASE WHEN k % 2 > 0 THEN p_size || '.5' ELSE '' END END AS pct_width,
  CASE WHEN r THEN CASE k % 3 WHEN 0 THEN 'BC' WHEN 1 THEN 'AF' ELSE p_type END END AS wheel_type, CASE WHEN r THEN p_size || ' F' END AS design_temp, CASE WHEN r THEN '-5.5' END AS max_temp FROM f"""


def spec_cells(spark, sf):
    p, k = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_brand", "p_name"), "p_partkey"), F.col("p_partkey")
    cells = F.array(F.lit(None).cast("string"), F.concat(F.lit("size\n"), F.col("p_size").cast("string")), F.concat(F.lit(" WheelType "), F.col("p_type")), chosen(k, F.lit("Design"), F.concat(F.lit("DESIGN "), F.col("p_brand"))), F.lit("Size 99"), F.lit("Design B"), F.lit("Designed by"), F.concat(F.lit("%width "), F.col("p_name")))
    got = p.select("p_partkey", sheets.spec_cells(cells).alias("m"))
    return got.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ").alias("cells"))


def outline_tables(spark, sf):
    """Dimensions between the table's heading and its end, of codes with a name and without."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    row = lambda code, words, inches: F.concat(F.lit(f" {code}  "), words, F.lit("   "), inches, F.lit("    123 "))
    size = F.col("p_size").cast("string")
    lines = F.array(row("A", F.lit("BEFORE"), size), F.lit("Axial View / side view"), row("KK", F.upper("p_name"), F.concat(size, F.lit("  1/2"))), row("ZZ", F.upper("p_name"), size), row("KK", F.lit("AGAIN"), F.lit("1")), F.lit("  A = 12"), chosen(k, F.lit("punching detail"), F.lit(" ---"), F.lit("no end")), row("W", F.lit("AFTER"), size))
    got = p.select("p_partkey", sheets.outline_dims(lines).alias("m"))
    return got.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ").alias("dims"))


OUTLINE = """
SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN p_partkey % 3 = 2 THEN 'Bottom of Disch to CL (W)=' || p_size END, t || ' (ZZ)=' || p_size, 'Outlet/Inlet Flange (KK)=' || p_size || ' 1/2'], lambda x: x IS NOT NULL)), '; ') AS dims
FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS t FROM part)"""


def primary_pages(spark, sf):
    """Documents of three pages, the second without an arrangement of its own."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    lines = F.array(F.lit("p1"), F.concat(F.lit("Fan ARR "), chosen(k, F.lit("4V,"), F.lit("8"), F.lit("9"))), F.lit(" ------------------- "), F.lit("p2"), F.col("p_name"), F.lit("-------------------"), F.lit("-------------------"), chosen(k, F.lit("arr 9H"), F.lit("ARR 4"), F.lit("ARR 8")), F.lit("p3"))
    return p.select("p_partkey", F.array_join(sheets.primary_lines(lines), "|").alias("lines"))


PRIMARY = """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'p1|Fan ARR 4V,|p2|' || p_name WHEN 1 THEN 'ARR 4|p3' ELSE 'p1|Fan ARR 9| ------------------- |p2|' || p_name || '|-------------------|-------------------|ARR 8|p3' END AS lines FROM part"""


def order_headers(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    lines = F.array(F.col("o_orderpriority"), chosen(k, F.lit("arrangement: a / 4v now"), F.lit("x"), F.lit("Arrangement 9")), F.lit("ARRANGEMENT 1"), chosen(F.col("o_custkey"), F.lit("a sales order for repair parts."), F.lit("Sales order for  parts"), F.lit("Sales order for partsX"), F.lit(None).cast("string")))
    got = sheets.order_context(lines, F.when(k % 5 == 0, " 7 "))
    return o.select("o_orderkey", got["arrangement"].alias("arrangement"), got["parts_only"].alias("parts_only"))


def file_types(spark, sf):
    """Documents' texts as bytes of several kinds, told apart and read again."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    plain = F.coalesce(F.regexp_replace("text", r"[^\x09\x0A\x0D\x20-\x7E\xA0-\xFF]", "?"), F.lit(""))
    raw = chosen(k, F.encode(plain, "UTF-8"), F.encode(plain, "ISO-8859-1"), F.concat(F.lit("%PDF-1.7 ").cast("binary"), F.encode(plain, "UTF-8")), F.concat(F.unhex(F.lit("504B0304")), F.lit("..word/document.xml").cast("binary"), F.unhex(F.lit("00"))), F.unhex(F.lit("504B030400")), F.unhex(F.lit("D0CF11E0A1B11AE10001")))
    rows = d.select("doc_id", raw.alias("content"))
    return rows.select("doc_id", sheets.sniffed(F.col("content")).alias("type"), F.md5(sheets.decoded(F.col("content")).cast("binary")).alias("digest"))


TYPES = r"""
SELECT doc_id, (['', '', '.pdf', '.docx', '.zip', '.bin'])[doc_id % 6 + 1] AS type, md5(CASE WHEN doc_id % 6 < 2 THEN t WHEN doc_id % 6 = 2 THEN '%PDF-1.7 ' || t ELSE '' END) AS digest
FROM (SELECT doc_id, coalesce(regexp_replace(text, '[^\x09\x0A\x0D\x20-\x7E\x{A0}-\x{FF}]', '?', 'g'), '') AS t FROM documents)"""


def byte_shards(spark, sf):
    o = table(spark, sf, "orders")
    return sinks.byte_shards(o, "o_orderkey", F.col("o_custkey") % 997 + F.length("o_orderpriority"), 60_000)


SHARDS = """
WITH RECURSIVE s AS (SELECT o_orderkey AS k, o_custkey % 997 + length(o_orderpriority) AS b FROM orders),
r AS (
  SELECT k, b, 0 AS level, k // 1000 * 1000 AS low, k // 1000 * 1000 + 999 AS high FROM s
  UNION ALL SELECT k, b, level + 1, CASE WHEN k <= (low + high) // 2 THEN low ELSE (low + high) // 2 + 1 END, CASE WHEN k <= (low + high) // 2 THEN (low + high) // 2 ELSE high END FROM r WHERE level < 10
), g AS (SELECT level, low, high, count(*) AS rows, sum(b) AS bytes FROM r GROUP BY 1, 2, 3), f AS (SELECT * FROM g WHERE bytes <= 60000 OR low = high),
m AS (SELECT r.k, min(r.level) AS level FROM r JOIN f USING (level, low, high) GROUP BY 1)
SELECT DISTINCT f.low, f.high, f.rows, CAST(f.bytes AS BIGINT) AS bytes FROM m JOIN r USING (k, level) JOIN f USING (level, low, high)"""

QUERIES = {
    "order_validation": (order_validation, VALIDATION),
    "legacy_specs": (legacy_specs, LEGACY),
    "spec_cells": (spec_cells, "SELECT p_partkey, concat_ws('; ', '%Width=' || p_name, 'Design=' || CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE p_brand END, 'Size=' || p_size, 'WheelType=' || p_type) AS cells FROM part"),
    "outline_tables": (outline_tables, OUTLINE),
    "primary_pages": (primary_pages, PRIMARY),
    "order_headers": (order_headers, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '7' ELSE (['A/4V', '1', '9'])[o_orderkey % 3 + 1] END AS arrangement, o_custkey % 4 < 2 AS parts_only FROM orders"),
    "file_types": (file_types, TYPES),
    "byte_shards": (byte_shards, SHARDS),
}
