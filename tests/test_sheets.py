"""Documents' readers on cases that the tables do not make, and shards against plain halving."""

import os
import random

import pytest
from pyspark.sql import functions as F

from orderloom.functions import sheets
from orderloom.sources import sinks


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


def test_spec_without_what_it_needs(spark):
    read = lambda *lines: one(spark, list(lines), "array<string>", sheets.legacy_spec)
    assert read() is None and read("Design Info") is None and read("Design Info", "D9 x, SIZE 3, A/4") is None and read("D9 x, SIZE 3, CW") is None
    got = read("DESIGN INFO", "Design 64-B Fan, special, SIZE 27 1/2, , A/1, Arrangement 4, C/3, C/4, cw", ", , UB, 50%%, more, WHEEL TYPE Other, kind,", "Motor", "MAX TEMP 95 °F")
    assert (got.design_desc, got.size, got.arrangement, got.fan_class, got.rotation, got.discharge, got.pct_width, got.wheel_type, got.max_temp, got.design_temp) == ("Fan, special", "27 1/2", "A/1", "C/3", "CW", "UB", "50", "Other, kind", "95 °F", "")


def test_pages(spark):
    read = lambda *lines: one(spark, list(lines), "array<string>", sheets.primary_lines)
    rule = "-" * 20
    assert read("a", rule, "b") == ["a", rule, "b"]
    assert read("x", rule, "ARR 9", rule, "y", rule, "ARR 4", rule, "z") == ["ARR 4", "z"]
    assert read("ARR 4", rule, "ARR 4V") == ["ARR 4", rule, "ARR 4V"]
    assert read() == []


def test_bytes(spark):
    read = lambda data: (one(spark, bytearray(data), "binary", sheets.sniffed), one(spark, bytearray(data), "binary", sheets.decoded))
    assert read(b"") == ("", "") and read(b"%PDF-1") == (".pdf", "%PDF-1") and read(b"a\0b") == ("", "")
    assert read("Größe 5 €".encode()) == ("", "Größe 5 €")
    old = bytes([0x80, 0x81, 0x93, 0xE9, 0x9F])
    assert read(b"caf" + old) == ("", "caf" + old.decode("cp1252", errors="replace"))
    assert read(b"PK\x03\x04..xl/workbook.xml..word/document.xml")[0] == ".xlsx"
    assert read(b"\x01" + b"a" * 60)[1] != "" and read(b"\x01\x02" + b"a" * 60)[1] == ""


def test_orders_that_cannot_be_told(spark):
    frame = spark.createDataFrame([("123456", "Order # Job #\n654321"), ("123456", "Order # 123456"), ("12345-6", "Sales Order 123456"), ("1", None)], "e string, t string")
    got = [tuple(r.r) for r in frame.select(sheets.validated(F.col("e"), F.col("t")).alias("r")).collect()]
    assert got == [("MISMATCH", "654321", "order-job-table", "UNKNOWN"), ("MATCH", "123456", "inline", "UNKNOWN"), ("MATCH", "123456", "sales-order-label", "SALES_ORDER"), ("ERROR", "", "none", "UNKNOWN")]


def test_shards_by_halving(spark):
    rng = random.Random(7)
    rows = [(rng.choice([rng.randrange(3000), 1500]), rng.randint(0, 90)) for _ in range(900)]

    def halve(low, high):
        inside = [b for k, b in rows if low <= k <= high]
        if not inside:
            return []
        if sum(inside) <= 400 or low == high:
            return [(low, high, len(inside), sum(inside))]
        mid = (low + high) // 2
        return halve(low, mid) + halve(mid + 1, high)

    got = sinks.byte_shards(spark.createDataFrame(rows, "k long, b int"), "k", F.col("b"), 400).collect()
    assert sorted(map(tuple, got)) == [s for base in (0, 1000, 2000) for s in halve(base, base + 999)]
    assert sinks.byte_shards(spark.createDataFrame([], "k long, b int"), "k", F.col("b"), 400).count() == 0


def planned(spark, name):
    from orderloom.plans import catalog

    return catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_costly_rows_of_one_file_are_dealt_over_tasks(spark):
    assert "RepartitionByExpression" in planned(spark, "spec_cells")
