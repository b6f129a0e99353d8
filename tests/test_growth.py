"""What costs grow with, read off the plans: work once for each distinct text or part, and no table that grows sent to all tasks."""

import os
import re

import pytest
from pyspark.sql import functions as F
from test_catalog import SF

from orderloom.functions import text
from orderloom.operators import documents, nearest
from orderloom.plans import catalog, items, texts
from orderloom.sources import sinks, steps

tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@tables
def test_facts_are_worked_out_for_each_part(spark):
    assert "regexp_replace" not in plan(catalog.queries()["item_facts"](spark, SF))


def test_lines_are_read_once_for_each_text(spark):
    """Rows of a null line and of equal lines keep what they are, in a section and outside one."""
    lines = spark.createDataFrame([(1, 0, "1. Drain L 12.00"), (1, 1, None), (1, 2, "Accessories:"), (1, 3, "Drain"), (1, 4, None), (2, 0, "Drain")], "doc int, pos int, line string")
    got = documents.classified(lines, "doc", "pos", "line")
    assert "RLIKE" not in plan(got).upper() and "RLIKE" not in plan(documents.extract_items(lines, "doc", "pos", "line")).upper()
    assert [r.kind for r in got.orderBy("doc", "pos").collect()] == ["item_priced", "text", "section_start", "item_section", "item_section", "text"]


def test_prices_are_taken_off_up_to_eight_times(spark):
    texts = ["fan  ", "fan 1.00", "fan 1.00 2.00 EA", "fan " + "1.00 " * 9, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.split_price(F.col("t")).alias("s")).collect()
    assert [(r.s.text, r.s.price) for r in got] == [("fan", ""), ("fan", "1.00"), ("fan", "1.00"), ("fan 1.00", "1.00"), (None, "")]


@tables
def test_orders_are_read_once_for_each_line(spark):
    assert "RLIKE" not in plan(catalog.queries()["order_items"](spark, SF)).upper()


def test_halvings_move_keys_once(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.lit(7).alias("b"))
    got = plan(sinks.byte_shards(rows, "k", F.col("b"), 400))
    assert "Generate explode" not in got and got.count("Join") == 0


@tables
def test_parsed_orders_are_not_sent_to_all_tasks(spark, tmp_path):
    from orderloom.operators import index

    rows = spark.createDataFrame([(j, "tag", f"f{j % 3}") for j in range(30)], "job long, kind string, feature string")
    index.add(rows, f"{tmp_path}/i", 0)
    index.add(rows.filter("job < 9"), f"{tmp_path}/i", 1, jobs=rows.filter("job < 9").select("job"))
    assert "BroadcastHashJoin [job" not in plan(index.postings(spark, f"{tmp_path}/i"))


@tables
def test_shortlist_is_sifted_before_it_is_cut_to_jobs(spark):
    got = plan(catalog.queries()["reuse_shortlist"](spark, SF))
    assert "BroadcastHashJoin [l_partkey" not in got and "BroadcastHashJoin [job" not in got


@tables
def test_orders_are_made_ready_after_they_are_sifted(spark):
    got = catalog.queries()["focused_orders"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    quantity = r"\d+(?:\.\d+)?"
    assert quantity in got and quantity not in got[got.index("Join Inner") :]


@tables
def test_nearest_orders_work_on_what_differs(spark, monkeypatch):
    """Components are prepared once for each different one, and orders that are repeated add no comparisons."""
    made = {}

    def kept(df, label):
        out = steps.stored(df, label)
        made[label] = out.count()
        return out

    def sizes(orders):
        made.clear()
        assert nearest.nearest(orders, F.col("job") % 50 == 0).count() > 0
        return dict(made)

    monkeypatch.setattr(nearest, "stored", kept)
    once = steps.stored(texts.whole_orders(spark, os.path.join(os.path.dirname(SF), "sf0.001")), "once")
    one, two = sizes(once), sizes(once.unionByName(once.withColumn("job", F.col("job") + 1_000_000)))
    assert one["nearest-components"] == once.select(F.explode("o.components").alias("c")).select(F.to_json(F.struct("c"))).distinct().count()
    assert two["nearest-orders"] == 2 * one["nearest-orders"] and all(two[k] == one[k] for k in ("nearest-components", "nearest-whole", "nearest-classes", "nearest-core_id", "nearest-slots_id"))
    assert all(two[k] <= one[k] for k in ("nearest-blocks", "nearest-first", "nearest-rest"))


@tables
def test_pairs_of_orders_are_compared_once(spark, monkeypatch):
    """And pairs of blocks are not shuffled to learn the bar of a block."""
    plans = {}

    def kept(df, label):
        plans[label] = plan(df)
        return steps.stored(df, label)

    monkeypatch.setattr(nearest, "stored", kept)
    orders = texts.whole_orders(spark, os.path.join(os.path.dirname(SF), "sf0.001"))
    assert nearest.nearest(orders, F.col("job") % 50 == 0).count() > 0
    assert plans["nearest-first"].count("arrays_overlap(transform(") == plans["nearest-rest"].count("arrays_overlap(transform(") == 1
    assert "SortMergeJoin [from_block" not in plans["nearest-blocks"]


def test_orders_are_paired_where_they_lie(spark, tmp_path):
    """Over the ends of ranges, below zero, with orders twice, without lines, and without a number; nothing is shuffled for it."""
    jobs = [-65, -64, -1, 0, 62, 63, 64, 64, 65, 200, None]
    spark.createDataFrame([(j, i, "O", "1-URGENT") for i, j in enumerate(jobs)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(j, n, 2 + n % 2, 3.0 * n) for j in {-65, -64, 0, 63, 64, None} for n in (1, 2)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2, "b", "PROMO", 30), (3, "c", "SMALL", None)], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.queries()["order_likeness"](spark, str(tmp_path))
    assert "Exchange" not in plan(found)
    got = sorted((r.job, r.focused is not None, r.shared) for r in found.collect())
    assert [(j, f) for j, f, _ in got] == [(-65, True), (-1, False), (62, False), (63, True), (63, True), (64, False), (64, False)]
    assert all(s >= 2 for _, _, s in got)


@tables
def test_hierarchy_moves_items_once(spark, monkeypatch):
    """And over more tasks, where they are more."""
    monkeypatch.setattr(items, "LINES", 500)
    got = plan(catalog.queries()["item_hierarchy"](spark, SF))
    assert got.count("Exchange hashpartitioning") == 1 and "Join" not in got and re.search(r"Exchange hashpartitioning\(l_orderkey#\d+L?, 1[0-9]\)", got)
