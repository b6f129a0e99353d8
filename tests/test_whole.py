"""Queries whose rows SQL does not give, or whose tables are too small for their point, against brute force."""

import datetime as dt
import os
from collections import defaultdict

import pytest
from test_catalog import SF, duck  # noqa: F401

from orderloom.operators import rollups
from orderloom.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_order_similarity_of_all_neighbours(spark, duck):  # noqa: F811
    parts = defaultdict(list)
    for job, *part in duck.execute("SELECT l_orderkey, upper(p_name), upper(p_type), upper(l_returnflag) FROM lineitem JOIN part ON l_partkey = p_partkey").fetchall():
        parts[job].append(part)

    def likeness(a, b):
        key = lambda v: (v[0], f"{v[1]}|{v[2]}")
        few, free = sorted((sorted(a, key=key), sorted(b, key=key)), key=lambda s: (len(s), list(map(key, s))))
        n, total = len(free), 0.0
        for x in few:
            best = max(free, key=lambda y: (x[0] == y[0]) + 2 * len({*x[1:]} & {*y[1:]}) / (len({*x[1:]}) + len({*y[1:]})))
            total += 0.5 * (x[0] == best[0]) + len({*x[1:]} & {*best[1:]}) / (len({*x[1:]}) + len({*best[1:]}))
            free.remove(best)
        return total / n

    got = {r.job: r.likeness for r in catalog.queries()["order_similarity"](spark, SF).collect()}
    assert got.keys() == {j for j in parts if j + 1 in parts}
    assert all(abs(got[j] - likeness(parts[j], parts[j + 1])) < 1e-5 for j in got)


def test_events_of_a_hot_inquiry_and_a_full_day(spark, tmp_path):
    """More than 1,000 users of one inquiry, more than 4 events of a user, and users with several days."""
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3, i % 24), i % 1200 if i < 2400 else 7, f"e{i % 5}", '{"k": "%s"}' % ("hot" if i < 2400 else "cold")) for i in range(2430)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.inquiry, r.level, r.user_id): r.n for r in catalog.queries()["inquiry_counts"](spark, str(tmp_path)).collect()}
    assert got == {("hot", "job", u): 2 for u in range(1200)} | {("hot", "total", None): 2400, ("cold", "job", 7): 30, ("cold", "total", None): 30}
    want = defaultdict(list)
    for _, ts, user, kind, _ in rows:
        want[user, ts.date()].append(kind)
    found = defaultdict(list)
    for r in catalog.queries()["change_columns"](spark, str(tmp_path)).orderBy("field").collect():
        found[r.user_id, r.day].append(r.event_type)
        assert r.field == len(found[r.user_id, r.day])
    assert found == want and max(map(len, want.values())) > 4
    events = spark.read.parquet(f"{tmp_path}/events.parquet").selectExpr("user_id", "date(ts) AS day", "event_id", "event_type")
    n = max(map(len, want.values()))
    wide = rollups.numbered_columns(events, ["user_id", "day"], "event_id", "event_type", "field_", n)
    assert {(r.user_id, r.day): list(r[2:]) for r in wide.collect()} == {k: v + [None] * (n - len(v)) for k, v in want.items()}


def test_shortlist_of_all_orders(spark):
    """No order is left out before the best are taken, and what is rare is so among all orders."""
    best = sorted(((r.score, r.job, r.shared) for r in catalog.queries()["similar_orders"](spark, SF).collect() if r.score >= 0.001), reverse=True)[:3]
    assert len(best) == 3 and [(r.score, r.job, r.shared) for r in catalog.queries()["reuse_shortlist"](spark, SF).collect()] == best
