"""Indexes kept up by deltas, gates that count computations, commits of two writers, re-spacing, and folders."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from orderloom.functions import facts, text
from orderloom.operators import commits, gated, index, merge, search
from orderloom.sources import folders

KIND = "job long, kind string, feature string"


def made(rng, jobs):
    return {j: {(rng.choice(["tag", "fact", "line", "context"]), f"f{rng.randint(0, 12)}") for _ in range(rng.randint(0, 9))} for j in jobs}


def plain(store, target, top):
    df = {f: sum(f in fs for fs in store.values()) for f in target}
    scores = {j: sum(search.WEIGHTS[k[0]] / df[k] for k in fs & target) for j, fs in store.items() if fs & target}
    return [(j, pytest.approx(scores[j])) for j in sorted(scores, key=lambda j: (-round(scores[j], 9), -j))[:top]]


def test_index_after_updates_and_compaction(spark, tmp_path):
    rng, root = random.Random(2), f"{tmp_path}/i"
    frame = lambda store: spark.createDataFrame([(j, *f) for j, fs in store.items() for f in fs], KIND)
    store = made(rng, range(60))
    index.add(frame(store), root, 0)
    target = {(k, f"f{n}") for k in search.WEIGHTS for n in (1, 4, 7)}
    wanted = spark.createDataFrame(sorted(target), "kind string, feature string")
    look = lambda r, **o: [(x.job, x.score) for x in index.ranked(spark, r, wanted, top=10, **o).collect()]
    assert look(root) == plain(store, target, 10)
    for version in (1, 2, 3):  # some are parsed again, more than once, some lose all, some are new
        new = made(rng, rng.sample(range(70), 15))
        new[5] = set()
        store |= new
        index.add(frame(new), root, version, jobs=spark.createDataFrame([(j,) for j in new], "job long"))
        assert look(root) == plain(store, target, 10)
    assert look(root, exclude=8) == plain({j: f for j, f in store.items() if j != 8}, target, 10)
    index.compact(spark, root, f"{tmp_path}/c")
    assert look(f"{tmp_path}/c") == plain(store, target, 10)
    assert index.ranked(spark, root, wanted.limit(0)).count() == 0


def test_index_reads_the_target_s_buckets_only(spark, tmp_path):
    index.add(spark.createDataFrame([(j, "tag", f"f{j}") for j in range(500)], KIND), f"{tmp_path}/i", 0)
    rows = index.postings(spark, f"{tmp_path}/i", spark.createDataFrame([("tag", "f3")], "kind string, feature string"))
    assert "PartitionFilters: [bucket" in rows._jdf.queryExecution().toString().replace("isnotnull(bucket#", "bucket") or len(rows.inputFiles()) < 64
    assert 1 <= rows.count() < 100


def test_gate(spark, tmp_path):
    root, runs = f"{tmp_path}/g", []

    def work(n):
        def run():
            runs.append(n)
            if n < 0:
                raise ValueError("no")
            return spark.createDataFrame([(n,)], "n long")

        return run

    ask = lambda n, inputs, queue, now: gated.gated(spark, root, inputs, queue, work(n), now, least_age=900).first().n
    assert ask(1, "a", "q", 0) == 1 and ask(2, "a", "q", 5000) == 1  # nothing changed
    assert ask(3, "b", "q", 800) == 1  # changed, but too young
    assert ask(4, "b", "r", 800) == 4  # another queue is worked out at once
    assert ask(5, "c", "r", 1800) == 5
    assert ask(-1, "d", "r", 9999) == 5  # a failure leaves what there is
    assert runs == [1, 4, 5, -1]
    with pytest.raises(ValueError):
        gated.gated(spark, f"{tmp_path}/new", "a", "q", work(-1), 0)
    keys = spark.createDataFrame([(2,), (1,), (2,)], "job long")
    assert gated.keys_of(keys, "job") == gated.keys_of(keys.distinct().orderBy("job"), "job") != gated.keys_of(keys.filter("job = 1"), "job")
    spark.range(3).write.parquet(f"{tmp_path}/x")
    before = gated.fingerprint(spark, f"{tmp_path}/x")
    assert before == gated.fingerprint(spark, f"{tmp_path}/x")
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/x")
    assert before != gated.fingerprint(spark, f"{tmp_path}/x")


def test_two_writers(spark, tmp_path):
    """The second writer commits while the first one merges: the first one merges again, and nothing is lost."""
    root, calls = f"{tmp_path}/s", []
    rows = lambda *r: spark.createDataFrame(r, "job long, a string, b string")
    commits.commit(spark, root, lambda now: rows((1, "x", "y")))

    def slow(now):
        calls.append(now.count())
        if len(calls) == 1:
            commits.commit(spark, root, lambda now: merge.merge_filled(now, rows((2, "p", "q"), (1, "", "z")), "job", ["a", "b"]))
        return merge.merge_filled(now, rows((1, "w", ""), (3, "n", "m")), "job", ["a", "b"])

    made = commits.commit(spark, root, slow)
    assert made["version"] == 3 and calls == [1, 2] and commits.versions(spark, root) == [1, 2, 3]
    assert sorted(map(tuple, commits.read(spark, root, made).collect())) == [(1, "w", "z"), (2, "p", "q"), (3, "n", "m")]
    assert not commits.create(spark, f"{root}/log/{3:012d}.json", "{}")

    def rude(now):
        commits.commit(spark, root, lambda now: now)
        return now

    with pytest.raises(RuntimeError):
        commits.commit(spark, root, rude, tries=2)


def test_respacing_like_a_plain_loop(spark):
    rng = random.Random(6)
    words = ["Flange", "mount", "W/", "C*", "(x)", r"\E", "$2", "Ä", "\U0001f600b", "a.b", "[", "mo"]

    def loop(value, page):
        at = [i for i, c in enumerate(page) if not c.isspace()]
        blob, out = "".join(page[i] for i in at), []
        for token in value.split():
            k = blob.find(token)
            out.append(token if k < 0 else " ".join(page[at[k] : at[k + len(token) - 1] + 1].split()))
        return " ".join(out)

    rows = []
    for _ in range(300):
        page = rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        value = "".join(rng.choice(words) + rng.choice(["", "", " ", "\t"]) for _ in range(rng.randint(0, 5)))
        rows.append((value, page))
    got = spark.createDataFrame(rows, "v string, p string").select(text.respaced(F.col("v"), F.col("p")).alias("r")).collect()
    assert [r.r for r in got] == [loop(*r) for r in rows]
    odd = spark.createDataFrame([(None, "a"), ("ab", None), ("", "a b")], "v string, p string").select(text.respaced(F.col("v"), F.col("p")).alias("r")).collect()
    assert [r.r for r in odd] == [None, "ab", ""]


def test_places_of_jobs(spark):
    listed = [("B", "421", "421303"), ("A", "421", "421303 ACME"), ("A", "421", "421303"), ("A", "999", "421034 ACME"), ("B", "OLD", "352366A"), ("B", "12", "12"), ("C", "421", "4213")]
    jobs = spark.createDataFrame([(j,) for j in ("421303", "421034", "352366A", "352366", "12", "7", "421303")], "job string")
    frame = spark.createDataFrame(listed, "type string, inter string, leaf string")
    got = {r.job: tuple(r)[1:] for r in folders.locate(jobs, frame).collect()}
    assert got == {"421303": ("A", "421303", "exact"), "421034": ("A", "421034 ACME", "swept"), "352366A": ("B", "352366A", "swept"), "352366": ("B", "352366A", "swept"), "12": ("B", "12", "exact")}
    assert {r.job for r in folders.locate(jobs, frame, deep=False).collect()} == {"421303", "12"}
    assert folders.locate(jobs.limit(0), frame).count() == 0


def test_facts_leave_noise_out(spark):
    rows = spark.sql("SELECT 'Wheel  parts' AS s, '' AS d, map('Size', ' 27 in', 'ship_to', 'X', 'a', null, 'b', 'marked') AS a UNION ALL SELECT 'Shipping', '', map('Size', '1') UNION ALL SELECT null, 'Review', map('Size', '1') UNION ALL SELECT null, null, null")
    got = [sorted(r.f) for r in rows.select(facts.item_facts(F.col("s"), F.col("d"), F.col("a")).alias("f")).collect()]
    assert got == [["SIZE=27 IN", "section=WHEEL PARTS"], [], [], []]
    assert all(re.search("|".join(facts.NOISE), w) for w in facts.NOISE)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_days_of_the_queue_are_summed_once_and_only_over_lines_due(spark):
    from orderloom.plans import catalog

    plan = lambda name: catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan("history_advance")
    union = plan("master_union")
    assert "LeftOuter" not in union and all("isnotnull(l_shipdate" in line for line in union.splitlines() if "Filter" in line and "l_shipdate" in line)
