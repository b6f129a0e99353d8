"""Mixes against plain arithmetic in order of the keys, budgets met to the word, and odd tables."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from orderloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def shares(sizes):
    """Targets by resharing again and again, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, open_, left = dict.fromkeys(names, Fraction(0)), set(names), Fraction(3, 2) * sum(sizes.values())
    while left and open_:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            out[s] += left * weight[s] / whole
        left = sum(max(Fraction(0), out[s] - 2 * sizes[s]) for s in open_)
        for s in list(open_):
            if out[s] >= 2 * sizes[s]:
                out[s] = Fraction(2 * sizes[s])
                open_.discard(s)
    return out


def made(rng, n, sources):
    return [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(sources)) for i in range(n)]


def check(spark, rows):
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    want, got = shares(total), mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda i: (int(hashlib.md5(f"0:{'' if i is None else i}".encode()).hexdigest()[:15], 16), i)
    assert len(got) == len(rows)
    taken = {r.id: r.epochs * r["size"] + r.part for r in got}
    for s in total:
        own = sorted((r[0] for r in rows if r[2] == s), key=key)
        budget = int(want[s] + Fraction(1, 2))
        assert sum(taken[i] for i in own) == budget
        left = budget % total[s] if total[s] else 0
        for i in own:
            part = min(size[i], left)
            assert taken[i] == (budget // total[s] * size[i] if total[s] else 0) + part <= 2 * size[i]
            left -= part
    for r in got:
        assert r.source_size == total[r.source] and abs(r.target - float(want[r.source])) < 1e-6 and r["size"] == size[r.id]


def test_like_plain_arithmetic(spark):
    rng = random.Random(3)
    check(spark, made(rng, 400, ["a", "b", "c", "d", "e", None, ""]))
    check(spark, made(rng, 400, ["hot"] * 40 + ["é", "z", "Z", "\U0001f600", "￮"]))
    check(spark, made(rng, 30, ["one"]))


def test_nulls_empties_and_repeats(spark):
    rows = [(None, None, None), (1, "", "a"), (2, "x y z", "a"), (3, " \t ", None)]
    check(spark, rows)
    same = spark.createDataFrame([(1, "x y z", "a")] * 50 + [(2, "q r", "b")], SCHEMA)
    found = mixing.mix(same).collect()
    assert sum(r.epochs * r["size"] + r.part for r in found if r.source == "a") == int(found[0].target + 0.5) if found[0].source == "a" else True
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.target for r in mixing.mix(spark.createDataFrame([(1, None, "a")], SCHEMA)).collect()} == {0.0}


def test_the_mix_itself(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame(made(rng, 200, ["a", "b", "b", "b", None]), SCHEMA).withColumns({"size": F.lit("kept"), "part": F.lit(1), "id": F.lit(2)})
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "epoch"]
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\s]+', 0)"))).alias("n")).collect()}
    plan = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.expr("epochs * size + part")).alias("n")).collect()}
    assert words == plan
    given = {r.doc_id: r.text for r in docs.collect()}
    assert all(given[r.doc_id].startswith(r.text) for r in out.collect())


def test_long_text_cut_at_the_budget(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, "a"), (2, "x", "b"), (3, "y", "c")], SCHEMA)
    out = mixing.mixed(docs).filter("doc_id = 1").orderBy("epoch").collect()
    plan = mixing.mix(docs).filter("id = 1").first()
    assert [len(r.text.split()) for r in out] == [300_000] * plan.epochs + [plan.part] * (plan.part > 0)


def test_runs_agree(spark):
    docs = spark.createDataFrame(made(random.Random(4), 300, ["a", "b", None]), SCHEMA)
    once, again = mixing.mix(docs), mixing.mix(docs.repartition(7))
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
