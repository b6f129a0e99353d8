import hashlib
import random

from orderloom.llm import line_dedup as L

R = random.Random(5)


def line(n):
    return " ".join("".join(R.choices("abcdefg", k=6)) for _ in range(n))


def removed(spark, docs):
    out = L.without_repeats(spark.createDataFrame(docs, "doc_id long, text string, hash string, id int, n string").repartition(2))
    return {r.doc_id: list(r.removed_lines) for r in out.collect()}, out


def rows(texts):
    return [(i, t, "x", 1, None) for i, t in texts]




def test_passages(spark):
    long, parts, short = line(60), [line(9) for _ in range(6)], line(30)
    texts = [
        (1, "\n".join([line(5), long, line(7)])),
        (2, "\n".join([line(8), long, short, line(3)])),
        (3, "\n".join([line(4), *parts, line(6), short])),
        (4, "\n".join([*parts[:5], "", line(9), parts[5]])),
        (5, "\n".join([line(2), *parts[1:], line(50)])),
        (6, None), (7, ""), (8, "\n\n"), (9, short),
        (10, "\n".join([line(12), long, line(12), long])),
    ]
    got, out = removed(spark, rows(texts))
    assert got == {1: [], 2: [1], 3: [], 4: [0, 1, 2, 3, 4], 5: [1, 2, 3, 4, 5], 6: [], 7: [], 8: [], 9: [], 10: [1, 3]}
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[6] is None and text[8] == "\n\n" and text[4].split("\n") == ["", *texts[3][1].split("\n")[6:]] and long not in text[2]
    assert out.columns == ["doc_id", "text", "hash", "id", "n", "removed_lines"]


def test_copies_ties_and_repeats(spark):
    base = "\n".join(line(15) for _ in range(6))
    got, out = removed(spark, rows([(3, base), (2, base), (2, base), (None, base), (5, "\n".join(["again and again"] * 200))]))
    assert got == {2: [], 3: list(range(6)), None: list(range(6)), 5: list(range(1, 200))}
    assert out.count() == 5
    kept = L.deduplicated(spark.createDataFrame([(1, base), (2, base), (3, ""), (4, None)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == ["doc_id", "text"]
    assert removed(spark, rows([(1, "a")]))[0] == {1: []}
    assert L.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_long_passage_goes_and_nothing_is_lost(spark):
    pool = [[line(R.randint(1, 30)) for _ in range(R.randint(1, 6))] for _ in range(8)]
    pool = [p for p in pool if sum(len(x.split()) for x in p) >= 40]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(R.randint(1, 5)):
            parts += R.choice(pool) if R.random() < 0.4 else [line(R.randint(1, 25))]
        docs.append((i, "\n".join(parts)))
    got, _ = removed(spark, rows(docs))
    seen, lines_before = set(), set()
    for i, t in docs:
        lines = t.split("\n")
        for k in got[i]:
            assert lines[k] in lines_before or lines[k] in lines[:k]
        for p in pool:
            for k in range(len(lines) - len(p) + 1):
                if lines[k : k + len(p)] == p:
                    if tuple(p) in seen:
                        assert set(range(k, k + len(p))) <= set(got[i])
                    seen.add(tuple(p))
        lines_before |= set(lines)
    assert any(got.values())


def brute(docs, words=40):
    """Positions of lines in any earlier equal run of so many words, by comparing all runs."""
    runs, gone = {}, {i: set() for i, _ in docs}
    for i, t in sorted(docs):
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if x.split()]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[a:b])
                if sum(len(x.split()) for x in run) >= words and runs.setdefault(run, (i, a)) != (i, a):
                    gone[i] |= {k for k, _ in lines[a:b]}
    return {i: sorted(x) for i, x in gone.items()}


def test_passages_that_share_a_line_with_an_earlier_context(spark):
    """The first place of a shared line stands elsewhere; the copy that counts is a later one."""
    shared = line(25)
    docs = [(1, "\n".join([shared, line(25)])), (2, "\n".join([line(50), shared, passage := line(30)])), (3, "\n".join([line(50), shared, passage]))]
    got, _ = removed(spark, rows(docs))
    assert got == brute(docs) == {1: [], 2: [], 3: [1, 2]}


def test_any_earlier_equal_run_goes(spark):
    pool = [line(R.choice([1, 3, 8, 15, 25, 39, 40, 60])) for _ in range(9)] + ["", " "]
    docs = [(i, "\n".join(R.choices(pool, k=R.randint(1, 9)))) for i in range(80)]
    got, _ = removed(spark, rows(docs))
    assert got == brute(docs) and sum(map(len, got.values())) > 50


def test_fingerprints_are_few_and_meet_in_every_repeat(spark):
    """Selected positions are window minima, fewer than lines; every repeated run shares one with its earlier place."""
    passage = [line(R.randint(3, 12)) for _ in range(40)]
    texts = [(i, "\n".join([line(R.randint(3, 12)) for _ in range(30)] + passage[i : i + 25] + [line(8) for _ in range(20)])) for i in range(8)]
    rows_ = spark.createDataFrame([(i, i, t) for i, t in texts], "id long, tie long, body string")
    lines = L.lines_of(rows_)
    runs = L.runs_of(lines, L.RUN_WORDS).collect()
    marks = {(r.id, r.mark_pos) for r in runs}
    assert len(marks) < 0.5 * lines.count()
    hashes = {}
    for r in runs:
        hashes.setdefault(r.run, set()).add(r.mark)
        assert r.pos <= r.mark_pos <= r.last
    assert all(len(m) == 1 for m in hashes.values())
    got, _ = removed(spark, rows(texts))
    assert got == brute(texts)


def test_a_frequent_line_is_every_window_s_minimum(spark):
    """One line that all documents share, in other company each time: its fingerprint meets all of them, runs tell them apart."""
    often = min((line(20) for _ in range(200)), key=lambda x: hashlib.md5(x.encode()).hexdigest())
    copied = line(15)
    docs = [(i, "\n".join([line(15), often, line(15)])) for i in range(30)] + [(50, "\n".join([copied, often, line(3)])), (51, "\n".join([line(9), copied, often, copied]))]
    docs += [(60, "\n".join([line(30), copied, often])), (61, "\n".join([copied, copied, often, line(2), copied]))]
    got, _ = removed(spark, rows(docs))
    assert got == brute(docs)
