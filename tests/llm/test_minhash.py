import random
import re

import numpy as np

from orderloom.llm import minhash as M

R = random.Random(8)
VOCAB = ["".join(R.choices("abcdefgh", k=5)) for _ in range(4000)]


def words(n):
    return [R.choice(VOCAB) for _ in range(n)]


def edited(w, k):
    w = list(w)
    for _ in range(k):
        w[R.randrange(len(w))] = R.choice(VOCAB)
    return w


def shingles(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus():
    docs, n = [], 1000
    for size in (60, 150, 400):
        base = words(size)
        for k in (0, 0, 0, 1, 1, 2, 2, 3, 5, 8):
            for _ in range(3):
                docs.append((n := n + R.randint(1, 5), " ".join(edited(base, k * size // 60))))
    chain = words(120)
    for _ in range(12):
        docs.append((n := n + 1, " ".join(chain)))
        chain = edited(chain, 2)
    docs += [(1, "A b"), (2, "a  B\n"), (3, "a b c"), (4, None), (5, ""), (6, " \t"), (7, "é x y z w v"), (8, "É x y z w v"), (9, " ".join(words(30_000))), (10, "spam " * 500), (11, "spam " * 90)]
    docs += [(n + k, " ".join(words(R.randint(1, 60)))) for k in range(1, 80)]
    return docs


def test_components_against_all_pairs(spark):
    docs = corpus()
    R.shuffle(docs)
    frame = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, id string, n int").repartition(5)
    assert sorted(map(tuple, M.linked(frame).collect())) == brute(docs)
    kept = M.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [r[0] for r in brute(docs) if r[3]]


def test_edges(spark):
    assert M.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "one two three four five six"
    docs = spark.createDataFrame([(5, t), (5, t), (7, t), (None, t), (7, "other text"), (8, "other text"), (9, None)], "doc_id long, text string")
    got = sorted(map(repr, map(tuple, M.linked(docs).collect())))
    assert len(got) == 7 and got.count(repr((5, 2, 5, True))) == 2 and repr((None, 2, None, True)) in got and repr((9, 0, 9, True)) in got
    assert {r.doc_id for r in M.one_of_each(docs).collect()} >= {None, 5, 9}


def test_min_max_estimates():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(251, 1251, dtype=np.uint64)
    x, y = (M.mixed(v * np.uint64(M.ODD)) for v in (a, b))
    got = np.mean([(M.signature(M.mixed(x + np.uint64(s))) == M.signature(M.mixed(y + np.uint64(s)))).mean() for s in range(40)])
    assert abs(got - 0.6) < 0.03


def test_connected_components(spark):
    edges = [(R.randrange(300), R.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    root = {i: i for i in range(450)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = M.components(spark.createDataFrame(edges, "a long, b long"), spark.range(450))
    assert {r.id: r.comp for r in got.collect()} == {i: find(i) for i in range(450)}


def test_bands_of_small_sets_agree_as_independent_values_do():
    """Sets that share 3 of 4 shingles: a band's four values agree with probability 0.75 ** 4, not 0.5 ** 2."""
    sets = np.sort(np.random.default_rng(3).integers(0, 1 << 63, (2000, 4)).astype(np.uint64), 1)
    rate = np.mean([M.bands(x) == M.bands(np.delete(x, k % 4)) for k, x in enumerate(sets)])
    assert abs(rate - 0.75**4) < 0.02
