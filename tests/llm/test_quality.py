import math
import random

import numpy as np

from orderloom.llm import quality as Q

R = random.Random(3)
WORDS = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n)).capitalize() + "."


def junk(n):
    return " ".join(R.choice(WORDS).upper() + "!!" for _ in range(n))


DOCS = [(i, prose(30 + i % 50) if i % 3 else junk(30)) for i in range(400)]


def test_grams_against_plain_loop():
    texts = ["", "  ", "Ab AB!! ab", "x", "aa\n\nB1 é", "IT!! IT!!"]
    joined = "".join(texts).encode()
    starts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    kinds = list(Q.columns(np.frombuffer(joined, np.uint8), starts))
    counts = [[int(b[i + 1] - b[i]) for _, b in kinds] for i in range(len(texts))]
    assert counts == [[len(w), len(w), max(0, len(w) - 1), max(0, len(w) - 2), max(0, len(w) - 1)] for w in (t.split() for t in texts)]
    alone = [[c.tolist() for c, _ in Q.columns(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))] for t in texts]
    assert alone == [[c[b[i] : b[i + 1]].tolist() for c, b in kinds] for i in range(len(texts))]
    assert alone[2][1][0] != alone[2][1][1] and alone[5][0][0] == alone[5][0][1] and alone[5][1][0] == alone[2][1][1]


def test_updates_against_formula():
    m = Q.Ftrl(0.5, 1.0, 0.1, 0.2)
    z, n, w = 0.0, 0.0, 0.0
    for label in (1, 0, 1, 1):
        w = 0 if abs(z) <= 0.1 else -(z - math.copysign(0.1, z)) / ((1 + math.sqrt(n)) / 0.5 + 0.2)
        g = (1 / (1 + math.exp(-2 * w)) - label) * 2
        z += g - (math.sqrt(n + g * g) - math.sqrt(n)) / 0.5 * w
        n += g * g
        m.learn(np.array([7]), np.array([2.0]), label)
    assert math.isclose(m.z[7], z) and math.isclose(m.n[7], n)


def test_training_against_a_plain_loop(spark):
    """Four shards, each by rank of the id, three passes over plain dictionaries; weights averaged by rows."""
    rows = DOCS[:60]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    rank = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    total, n = {}, 0
    for shard in range(4):
        own = sorted((rank[i], t, int(i % 3 > 0)) for i, t in rows if rank[i] % 4 == shard)
        z, sq, w = {}, {}, lambda k: 0.0 if k != "b" and abs(z.get(k, 0.0)) <= 0.01 else -(z.get(k, 0.0) - (math.copysign(0.01, z[k]) if k != "b" else 0.0)) / ((1 + math.sqrt(sq[k])) / 0.3 + (0.1 if k != "b" else 0.0)) if k in z else 0.0  # noqa: B023
        for _ in range(3):
            for _, t, label in own:
                kinds = [c for c, _ in Q.columns(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))]
                x = {"b": 1.0}
                for c in kinds:
                    for k in c.tolist():
                        x[k] = x.get(k, 0.0) + Q.SCALE / len(c)
                now = {k: w(k) for k in x}
                p = 1 / (1 + math.exp(-sum(now[k] * v for k, v in x.items())))
                for k, v in x.items():
                    g = (p - label) * v
                    z[k] = z.get(k, 0.0) + g - (math.sqrt(sq.get(k, 0.0) + g * g) - math.sqrt(sq.get(k, 0.0))) / 0.3 * now[k]
                    sq[k] = sq.get(k, 0.0) + g * g
        for k in z:
            total[k] = total.get(k, 0.0) + len(own) * w(k)
        n += len(own)
    weights, bias = Q.train(docs, labels)
    assert math.isclose(bias, total["b"] / n, rel_tol=1e-4) and all(math.isclose(weights[k], v / n, rel_tol=1e-3, abs_tol=1e-4) for k, v in total.items() if k != "b")
    assert set(np.flatnonzero(weights)) <= set(total)


def test_held_out_accuracy_and_edges(spark):
    rows = [(i, t, "x", 0.5) for i, t in DOCS] + [(900, None, None, None), (901, "", "x", 0.1), (None, "A b", "x", 0.1), (902, "Word " * 60_000, "x", 0.0), (1, DOCS[1][1], "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(1, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    got = {r.doc_id: r.score for r in Q.scored(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert sum((got[i] >= 0.3) == (i % 3 > 0) for i in range(200, 400)) >= 195
    kept = Q.good(docs, labels, docs)
    assert kept.columns == docs.columns and kept.filter("doc_id < 400 and doc_id % 3 = 0").count() < 8
    assert Q.scored(docs.limit(0), model).count() == 0
    few = Q.train(docs, labels, max_bytes=4000)
    assert few[0].any() and (few[0] != model[0]).any() and not Q.train(docs, labels, max_bytes=0)[0].any()
    w, b = Q.train(docs, labels.limit(0))
    assert not w.any() and b == 0
