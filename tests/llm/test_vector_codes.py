"""Codes and codebooks against plain Lloyd rounds, and the stated results for odd vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from orderloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, entries=256, rounds=4):
    """rows: (id, vector) in order of ids. codes, errors, codebooks."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) for c in v] for _, v in rows], np.int64)
    parts = np.split(x, 4, axis=1)
    books = [p[:entries].copy() for p in parts]
    near = lambda p, b: ((p[:, None, :] - b[None]) ** 2).sum(2)
    for _ in range(rounds):
        for k, p in enumerate(parts):
            a = near(p, books[k]).argmin(1)
            for e in np.unique(a):
                books[k][e] = p[a == e].sum(0) // (a == e).sum()
    dist = [near(p, b) for p, b in zip(parts, books)]
    codes = ["".join(f"{d[i].argmin():02x}" for d in dist) for i in range(len(x))]
    return codes, [int(sum(d[i].min() for d in dist)) for i in range(len(x))], np.stack(books)


@pytest.mark.parametrize("n, width, entries, kind", [(900, 4, 256, "blobs"), (700, 2, 100, "grid"), (300, 3, 256, "same"), (5, 1, 256, "blobs"), (400, 4, 7, "far")])
def test_like_plain_rounds(spark, monkeypatch, n, width, entries, kind):
    monkeypatch.setattr(V, "BLOCK", 200 * 4 * width)
    rng = np.random.default_rng(n)
    v = {
        "blobs": lambda: rng.normal(size=(30, 4 * width))[rng.integers(0, 30, n)] + 0.05 * rng.normal(size=(n, 4 * width)),
        "grid": lambda: rng.integers(-2, 3, (n, 4 * width)) / 1024,
        "same": lambda: np.where(rng.random((n, 1)) < 0.5, 0.25, rng.random((n, 4 * width))),
        "far": lambda: rng.normal(size=(n, 4 * width)) * 30_000,
    }[kind]().astype(np.float32)
    rows = [(i * 3, v[i].tolist(), i % 4) for i in range(n)]
    random.Random(1).shuffle(rows)
    found, books = V.compressed(spark.createDataFrame(rows, SCHEMA), entries=entries)
    codes, errors, want = plain(sorted((r[0], r[1]) for r in rows), entries)
    assert np.array_equal(books, want) and V.digest(books) == hashlib.sha256(",".join(str(int(c)) for c in want.ravel()).encode()).hexdigest()
    assert [(r.code, r.error) for r in sorted(found.collect())] == list(zip(codes, errors))


def test_tree_prunes_and_assigns_whole_nodes():
    rng = np.random.default_rng(2)
    points = (rng.normal(size=(16, 4))[rng.integers(0, 16, 4000)] * 5000 + rng.normal(size=(4000, 4))).astype(np.int32)
    points = points[V.tree_order(points, V.LEAF)]
    entries = points[:: 4000 // 40][:40].astype(np.int64)
    entry, whole = V.assign(V.Codebook(entries), points)
    near = ((points.astype(np.int64)[:, None] - entries[None]) ** 2).sum(2)
    assert np.array_equal(near.argmin(1), entry)
    sums, counts = V.sums_of(points, entry, whole, 40)
    assert counts.sum() == 4000 and all(np.array_equal(sums[e], points[entry == e].astype(np.int64).sum(0)) for e in range(40))
    lone = np.zeros((500, 4), np.int32)  # equal points: one node, one distance
    assert V.assign(V.Codebook(np.array([[3, 0, 0, 0], [0, 0, 0, 1]])), lone)[1] == [(0, 500, 1)] or V.assign(V.Codebook(np.array([[3, 0, 0, 0], [0, 0, 0, 1]])), lone)[0].tolist() == [1] * 500


def test_nulls_odd_lengths_ties_and_huge_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.0] * 8, None), (5, [0.0] * 8, None), (1, [1.0] * 8, 2), (None, [0.5] * 8, 2), (2, None, 1), (3, [nan] * 8, 1), (4, [inf] + [0.0] * 7, 1), (6, [None] + [0.0] * 7, 1), (7, [], 1), (8, [1.0] * 4, 1), (9, [3e38] * 8, 1)]
    found, books = V.compressed(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r.id is None, r.id or 0, r.code, r.error) for r in found.collect() if r.code)
    assert got == [(False, 1, "00000000", 0), (False, 5, "01010101", 0), (False, 5, "01010101", 0), (False, 9, "03030303", 0), (True, 0, "04040404", 0)]
    assert sorted(r.id for r in found.collect() if r.code is None) == [7, 8]
    none, books = V.compressed(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and books.size == 0
    totals = V.with_totals(found, "label", "error", "label_error", found["id"]).collect()
    assert len(totals) == 7
    wide = spark.createDataFrame([(1, [1.0] * 8, 2, "x", 3)], SCHEMA + ", code string, error int")
    assert V.compressed(wide)[0].first().code == "00000000"


def test_label_totals(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5, i) for i in range(500)], "id long, label int, error long")
    want = {}
    for i in range(500):
        key = None if i % 3 == 0 else i % 5
        want[key] = want.get(key, 0) + i
    got = V.with_totals(rows, "label", "error", "label_error", rows["id"]).collect()
    assert len(got) == 500 and all(r.label_error == want[r.label] for r in got)


def test_decoding_is_near(spark):
    rng = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(300)], SCHEMA)
    found, books = V.compressed(docs)
    back = {r.id: r.vector for r in V.decoded(found, books).collect()}
    error = {r.id: r.error for r in found.collect()}
    for r in docs.collect():
        assert sum((1024 * (a - b)) ** 2 for a, b in zip(r.embedding, back[r.vec_id])) <= error[r.vec_id] + 8 * math.sqrt(error[r.vec_id]) + 8
