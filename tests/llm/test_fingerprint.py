import hashlib
import random

import numpy as np

from orderloom.llm import fingerprint as X


def mark(t):
    return X.fingerprint(np.frombuffer(t.encode(), np.uint8))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("ABCD", k=r.randint(0, 64))) for _ in range(2))
        assert X.common(a, b) == lcs(a, b)


def plain(data):
    """The signature by a loop over bytes."""
    n, h = len(data), []
    for i in range(n):
        v = sum((data[i - k] + 1) * pow(0x01000193, k, 1 << 32) for k in range(7) if i >= k) & 0xFFFFFFFF
        v ^= v >> 15
        v = v * 0x2C1B3C6D & 0xFFFFFFFF
        h.append(v ^ (v >> 13))
    block = 3
    while block * 64 < n:
        block *= 2
    while block > 3 and sum(x % block == block - 1 for x in h) + 1 < 32:
        block //= 2

    def sig(b, limit):
        ends = [i + 1 for i, x in enumerate(h) if x % b == b - 1][: limit - 1]
        ends += [n] if not ends or ends[-1] < n else []
        out, a = "", 0
        for e in ends:
            v = sum((data[a + j] + 1) * pow(X.ODD, j, 1 << 64) for j in range(e - a)) & (1 << 64) - 1
            v = (v ^ (v >> 31)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
            out += chr(X.ALPHABET[(v ^ (v >> 29)) >> 58])
            a = e
        return out

    return f"{block}:{sig(block, 64)}:{sig(2 * block, 32)}" if n else "3::"


def test_as_plain_loop(monkeypatch):
    r = random.Random(2)
    texts = ["", "a", "é", "aaaaaaaaaaaaaaaaaaaaaaa"] + ["".join(r.choices("abcde fgh\n", k=k)) for k in (10, 50, 200, 1000, 3000)]
    assert [mark(t) for t in texts] == [plain(t.encode()) for t in texts]
    monkeypatch.setattr(X, "PIECE", 100)
    assert [mark(t) for t in texts] == [plain(t.encode()) for t in texts]


DOCS = [(i, "".join(random.Random(i).choices("abcdefghij klmnop", k=30 * i))) for i in range(1, 40)] + [(100, None), (101, ""), (50, "é" * 10), (51, "x"), (-5, "y" * 100_000)]


def brute(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), mark(t), mark(e), X.likeness(mark(t), mark(e)), X.likeness(mark(t), mark(u))))
    return sorted(out)


def test_edits(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in DOCS], "doc_id long, text string, range string, id string").repartition(3)
    assert sorted(map(tuple, X.edits(docs).collect())) == brute(DOCS)
    whole = X.beside_next
    monkeypatch.setattr(X, "beside_next", lambda d, i, t: whole(d, i, t, rows_per_range=3))
    assert sorted(map(tuple, X.edits(docs).collect())) == brute(DOCS)
    assert X.edits(docs.limit(0)).count() == 0
    one = docs.filter("doc_id = 7")
    assert [r.near_next for r in X.edits(one).collect()] == [1.0]
    nulls = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a"), (None, "c")], "doc_id long, text string")
    assert X.edits(nulls).count() == 4
    assert X.fingerprints(docs).filter("fingerprint = '3::'").count() == 2


def test_likeness_tells_copies_from_others():
    near = [r[5] for r in brute(DOCS) if r[1] > 200]
    other = [r[6] for r in brute(DOCS) if r[1] > 200]
    assert min(near) > 0.3 and max(other) < 0.5 and all(0 <= x <= 1 for x in near + other)
