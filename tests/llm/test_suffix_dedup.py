import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from orderloom.llm import suffix_dedup as S

R = random.Random(6)


def noise(n):
    return "".join(R.choices("abcdefgh éß", k=n))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)) | st.integers(0, 60).map(lambda n: b"ab" * n), min_size=1, max_size=40))
def test_order(texts):
    order, common = S.suffix_order(texts, 0)
    assert [texts[i] for i in order] == sorted(texts) and sorted(order.tolist()) == list(range(len(texts)))
    for a, b, lcp in zip(order, order[1:], common[1:]):
        x, y = texts[a], texts[b]
        assert lcp == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_anchors_follow_content(monkeypatch):
    data = np.frombuffer(noise(6000).encode(), np.uint8)
    p, a, b, gram, run = S.anchors(data)
    assert a[0] == 0 and b[-1] == len(data) - S.SHORT and (a[1:] == b[:-1] + 1).all() and (p >= b).all() and (p - a <= S.SPAN - 1).all()
    shifted = S.anchors(data[777:])
    whole = {(g, r) for g, r, x in zip(gram, run, a) if x >= 777}
    assert len(whole - set(zip(shifted[3], shifted[4]))) <= 1
    monkeypatch.setattr(S, "PIECE", 1000)
    again = S.anchors(data)
    assert set(zip(p, gram)) == set(zip(again[0], again[3])) and (np.diff(again[1]) > 0).all()


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = {n: Counter(t[k : k + n] for t in texts for k in range(len(t) - n + 1)) for n in (256, 400)}
    out = []
    for (i, _), t in zip(rows, texts):
        short, gone = bytearray(len(t)), bytearray(len(t))
        for n, covered in ((256, short), (400, gone)):
            for k in range(len(t) - n + 1):
                if seen[n][t[k : k + n]] > 1:
                    covered[k : k + n] = b"\x01" * n
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, sum(short), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def corpus():
    passages = [noise(n) for n in (170, 200, 240, 257, 330, 395, 401, 420, 700, 1500)]
    rows, n = [], 0
    for _ in range(40):
        parts = [noise(R.randint(0, 300))]
        for _ in range(R.randint(0, 3)):
            q = R.choice(passages)
            if R.random() < 0.4:
                k = R.randint(0, len(q))
                q = q[:k] + "#" + q[k:]
            if R.random() < 0.3:
                q = q[R.randint(0, 200) :]
            parts += [q, noise(R.randint(0, 300))]
        rows.append(((n := n + 3), "".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "a" * 1000), (505, "ab" * 300), (506, noise(400)), (None, passages[4]), (507, noise(3000) * 2), (508, "a" * 401), (509, "q" * 400)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, tie string, p int").repartition(3)
    want = brute(rows)
    assert sum(r[2] for r in want) > 10_000
    for group in (0, 2, 5):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.n_repeated, bytes(r.kept)) for r in S.without_repeats(docs, group=group).collect()]
        assert sorted(got, key=repr) == want
    assert S.without_repeats(docs.limit(0)).count() == 0
