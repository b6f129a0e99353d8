import math
import os
import random
import zlib
from collections import Counter

import numpy as np

from orderloom.llm import lattice_lm as L

R = random.Random(4)
SF = "/root/testdata/sf0.001"
PIECES = [(p.encode(), o, w) for p, o, w in [("a", True, 1.0), ("ab", True, 2.0), ("b", False, 1.0), ("ba", False, 0.5), ("c", False, 1.0), ("abc", True, 0.2), ("bc", False, 3.0), ("é", True, 0.7)]]
V = L.Vocabulary(PIECES)


def paths(word, vocabulary=V):
    """All segmentations: (pieces, log weight), by recursion."""
    by = {}
    for node, i in enumerate(vocabulary.piece):
        if i >= 0:
            by[node] = i
    edges = {(int(k) >> 8, int(k) & 255): int(t) for k, t in zip(vocabulary.keys, vocabulary.to)}

    def walk(at):
        if at == len(word):
            yield (), vocabulary.weights[-1]
            return
        node = 0 if at == 0 else 1
        for j in range(at, len(word)):
            node = edges.get((node, word[j]))
            if node is None:
                return
            if node in by:
                for rest, w in walk(j + 1):
                    yield (by[node], *rest), w + vocabulary.weights[by[node]]

    return list(walk(0))


def test_marginals_and_expected_counts_by_enumeration():
    words = [b"abc", b"a", "é".encode(), b"ababcbc", b"zzz", b"cab" * 2]
    got = L.word_scores(words, V, V.weights)
    want_counts = np.zeros(len(V.weights))
    for word, score in zip(words, got):
        all_paths = paths(word)
        total = math.log(sum(math.exp(w) for _, w in all_paths))
        assert math.isclose(score, total, rel_tol=1e-9)
        for pieces, w in all_paths:
            for p in (*pieces, -1):
                want_counts[p] += math.exp(w - total)
    assert np.allclose(L.expected_counts(words, V, V.weights, np.ones(len(words))), want_counts)
    assert np.allclose(L.expected_counts(words + words[:2], V, V.weights, np.array([1, 2, 1, 1, 3, 1, 4, 5])), L.expected_counts(words, V, V.weights, np.array([5, 7, 1, 1, 3, 1])))


def test_weights_are_probabilities():
    for w in (V.weights, V.moved(L.expected_counts([b"abc", b"abab"], V, V.weights, np.array([1, 2])), 10.0)):
        assert math.isclose(np.exp(w[V.opens]).sum(), 1) and math.isclose(np.exp(w[~V.opens]).sum(), 1)
    two = [bytes([a, b]) for a in range(256) for b in range(256)]
    one = [bytes([a]) for a in range(256)]
    assert np.exp(L.word_scores(two, V, V.weights)).sum() + np.exp(L.word_scores(one, V, V.weights)).sum() < 1


def discount(c):
    one, two = (sum(x == k for x in c.values()) for k in (1, 2))
    return one / (one + 2 * two) if one and two else 0.5


def brute(rows, vocabulary, classes=None):
    """rows: (id, text, class)"""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(i, lower(t).encode().split(), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, k) for i, t, k in rows]
    train = [d for d in docs if not d[2]]
    c = Counter(w for d in train for w in d[1])
    ends = len(train)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    weights = vocabulary.weights
    for _ in range(2):
        weights = vocabulary.moved(L.expected_counts(sorted(c), vocabulary, weights, np.array([c[w] for w in sorted(c)], float)), 100.0)
    every = sorted({w for d in docs for w in d[1]})
    logs = dict(zip(every, L.word_scores(every, vocabulary, weights))) if every else {}
    sub = dict(zip(every, np.exp(L.word_scores(every, vocabulary, weights)) if every else []))
    p = {w: (max(c[w] - discount(c), 0) + discount(c) * len(c) * sub[w]) / n if n else sub[w] / 2 for w in every}
    models = []
    for k in classes or [None]:
        own = [d for d in train if not classes or d[3] == k]
        cz = Counter(w for d in own for w in d[1])
        nz = sum(cz.values()) + len(own)
        pz = {w: (max(cz[w] - discount(cz), 0) + discount(cz) * len(cz) * p[w] * n / (n - ends)) / nz if cz else p[w] for w in every}
        models.append((len(own) / max(1, ends) if n else 1.0, pz, len(own) / nz if nz else 0.5))
    out = []
    for i, ws, held, _ in docs:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        ways = [math.log10(share) + math.log10(e) + sum(math.log10(pz[w]) for w in ws) for share, pz, e in models if share]
        score = max(ways) + math.log10(sum(10 ** (x - max(ways)) for x in ways))
        lattice = sum(logs[w] / math.log(10) + math.log10((n - ends) / n if n > ends else 0.5) for w in ws) + math.log10(ends / n if ends else 0.5)
        out.append((i, held, len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, base, lattice, score))
    return out


def same(got, want):
    key = lambda r: (repr(r[0]), r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-12) and math.isclose(g[6], w[6], rel_tol=1e-5) and math.isclose(g[7], w[7], rel_tol=1e-5)


def test_scores_against_brute_force(spark, monkeypatch):
    vocab = ["".join(R.choices("abcé", k=R.randint(1, 7))) for _ in range(60)]
    rows = [(i, " ".join(R.choice(vocab[:40] if i % 3 else vocab[20:]) if R.random() < 0.9 else "".join(R.choices("abcxyz", k=6)) for _ in range(R.randint(0, 40))), "xy"[i % 3 > 0]) for i in range(80)]
    rows += [(200, None, "x"), (None, "A b\tc\n", None), (3, rows[3][1], "y"), (201, "x" * 3000, "y"), (202, "ab " * 20_000, "z")]
    docs = spark.createDataFrame([(i, t, k, 1) for i, t, k in rows], "doc_id long, text string, word string, block int").repartition(3)
    want, by_class = brute(rows, V), brute(rows, V, [None, "x", "y", "z"])
    same([tuple(r) for r in L.scored(docs, V).collect()], want)
    same([tuple(r) for r in L.scored(docs, V, class_col="word").collect()], by_class)
    monkeypatch.setattr(L, "BLOCK_BYTES", 300)
    monkeypatch.setattr(L, "ENTRIES_AT_ONCE", 50)
    same([tuple(r) for r in L.scored(docs, V, class_col="word").collect()], by_class)
    monkeypatch.setattr(L, "BLOCKS_A_ROW", 3)
    same([tuple(r) for r in L.scored(docs, V, class_col="word").collect()], by_class)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.scored(empty, V, class_col="lang").count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "abc é", "x") for i in held]
    same([tuple(r) for r in L.scored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), V, class_col="lang").collect()], brute(rows, V))
    rows = [(i, None, "x") for i in range(9)]
    same([tuple(r) for r in L.scored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), V, class_col="lang").collect()], brute(rows, V))


def test_held_out_texts_against_a_law_of_bytes(spark):
    """On held-out documents the lattice beats a byte unigram with an end of word, normalised as it is; whole words help further."""
    if not os.path.isdir(SF):
        return
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in L.op1_lattice_lm(spark, SF).collect()}
    words = {i: [w + b" " for w in t.encode().lower().split()] for i, t in rows}
    counts = Counter(b for i, ws in words.items() if not got[i].held_out for w in ws for b in w)
    total = sum(counts.values()) + 256
    held = [i for i in words if got[i].held_out]
    tokens = sum(len(words[i]) for i in held)
    n, ends = got[held[0]].train_tokens, sum(not r.held_out for r in got.values())
    bytes_law = sum(math.log10((counts[b] + 1) / total) for i in held for w in words[i] for b in w) + tokens * math.log10((n - ends) / n) + len(held) * math.log10(ends / n)
    assert sum(got[i].mixed_score for i in held) > sum(got[i].score for i in held) > bytes_law + 0.3 * tokens


def test_long_words_in_windows(monkeypatch):
    """Words taken alone, in windows shorter than their pieces, have the sums and counts of the same words in grids."""
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(list(b"abc"), n)) for n in (1, 2, 4, 5, 6, 9, 17, 40)]
    scores, counts = L.word_scores(words, V, V.weights), L.expected_counts(words, V, V.weights, np.arange(1.0, 9.0))
    for window in (1, 3, 5, 64):
        monkeypatch.setattr(L, "LONG", 3)
        monkeypatch.setattr(L, "WINDOW", window)
        assert np.allclose(L.word_scores(words, V, V.weights), scores) and np.allclose(L.expected_counts(words, V, V.weights, np.arange(1.0, 9.0)), counts)


def test_a_text_of_two_megabytes_without_blanks():
    import time
    import tracemalloc

    word = b"abcab" * 400_000
    began = time.process_time()
    score = L.word_scores([word], V, V.weights)[0]
    assert time.process_time() - began < 20 and np.isfinite(score)
    tracemalloc.start()
    L.word_scores([word[:500_000]], V, V.weights)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
