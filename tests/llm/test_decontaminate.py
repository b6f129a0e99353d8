import re

from orderloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ALPHA = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
ITEMS = [(1, " ".join(ALPHA[:14])), (2, "Q, Q q"), (3, None), (4, "!!"), (5, "q q q"), (10, " ".join(ALPHA[3:18])), (11, "É x y")]
DOCS = [
    (1, "x " + " ".join(ALPHA) + " end"), (2, None), (3, ""), (4, "Q-q-Q-q " + "z1 " * 50), (5, " ".join(ALPHA[:13])), (6, "é x y"), (7, "É X Y"),
    (5, " ".join(ALPHA[:13])), (None, "q q q"), (8, ("w " * 3000) + " ".join(ALPHA[:13])), (9, " ".join(ALPHA[:12])),
]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text, width=13):
    w, hit, items = WORD.findall(lower(text)), set(), set()
    for i, t in ITEMS:
        v = WORD.findall(lower(t))
        n = min(width, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit |= set(range(p, p + n))
                    items.add(str(i))
    return len(w), len(hit), sorted(items)


def check(spark):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in DOCS], "doc_id long, text string, contamination string, items int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    out = D.overlap(docs.drop("contamination"), bench)
    got = sorted(((r.doc_id, r.text, *r.contamination) for r in out.collect()), key=repr)
    assert got == sorted(((i, t, *brute(t)) for i, t in DOCS), key=repr)
    assert D.overlap(docs, bench.limit(0)).filter("contamination.n_hit > 0").count() == 0
    assert D.overlap(docs.limit(0), bench).count() == 0
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, t in DOCS if not (brute(t)[1] and 20 * brute(t)[1] >= brute(t)[0])), key=repr)


def test_against_brute_force(spark):
    check(spark)


def test_in_slices(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE_BYTES", 30)
    check(spark)
