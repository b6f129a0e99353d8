import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orderloom.llm import sanitise as S

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and S.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                found.append((kind, *m.span()))
    return found


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("01259.@-+ ()aZ_é%"), max_size=60))
def test_base_spans_as_patterns(text):
    assert S.base_spans(text) == brute(text)


def test_known_spans():
    t = "x a.b@c.de, 1.2.3.4 256.1.1.1 or 4111 1111 1111 1111 +49 (30) 123-4567 y@z"
    assert S.base_spans(t) == brute(t) and len(S.base_spans(t)) == 4


ROWS = [(i, f"word{'abc'[i % 3]} other thing zorblat {'blue' if i % 2 else 'green'} {'xyz'[i % 3]}rest write to kim@mail.example.org about {['rain', 'snow', 'wind', 'hail', 'fog', 'mist'][i]} days", "en") for i in range(6)]
ROWS += [(10 + i, f"the other thing about days and {w} write to rest", "en") for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())]
ROWS += [(90, None, None), (91, "", "x"), (None, "1.2.3.4", "x"), (91, "", "x"), (92, "ünder a@b.c zorblat " + "y" * 50_000, "x")]


def table(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, spans string")


def test_terms_that_reveal_are_found(spark):
    got = {r.term: r.disclosure for r in S.disclosures(table(spark), level=1.0, generalise_at=0.0).collect() if r.value.startswith("email:kim")}
    n, n_e = len(ROWS), 6
    from math import isclose, log

    assert isclose(got["zorblat"], log(n * 6 / (7 * n_e)) / log(n / n_e))
    assert isclose(got["write"], log(n * 6 / (16 * n_e)) / log(n / n_e))


def test_rows(spark):
    out = S.sanitise(table(spark), level=1.0, generalise_at=0.8, remove_at=0.99)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ROWS)
    assert any(s.kind == "term" and ROWS[0][1][s.start : s.end] == "zorblat" for s in rows[0].spans)
    assert "zorblat" not in rows[0].sanitised and "[email]" in rows[0].sanitised and rows[90].spans == [] and rows[90].sanitised == ""
    for i, text, _ in ROWS:
        assert [tuple(s) for s in rows[i].spans if s.kind != "term"] == brute(text or "")
    assert S.digests(out).filter("doc_id = 92").first().n_term >= 1
    assert S.sanitise(table(spark).limit(0)).count() == 0


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    ways = {"level": 1.0, "generalise_at": 0.2, "remove_at": 0.9}
    whole = sorted(map(repr, S.sanitise(table(spark), **ways).collect()))
    monkeypatch.setattr(S, "BITS", 3)
    assert sorted(map(repr, S.sanitise(table(spark), **ways).collect())) == whole


def tailed(r, n):
    """Words by Zipf's law over a vocabulary without end: a fifth stand once or twice in a corpus."""
    return " ".join(f"w{''.join(chr(97 + int(d)) for d in str(int(r.paretovariate(0.7) * 3)))}" for _ in range(n))


@pytest.mark.parametrize("n", [2_000, 30_000])
def test_planted_names_among_filler_with_rare_words(spark, n):
    """Names that stand beside one address in two contexts or more are found, those met once are left alone, and no word of the
    filler is flagged, with copies and edited copies of passages among it, at either size."""
    r = random.Random(9)
    names = [f"surname{c}{d}" for c in "abcde" for d in "uvwxyz"]
    docs = [(i, tailed(r, 40)) for i in range(n)]
    for k, name in enumerate(names):
        for j in range(1 + k % 4):
            docs.append((n + 10 * k + j, f"{tailed(r, 20)} {name.capitalize()} n{k}@mail.example.org {tailed(r, 20)}"))
    for k in range(n // 20):  # addresses in filler; every other in a copy too, with one word changed
        words = f"{tailed(r, 15)} x{k}@mail.example.org {tailed(r, 15)}".split()
        docs.append((n + 1000 + 2 * k, " ".join(words)))
        if k % 2:
            words[r.randrange(15)] = "changed"
            docs.append((n + 1001 + 2 * k, " ".join(words)))
    often = {x for k, x in enumerate(names) if k % 4}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.term for x in S.disclosures(frame).collect()} == often
    if n < 10_000:
        out = {x.doc_id: x for x in S.sanitise(frame).collect()}
        assert len(out) == len(docs)
        for i, text in docs:
            flagged = any(x in text.lower().split() for x in often)
            assert ("term" in {s.kind for s in out[i].spans}) == flagged and not any(x in out[i].sanitised.lower().split() for x in often)


def test_bar_is_by_the_number_of_pairs(spark):
    """With plain Benjamini and Hochberg up to a step."""
    r = random.Random(3)
    logs = [-r.expovariate(0.2) for _ in range(500)]
    frame = spark.createDataFrame([(x,) for x in logs], "by_chance double")
    for tried in (500, 50_000):
        best = max((x for i, x in enumerate(sorted(logs), 1) if x <= math.log(0.01 * i / tried)), default=-math.inf)
        got = S.bar(frame, tried, 0.01)
        assert got <= best + S.STEP and sum(x <= best for x in logs) - sum(x <= got for x in logs) <= 20
    assert S.bar(frame.limit(0), 1, 0.01) == -math.inf


def test_copies_are_no_evidence(spark):
    docs = spark.createDataFrame([(i, "same quaint words near kim@mail.example.org every time") for i in range(9)] + [(i, "filler text") for i in range(20, 60)], "doc_id long, text string")
    assert S.disclosures(docs).count() == 0
